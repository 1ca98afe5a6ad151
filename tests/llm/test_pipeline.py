"""The pipeline's stages, each judged on its own input."""

import random

import corpus_pipeline
from test_operators import LOWER, groups

from condensa.llm import mixing, pipeline_query, sentencepiece_wfst


def make(spark, path):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(500)]
    docs, labels = [], []
    for i in range(260):
        t = rng.choices(words, k=rng.randint(10, 60))
        bad = i % 5 == 0
        if bad:
            for k in range(4):
                t[rng.randrange(len(t))] = "zorkish"
        docs.append((i, " ".join(t), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(bad)))
    for i in range(260, 300):
        text = docs[rng.randrange(200)][1]
        if i % 2:
            text = text.upper()
        else:
            text += " tail"
        docs.append((i, text, "fr", None, 2))
    docs += [(300, None, None, "s1", None), (301, "", "en", "s9", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {i: (t, s) for i, t, _, s, _ in docs}


def test_stages(spark, tmp_path):
    texts = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, [sorted(texts)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
    clean = [i for i in seen[0] if "zorkish" not in (texts[i][0] or "").lower()]
    assert seen[1] == clean
    last = {}
    for i in seen[1]:
        key = (texts[i][0] or "").translate(LOWER)
        last[key] = max(last.get(key, -1), i)
    assert seen[2] == sorted(last.values())
    assert seen[3] == sorted(i for i, (_, c) in groups([(i, texts[i][0]) for i in seen[2]]).items() if i == c)
    taken = {r["id"]: r for r in mixing.mix(spark, spark.read.parquet(f"{tmp_path}/2")).collect()}
    for i in seen[3]:
        assert abs(seen[4].count(i) * taken[i]["size"] - taken[i]["taken"]) <= taken[i]["size"] / 2
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    with open(sentencepiece_wfst.MODEL_FILE, "rb") as f:
        machine = sentencepiece_wfst.compiled(f.read())
    assert sorted(r["doc_id"] for r in pieces) == seen[4]
    assert all(machine.decode(r["piece_ids"]) == (r["text"] or "") and r["n_pieces"] == len(r["piece_ids"]) for r in pieces)
    # the whole run gives what the stages give one after another, and so does the query
    key = lambda r: (r["doc_id"], r["text"] or "", tuple(r["piece_ids"]), r["n_pieces"])
    want = sorted(map(key, pieces))
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want
    assert sorted(map(key, pipeline_query.QUERIES["pipeline"](spark, str(tmp_path)).collect())) == want


def test_empty(spark, tmp_path):
    make(spark, str(tmp_path / "full"))
    spark.read.parquet(f"{tmp_path}/full/documents.parquet").limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/labels.parquet").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
