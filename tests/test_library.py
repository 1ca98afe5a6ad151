"""The library's operators against hand-computed values and plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from condensa import lexicons as lx
from condensa.config import EngineConfig
from condensa.functions import profile as pr
from condensa.functions import quality as q
from condensa.functions import rewrite as rw
from condensa.functions import segment as sg
from condensa.functions import similarity as sm
from condensa.functions import tokens as tk
from condensa.operators import engines as en
from condensa.operators import matching as mt
from condensa.operators import metrics as me
from condensa.operators import rules as rl
from condensa.operators import vectors as ve


def value(spark, text, f):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").select(f("text").alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (tk.estimate, "", 1),
        (tk.estimate, "abcdefgh", 2),
        (tk.word_estimate, "a b c", 3),
        (tk.word_estimate, "  ", 0),
        (tk.string_hash, "abc", 96354),
        (rw.drop_adjacent_repeats, "a A b a", "a b a"),
        (rw.drop_function_words, "The cat is not on the mat", "The cat is not mat"),
        (rw.shorten_phrases, "as soon as possible; thé the théthe", "asap; thé the théthe"),
        (rw.one_line, " a\n\n b ", "a b"),
        (rw.basic, "a....  b!!!", "a... b!"),
        (rw.normalise_text, "a\r\nb\tc d ", "a\nb  c d"),
        (rw.squeeze_long_words, "strengthening cat", "strngthnng cat"),
        (pr.redundancy, "a A b c", 0.25),
        (pr.redundancy, "", 0.0),
        (pr.formality, "", 0.5),
        (pr.repeated_ngrams, "a b a b a b", 2 * 2 + 3 * 2 + 4),
        (pr.complexity, None, 0.0),
        (lambda x: q.coherence(x), "", 0.0),
        (lambda x: F.to_json(sg.code_blocks(x)), "x\n```py\nz\n``` and `q`", '[{"position":2,"language":"py","code":"```py\\nz\\n```","fenced":true},{"position":18,"language":"","code":"`q`","fenced":false}]'),
    ],
)
def test_values(spark, f, text, want):
    got = value(spark, text, f)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_segments_modes(spark):
    text = "prose\n```\ncode\n\nmore\n```\nend\n\nlast"
    kinds = lambda mode: [(s["text"], s["type"]) for s in value(spark, text, lambda x: sg.segments(x, mode))]
    assert kinds("correct") == [("prose", "text"), ("code\n\nmore", "code"), ("end", "text"), ("last", "text")]
    assert kinds("reference")[0] == ("prose", "code")


def greedy(matches):
    """The resolution rule over sets of positions."""
    taken = []
    for m in sorted(matches, key=lambda m: (m["position"], -m["priority"], m["id"])):
        met = [o for o in taken if o["position"] < m["position"] + m["size"] and m["position"] < o["position"] + o["size"]]
        best = max(met, key=lambda o: o["priority"], default=None)
        if best is None or m["priority"] > best["priority"] * 1.2 or m["confidence"] > best["confidence"] + 0.2:
            taken = [o for o in taken if o not in met] + [m]
    return sorted((m["position"], m["id"]) for m in taken)


def test_resolution_is_greedy(spark):
    rng = random.Random(5)
    sets = [[{"position": rng.randint(0, 40), "priority": rng.choice([100, 500, 550, 700, 900]), "id": k, "size": rng.randint(1, 9), "original_text": "o", "compressed_text": "c", "confidence": rng.random(), "success_rate": 0.5} for k in range(rng.randint(0, 20))] for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(sets)), f"doc_id long, matches {mt.MATCH}")
    for r in rows.select("doc_id", mt.resolve(F.col("matches")).alias("m")).collect():
        assert [(m["position"], m["id"]) for m in r["m"]] == greedy(sets[r["doc_id"]])


def test_positions_overlap(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("xÄbäB", "äb"), ("", "a"), ("a$b\\Ec", "\\e"), ("abc", "")], "t string, o string")
    assert [r[0] for r in df.select(mt.positions(F.col("t"), F.col("o"))).collect()] == [[0, 1, 2], [1, 3], [], [3], []]


def test_levels_shrink_and_none_is_identity(spark):
    text = "And the purchase order came with the temperature report and the quarterly report from the order desk"
    docs = spark.createDataFrame([(1, text), (2, "  "), (3, None)], "doc_id long, text string")
    rules = rl.starter_rules(spark)
    size = {}
    for level in ("none", "light", "balanced", "aggressive"):
        rows = en.compress(docs, rules, EngineConfig(level=level)).collect()
        rows.sort(key=lambda r: r["doc_id"])
        assert [r["doc_id"] for r in rows] == [1, 2, 3]
        size[level] = len(rows[0]["compressed_text"])
    assert size["none"] == len(text)
    assert size["aggressive"] <= size["balanced"] <= len(text) and size["light"] <= len(text)
    accepted, rejected = rl.split_valid(docs)
    assert (accepted.count(), rejected.count()) == (1, 2)


def test_code_is_kept(spark):
    docs = spark.createDataFrame([(1, "the order and\n```\nthe order and\n```")], "doc_id long, text string")
    out = en.compress(docs, rl.starter_rules(spark), EngineConfig(level="aggressive")).first()["compressed_text"]
    assert "the order and" in out


def test_added_rule_and_round_trip(spark):
    rules = rl.add(rl.starter_rules(spark), rl.starter_rules(spark, [(50, "warehouse", "whse", "word", 950, "general", 0, 0.9)]))
    docs = spark.createDataFrame([(1, "a warehouse stood near a big warehouse")], "doc_id long, text string")
    out = en.compress(docs, rules, EngineConfig(level="aggressive"))
    assert out.first()["compressed_text"].count("whse") == 2
    assert en.decompress(out, rules).first()["expanded_text"].count("warehouse") == 2
    assert rl.add(rules, rl.starter_rules(spark, [(51, "warehouse", "wh", "word", 1, "general", 0, 0.0)])).count() == rules.count()


def test_usage_and_bulk(spark):
    rules = rl.starter_rules(spark)
    used = spark.createDataFrame([(1, True), (1, False), (2, True)], "pattern_id int, success boolean")
    out = {r["id"]: r["frequency"] for r in rl.record_usage(rules, used).collect()}
    assert (out[1], out[2], out[3]) == (14, 10, 31)
    table, added = rl.bulk_add(rules, rl.starter_rules(spark, [lx.RULES[0], (60, "x1", "y", "word", 1, "general", 0, 0.0)]))
    assert added.count() == 1 and table.count() == rules.count() + 1


def test_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting", [1.0, 0.0], [0.0, 0.0])], "a string, b string, u array<double>, v array<double>")
    r = df.select(sm.edit("a", "b").alias("e"), sm.cosine(F.col("u"), F.col("v")).alias("z"), sm.cosine(F.col("u"), F.col("u")).alias("o"), F.size(sm.char_embedding("a")).alias("n")).first()
    assert r["e"] == pytest.approx(1 - 3 / 7) and (r["z"], r["n"]) == (0.0, 384) and r["o"] == pytest.approx(1)


def test_top_k_blocks_agree(spark, monkeypatch):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id < 12").withColumnRenamed("vec_id", "query_id")
    one = sorted(tuple(r)[:2] for r in ve.top_k(queries, rows, 3).collect())
    monkeypatch.setattr(ve, "QUERY_BLOCK", 5)
    assert sorted(tuple(r)[:2] for r in ve.top_k(queries, rows, 3).collect()) == one


def test_empty_metrics(spark):
    from condensa import schemas

    empty = spark.createDataFrame([], schemas.METRICS)
    assert me.summary(empty).first()["compressions"] == 0
    assert me.engines(empty).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from condensa.streaming import streams

    docs = spark.createDataFrame([(i, f"and the order {i} of the the day") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    step = lambda d: d.select("doc_id", en.plain_extreme("text").alias("c"))
    stream = streams.compress_stream(streams.read(spark, str(tmp_path / "in"), docs.schema), step)
    streams.sink_each_batch(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, step(docs).collect()))


def test_entry_works_without_llm():
    import __spark_entry__ as entry

    assert "compression_by_lang" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_large_rule_tables_match_alike(spark, monkeypatch):
    texts = [(1, "The band the nation, and the STATION"), (2, "c++ or f++ in words; order"), (None, "band the word"), (4, None), (5, ""), (1, "words andthe ion\nand the\nend"), (6, "\U0001f600ion the")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    named = [("tion", "compound"), ("ord", "abbreviation"), ("and the", "phrase"), ("++", "compound"), ("word", "word"), ("the", "word"), ("the\nend", "phrase"), ("n", "compound"), ("", "compound"), (None, "word"), ("ion the", "phrase")]
    rules = spark.createDataFrame([(i, o, "x", kind, 500, 0.5, "general") for i, (o, kind) in enumerate(named)], "id long, original string, compressed string, pattern_type string, priority int, success_rate double, domain string")
    rules = rules.unionByName(rules.where("id = 0"))
    rows = lambda df: sorted(map(str, df.collect()))
    want = [rows(mt.find(docs, rules)), rows(mt.counts(docs, rules.where("id <> 8")))]
    want.append(rows(mt.resolved(docs.dropDuplicates(["doc_id"]), rules.dropDuplicates(["id"])).select("doc_id", "id", "position")))
    monkeypatch.setattr(mt, "RULES_A_PASS", 2)
    assert len(want[0]) > 10
    assert [rows(mt.find(docs, rules)), rows(mt.counts(docs, rules.where("id <> 8"))), rows(mt.resolved(docs.dropDuplicates(["doc_id"]), rules.dropDuplicates(["id"])).select("doc_id", "id", "position"))] == want
    # and as the Column functions say
    t, o = F.col("text"), F.col("original")
    plain = docs.crossJoin(rules).withColumn("position", F.explode(mt.positions(t, o)))
    plain = plain.where((F.col("pattern_type") != "word") | mt.whole_word(t, F.col("position"), F.length("original")))
    plain = plain.withColumn("confidence", mt.confidence(t, F.col("position"), F.length("original"), F.col("priority"), F.col("success_rate"), F.col("domain")))
    monkeypatch.undo()
    assert rows(plain.select("doc_id", "id", "position", "confidence")) == rows(mt.find(docs, rules).select("doc_id", "id", "position", "confidence"))


def test_compress_keeps_every_row(spark, tmp_path):
    from condensa.plans import catalogue

    long = "in order to utilize the application, " * 3000
    texts = [(1, "in order to utilize it"), (2, long), (3, ""), (4, "  "), (5, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r["doc_id"]: r for r in en.compress(docs, rl.starter_rules(spark), EngineConfig(level="aggressive")).collect()}
    assert {i: list(out[i]["warnings"]) for i in (2, 3, 4, 5)} == {2: ["too long"], 3: ["blank"], 4: ["blank"], 5: ["blank"]}
    assert all(out[i]["compressed_text"] == t and out[i]["engine_used"] == "none" for i, t in texts[1:])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = {r["doc_id"]: r for r in catalogue.QUERIES["extreme_compress"](spark, str(tmp_path)).collect()}
    assert sorted(made) == [1, 2, 3, 4, 5] and made[2]["engine_used"] == "extreme" and len(made[2]["compressed_text"]) < len(long)


def test_char_embedding(spark):
    """Against plain Python, and without work that grows with the square of the size."""
    texts = ["", None, "A", "Supplier#000000001", "Été 😀 x", "ß" * 500, "ab\n\u0000c", " "]
    for size in (1, 5, 384):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", sm.char_embedding("t", size).alias("e")).collect()
        for r in rows:
            codes = [float(ord(c)) for c in (texts[r["i"]] or "").lower()[:size]]
            norm = sum(c * c for c in codes) ** 0.5
            assert r["e"] == pytest.approx([c / norm if norm else 0.0 for c in codes] + [0.0] * (size - len(codes)), rel=1e-6)
    many = spark.range(20_000).select(sm.char_embedding(F.concat(F.lit("Supplier#"), F.col("id").cast("string")), 384).alias("e"))
    began = time.time()
    assert many.where(F.size("e") == 384).select(F.round(F.aggregate(F.transform("e", lambda x: (x * x).cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("n")).where("n = 1").count() == 20_000
    assert time.time() - began < 60


def test_model_embeddings(spark):
    """A model is loaded once a task and sees every text once, nulls as empty texts."""

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, "")], "doc_id long, text string")
    out = {r["doc_id"]: list(r["embedding"]) for r in ve.embed(df, load).collect()}
    assert out == {1: [3.0, 1.0], 2: [3.0, 1.0], 3: [0.0, 1.0], 4: [0.0, 1.0]}


def test_timers(spark):
    from condensa.timing import CacheCounts, Timers

    ticks = iter([0.0, 1.0, 1.0, 4.0])
    timers = Timers(clock=lambda: next(ticks))
    with timers.stage("scan"):
        pass
    with timers.stage("rewrite"):
        pass
    rows = {r["stage"]: r for r in timers.bottlenecks(spark).collect()}
    assert rows["rewrite"]["share"] == 0.75 and rows["rewrite"]["rank"] == 1 and rows["scan"]["seconds"] == 1.0
    counts = CacheCounts()
    for hit in (True, True, False):
        counts.record(hit)
    assert counts.stats() == {"hits": 2, "misses": 1, "hit_rate": pytest.approx(2 / 3)}
