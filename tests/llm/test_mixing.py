import pytest
from pyspark.sql import functions as F

from condensa.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copy string"


def dealt(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    """The contract word by word: deal the pool, cap, deal the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: ceiling * sizes[s] for s in names}
    got, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, excess = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            got[s] += left * w[s] / total
        for s in list(open_):
            if got[s] > cap[s]:
                excess += got[s] - cap[s]
                got[s] = cap[s]
                open_.discard(s)
        left = excess
    return got


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_budgets(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "é", None, "d", "e"]) if i % 3 else "hot", "x", "y") for i in range(300)]
    rows += [rows[5], (None, "a b c", "a", None, None), (7, None, "b", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(spark, df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = dealt(sizes)
    for source, size in sizes.items():
        mine = [r for r in out if r["source"] == source]
        assert {r["source_size"] for r in mine} == {size}
        assert mine[0]["target"] == pytest.approx(want[source])
        assert sum(r["taken"] for r in mine) == pytest.approx(want[source], abs=1)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
    again = mixing.mix(spark, df.repartition(7)).collect()
    key = lambda r: (r["id"] is None, r["id"], r["source"] or "", r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_repeated_rows_and_columns(spark):
    rows = [(i, "w " * (i % 7), "s" + str(i % 4), "keep", "this") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {r["id"]: r for r in mixing.mix(spark, df).collect()}
    out = mixing.repeated(spark, df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for i, r in taken.items():
        assert abs(counts.get(i, 0) * r["size"] - r["taken"]) <= r["size"] / 2 + 1e-9
    assert out.where(F.col("size") != "keep").count() == 0


def test_repeated_ids(spark):
    """Rows that share an id, or have none, come as often as each of them is taken."""
    rows = [(None if i % 3 else 5, f"v{i % 40} " * (i % 7), "s" + str(i % 4), "keep", "this") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.mix(spark, df).collect()
    want = {}
    for r in taken:
        more = 2 * (r["taken"] - r["epochs"] * r["size"]) >= r["size"] if r["size"] else r["cut_before"] < r["rest"]
        key = (r["id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["epochs"] + more
    got = {}
    for r in mixing.repeated(spark, df).collect():
        key = (r["doc_id"], r["source"], len(r["text"].split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(spark, df).count() == 0
    assert mixing.repeated(spark, df).count() == 0
