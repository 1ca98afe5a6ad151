"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. Rows are sorted by key inside ranges of keys
of their source, the ranges' token sums give each range its offset, and the
prefix sums are cut at the source's exact budget; a budget above the source's
size takes whole epochs first and cuts the last one. A source of any size is
spread over its key ranges, so no task holds a whole source.

Null or empty texts have size 0, a null source is a source of its own (last),
null ids and repeated rows are rows like others (ties in the key are broken by
id and size), an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 20_000
MIN_RANGES, MAX_RANGES = 256, 1 << 20


def random_key(seed: str, *cols: Column) -> Column:
    """Hex digits that any engine with md5 can compute again."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    ``share`` of all sizes is dealt by weight; a target stops at ``ceiling`` times
    its source's size, and the excess is dealt again by weight among the others
    until none is above. That fixed point gives every uncapped source the same
    amount per weight: over sources sorted by cap per weight, the level that is left
    for a source and those after it rises while sources are capped and falls after
    that, so the fixed point is its maximum.
    The frame has a row per source, not per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("ratio"), F.col("rank"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("target", F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    also: Sequence[Column] = (),
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, epochs (taken whole), rest (words of the cut epoch), cut_before, taken.

    Columns in also come along, and break ties in the order.
    """
    scratch = Scratch(spark, "mix")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *also)
    more = slim.columns[3:]
    slim = scratch.table(slim.withColumn("key", random_key(seed, F.col("id"))), "slim")
    ranges = min(MAX_RANGES, max(MIN_RANGES, -(-slim.count() // ROWS_PER_RANGE)))
    budget = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, ceiling)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = budget.withColumn("epochs", whole).withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    # the first 32 bits of the key, cut into equal ranges: a range sort whose ranges need no sampling
    keyed = slim.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * ranges / 2.0**32).cast("int"))
    named = keyed.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = named.groupBy("src", "range").agg(F.sum("size").alias("range_sum"))
    along = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("range_sum").over(along), F.lit(0))).select("src", "range", "offset")
    inside = Window.partitionBy("src", "range").orderBy("key", "id", "size", *more).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = named.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["src", "range"])
    before = F.col("offset") + F.col("upto") - F.col("size")
    plan = budget.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("cut_before"))).cast("long")
    return (
        summed.withColumn("cut_before", before)
        .join(plan, "src")
        .withColumn("taken", (F.col("epochs") * F.col("size") + cut).cast("long"))
        .select("id", "source", "size", "source_size", "target", "epochs", "rest", "cut_before", "taken", *more)
    )


def repeated(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows, whole, as often as the mix takes them.

    A row comes once for each whole epoch of its source, and once more if the cut
    epoch takes at least half of its words. Rows are told apart by id, source and
    text digest; of rows that agree in all three as many come once more as are taken.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    taken = mix(spark, docs, **options, also=[digest(F.col(f"`{text_col}`")).alias("digest")])
    more = F.when(F.col("size") > 0, 2 * (F.col("taken") - F.col("epochs") * F.col("size")) >= F.col("size")).otherwise(F.col("cut_before") < F.col("rest"))
    each = taken.select("id", "source", "digest", (F.col("epochs") + more.cast("long")).cast("int").alias("copies"))
    counted = each.groupBy("id", "source", "digest").agg(F.min("copies").alias("copies"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("extra"))
    counted = Scratch(spark, "mix-copies").table(counted.where("copies > 0 or extra > 0"), "copies")
    left = docs.alias("d")
    copy = "copy"
    while copy in docs.columns:
        copy += "_"

    def with_counts(right: DataFrame) -> DataFrame:
        pairs = ((F.col(f"d.`{id_col}`"), "id"), (F.col(f"d.`{source_col}`"), "source"), (digest(F.col(f"d.`{text_col}`")), "digest"))
        same = [x.eqNullSafe(F.col(f"c.{y}")) for x, y in pairs]
        return left.join(right.alias("c"), same[0] & same[1] & same[2])

    whole = with_counts(counted.where("copies > 0")).select("d.*", F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias(copy))
    # the cut of a source can fall among rows that agree: those of one key, as the order has them side by side
    among = Window.partitionBy("c.id", "c.source", "c.digest").orderBy("c.extra")
    cut = with_counts(F.broadcast(counted.where("extra > 0"))).withColumn(copy, F.row_number().over(among)).where(F.col(copy) <= F.col("c.extra"))
    return whole.unionByName(cut.select("d.*", copy)).drop(copy)
