"""Exact deduplication by two-pass Bloom filtering.

Texts are equal when identical after lower-casing A-Z only; a null text counts
as empty. Of equal texts the row with the largest id stays (null ids count as
smallest; of rows that also repeat the id, one stays).

Pass 1 sets every text hash's bits in a filter whose cells count to two; the
cells reached twice form a second filter that holds every repeated hash and a
few others. Pass 2 probes it: only rows found there shuffle, the rest pass
straight through. The filter's size follows the row count up to ``MAX_BITS``
(32 MiB as a broadcast); beyond that it fills, more rows shuffle, and the
result stays the same.

Empty tables give empty results; extra columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

BITS_PER_ROW = 16
PROBES = 3
MIN_BITS, MAX_BITS = 1 << 18, 1 << 28
SEGMENT = 1 << 16
#: keys whose cells a task gathers before it emits them
FLUSH_KEYS = 1 << 19
#: a group over this share of all rows is hot; there are at most 1 / share such groups
HOT_SHARE, HOT_LEAST = 0.001, 1000


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores appended until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def normalised_digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).digest()


def with_digest(spark: SparkSession, df: DataFrame, text_col: str, name: str, keep: list[str] | None = None, flag: tuple[str, int, bytes] | None = None) -> DataFrame:
    """Adds the 32-byte digest of the normalised text, and on request whether a filter has it: (column, bits, table).

    keep: the columns to carry (default all). Both are computed in one pass, by one Python worker a task.
    """
    carried = df.columns if keep is None else keep
    at = text_col if text_col in carried else None
    src = df.select(*[F.col(f"`{c}`") for c in carried], *([] if at else [F.col(f"`{text_col}`").alias(name)]))
    added = [T.StructField(name, T.BinaryType())] + ([T.StructField(flag[0], T.BooleanType())] if flag else [])
    schema = T.StructType([*[df.schema[c] for c in carried], *added])
    n = len(carried)
    where = carried.index(at) if at else n
    shared = spark.sparkContext.broadcast(flag[2]) if flag else None

    def run(batches):
        for b in batches:
            digests = [normalised_digest(t.as_py()) for t in b.column(where)]
            columns = [*b.columns[:n], pa.array(digests, pa.binary())]
            if flag:
                columns.append(pa.array(member(digests, flag[1], shared.value)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return src.mapInArrow(run, schema)


def _cells(digests: list[bytes], bits: int) -> np.ndarray:
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, :PROBES]
    return (words & np.uint64(bits - 1)).astype(np.int64)


def bits_for(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (max(rows, 1) * BITS_PER_ROW - 1).bit_length()))


def member(digests: list[bytes], bits: int, table: bytes) -> np.ndarray:
    """Whether each digest may be in a filter."""
    if not digests:
        return np.zeros(0, bool)
    c = _cells(digests, bits)
    return ((np.frombuffer(table, np.uint8)[c >> 3] >> (c & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def bloom_filter(digests: DataFrame, rows: int, times: int = 2) -> tuple[int, bytes]:
    """digests: one binary column. The filter of cells reached at least once or twice: (bits, bytes)."""
    bits = bits_for(rows)

    def gather(batches):
        held: list[np.ndarray] = []
        count = 0

        def emit():
            cells, times = np.unique(np.concatenate(held), return_counts=True)
            segment = cells // SEGMENT
            cuts = np.flatnonzero(np.diff(segment)) + 1
            own, twice = np.split(cells % SEGMENT, cuts), np.split(times > 1, cuts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(x) for x in segment[np.concatenate([[0], cuts])]], pa.int32()),
                    pa.array([c.astype("<u2").tobytes() for c in own], pa.binary()),
                    pa.array([np.packbits(t).tobytes() for t in twice], pa.binary()),
                ],
                names=["segment", "cells", "twice"],
            )

        for b in batches:
            if b.num_rows:
                held.append(_cells(b.column(0).to_pylist(), bits).ravel())
                count += b.num_rows
            if count >= FLUSH_KEYS:
                yield from emit()
                held, count = [], 0
        if held:
            yield from emit()

    def merge(key, pdf):
        import pandas as pd

        seen, again = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
        for cells, twice in zip(pdf["cells"], pdf["twice"]):
            c = np.frombuffer(cells, "<u2")
            again[c] |= seen[c] | (times == 1) | np.unpackbits(np.frombuffer(twice, np.uint8))[: len(c)].astype(bool)
            seen[c] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(again, bitorder="little").tobytes()]})

    parts = digests.mapInArrow(gather, "segment int, cells binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    # at most bits / SEGMENT rows, MAX_BITS / 8 bytes in all
    for row in parts.groupBy("segment").applyInPandas(merge, "segment int, bits binary").collect():
        at = row["segment"] * (SEGMENT // 8)
        out[at : at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits, out.tobytes()


def flag_repeated(spark: SparkSession, df: DataFrame, digest: str, name: str, bits: int, table: bytes) -> DataFrame:
    """Adds whether the digest may occur again, as the filter says."""
    shared = spark.sparkContext.broadcast(table)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())])
    where = df.columns.index(digest)

    def run(batches):
        for b in batches:
            hit = member(b.column(where).to_pylist(), bits, shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def duplicate_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256 (32 bytes)."""
    scratch = Scratch(spark, "exact-dedup")
    hashed = scratch.table(with_digest(spark, docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", "sha", ["id"]), "hashed")
    rows = hashed.count()
    bits, table = bloom_filter(hashed.select("sha"), rows)
    flagged = flag_repeated(spark, hashed, "sha", "maybe", bits, table)
    alone = flagged.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = flagged.where("maybe").select("id", "sha")
    groups = scratch.table(again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    hot_size = max(HOT_LEAST, int(rows * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col("group_size") > hot_size))  # fewer than rows / hot_size groups
    placed = again.join(hot, "sha").unionByName(again.join(hot.select("sha"), "sha", "left_anti").join(groups.where(F.col("group_size") <= hot_size), "sha"))
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    lost = placed.where(~stays).withColumn("kept", F.lit(False))
    one = Window.partitionBy("sha").orderBy("id")
    won = placed.where(stays).withColumn("kept", F.row_number().over(one) == 1)
    out = alone.unionByName(lost).unionByName(won)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of equal texts; the columns stay as they are."""
    scratch = Scratch(spark, "drop-copies")
    sha, maybe, keep = (fresh(docs, x) for x in ("sha", "maybe", "keep"))
    hashed = scratch.table(with_digest(spark, docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", "sha", ["id"]), "hashed")
    bits, table = bloom_filter(hashed.select("sha"), hashed.count())
    stays = flag_repeated(spark, hashed, "sha", "maybe", bits, table).where("maybe").groupBy("sha").agg(F.max("id").alias("keep"))
    stays = scratch.table(stays.select(F.col("sha").alias(sha), F.col("keep").alias(keep)), "stays")
    flagged = with_digest(spark, docs, text_col, sha, flag=(maybe, bits, table))
    again, last = flagged.where(F.col(maybe)).alias("a"), stays.alias("b")
    # the key has the id too: one row of a group matches, however large the group is
    won = again.join(last, (F.col(f"a.{sha}") == F.col(f"b.{sha}")) & F.col(f"a.`{id_col}`").eqNullSafe(F.col(f"b.{keep}")), "left_semi")
    return flagged.where(~F.col(maybe)).unionByName(won.dropDuplicates([sha])).select(*[F.col(f"`{c}`") for c in docs.columns])
