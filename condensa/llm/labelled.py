"""The bounded, reproducible sample of labelled rows that the classifiers learn from.

Of each class at most so many rows are taken, in hash order of their id; their
whole texts, of any length, become features on the executors (at most one entry for each
bucket of a text), and one task learns from these: the driver gets the model only.
Labels without an id, held-out ones and texts that are null are not learnt from;
of an id's labels the greatest counts, of its texts the one with the least digest.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: buckets of a text (sorted, distinct) and how often each occurs in it
Features = tuple[np.ndarray, np.ndarray]


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no model may learn from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _packed(f: Features) -> tuple[bytes, bytes]:
    ids, times = f
    return zlib.compress(np.diff(ids, prepend=0).astype("<i4").tobytes(), 1), zlib.compress(times.astype("<i4").tobytes(), 1)


def _unpacked(ids: bytes, times: bytes) -> Features:
    return np.cumsum(np.frombuffer(zlib.decompress(ids), "<i4")).astype(np.int32), np.frombuffer(zlib.decompress(times), "<i4")


class Rows:
    """(features, label) of packed rows, unpacked one at a time whenever they are gone through."""

    def __init__(self, packed: list[tuple[int, bytes, bytes]]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __iter__(self):
        return ((_unpacked(ids, times), y) for y, ids, times in self.packed)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: dict[int, int],
    featurise: Callable[[list], list[Features]],
    train: Callable[[Iterable[tuple[Features, int]], dict[int, int]], tuple[np.ndarray, float]],
) -> tuple[np.ndarray, float]:
    """What train makes of (features, label) of up to so many texts of each class and the count of each class among all learnable labels."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().where(F.col("label").isin(*per_class)).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first, *rest = [known.where(F.col("label") == k).orderBy(*order).limit(n) for k, n in per_class.items()]
    picked = first
    for x in rest:
        picked = picked.unionByName(x)
    # picked has a fixed number of rows at most
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.md5("text").alias("tie"), "text")).alias("one")).select("doc_id", "label", "one.text")
    of_id = docs.schema["doc_id"].dataType.simpleString()

    def featured(batches):
        for b in batches:
            made = [_packed(f) for f in featurise(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i for i, _ in made], pa.binary()), pa.array([t for _, t in made], pa.binary())], names=["doc_id", "label", "ids", "times"])

    def fitted(batches):
        rows = []
        for b in batches:
            rows += zip(*(c.to_pylist() for c in b.columns))
        rows.sort(key=lambda r: r[0])
        weights, bias = train(Rows([r[1:] for r in rows]), counts)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(weights.astype("<f4").tobytes(), 1)], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    features = texts.mapInArrow(featured, f"doc_id {of_id}, label int, ids binary, times binary")
    made = features.repartition(1).mapInArrow(fitted, "weights binary, bias double").collect()
    if not made:
        return train([], counts)
    return np.frombuffer(zlib.decompress(made[0]["weights"]), "<f4"), made[0]["bias"]
