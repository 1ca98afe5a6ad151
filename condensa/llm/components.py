"""Connected components of an edge table, by alternating large-star and small-star steps.

Nodes are longs; a component is named by its smallest node. Edges are first
thinned inside each task to spanning forests of bounded chunks, so a task's
memory doesn't grow with a component; if no more than a chunk is left (the count
is checked), one task ends the work, else the star steps do. Nothing is collected but two counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

CHUNK_EDGES = 300_000
MAX_ROUNDS = 60


def _forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        parent.setdefault(x, x)
        parent.setdefault(y, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    stars = [(x, root(x)) for x in list(parent)]
    return [x for x, r in stars if x != r], [r for x, r in stars if x != r]


def spanning_forests(edges: DataFrame) -> DataFrame:
    """edges (u, v) thinned to stars (u > v) with the same components, chunk by chunk."""

    def run(batches):
        a, b = [], []

        def out():
            u, v = _forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            a += batch.column(0).to_pylist()
            b += batch.column(1).to_pylist()
            if len(a) >= CHUNK_EDGES:
                yield out()
                a, b = [], []
        if a:
            yield out()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _stars(scratch: Scratch, edges: DataFrame, name: str, large: bool) -> DataFrame:
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # read from a table, so that both sides of the join are plain exchanges that can be split where one node is hot
    joined = pairs.join(scratch.table(least, f"{name}-least"), "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return scratch.table(out.where("u <> v").distinct(), name)


def components(scratch: Scratch, edges: DataFrame, name: str, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of an edge table (u, v).

    With a number of rounds, names of parts of components where more are needed;
    without, all rounds are made, and over MAX_ROUNDS of them are an error.
    """
    whole, rounds = rounds is None, rounds or MAX_ROUNDS
    now = scratch.table(spanning_forests(edges).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = sign(now)
    if mark[0] <= CHUNK_EDGES:
        # what is left is as small as the chunks above: one more of them finishes the components
        now, rounds = scratch.table(spanning_forests(now.repartition(1)), f"{name}-last"), 0
    for k in range(1, rounds + 1):
        now = _stars(scratch, _stars(scratch, now, f"{name}-{k}-large", True), f"{name}-{k}-small", False)
        if (new := sign(now)) == mark:
            break
        mark = new
    else:
        if whole and rounds:
            raise RuntimeError(f"components still changed in round {rounds}")
    links = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = now.select(F.col("v").alias("node")).distinct().join(links.select(F.col("u").alias("node")), "node", "left_anti")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
