"""Times of a driver's own stages and counts of cache hits, as plain values and as a table."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Timers:
    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock = clock
        self.rows: list[tuple[str, float]] = []

    @contextlib.contextmanager
    def stage(self, name: str):
        began = self.clock()
        try:
            yield self
        finally:
            self.rows.append((name, self.clock() - began))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, seconds double")

    def bottlenecks(self, spark: SparkSession) -> DataFrame:
        """Seconds of each stage, their share of all, and the stages' rank."""
        summed = self.frame(spark).groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("runs"))
        share = F.coalesce(F.try_divide("seconds", F.sum("seconds").over(Window.partitionBy())), F.lit(0.0))
        return summed.withColumns({"share": share, "rank": F.row_number().over(Window.orderBy(F.desc("seconds"), "stage"))})


class CacheCounts:
    def __init__(self):
        self.hits = self.misses = 0

    def record(self, hit: bool) -> None:
        self.hits += hit
        self.misses += not hit

    def stats(self) -> dict:
        return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / max(self.hits + self.misses, 1)}
