"""Structured Streaming: the same stateless transforms as in batches, sessions, and running counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas


def read(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)


def compress_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any stateless engine over a stream of documents."""
    return stream.transform(transform)


def to_metrics(prompts: DataFrame) -> DataFrame:
    from ..functions import tokens as tk
    from ..operators.engines import plain_extreme

    out = prompts.withColumn("_c", plain_extreme("prompt"))
    return out.select("sessionId", "prompt", F.col("_c").alias("compressed"), tk.estimate("prompt").alias("original_tokens"), tk.estimate("_c").alias("compressed_tokens"))


PROMPTS = schemas.PROMPTS


def sink_each_batch(stream: DataFrame, path: str, checkpoint: str, extra: Callable[[DataFrame, int], None] | None = None):
    """Appends every micro-batch once: a batch's folder carries its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if extra:
            extra(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(stream: DataFrame, ts: str, width: str, late: str = "10 minutes", slide: str | None = None, keys: tuple = (), aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Windows of event time with aggregates by name (a count if none are given); rows later than the watermark are left out."""
    made = aggregates or {"n": F.count("*")}
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*[a.alias(n) for n, a in made.items()]).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *made)


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def running_counters(stream: DataFrame, key: str, value: str, ttl_ms: int = 24 * 3_600_000) -> DataFrame:
    """Count and sum per key, kept as state (output mode update); a key that is idle for ttl_ms of processing time is forgotten."""
    return _kept(stream, key, value, ttl_ms, ("n", "total"), lambda n, total, new: (n + len(new), total + float(new.fillna(0).sum())))


def expiring_cache(stream: DataFrame, key: str, value: str, ttl_ms: int = 1_800_000) -> DataFrame:
    """The last value per key with the number of updates; keys idle for ttl_ms of processing time are dropped."""
    return _kept(stream, key, value, ttl_ms, ("updates", "last"), lambda n, last, new: (n + len(new), float(new.iloc[-1])))


def _kept(stream: DataFrame, key: str, value: str, ttl_ms: int, names: tuple[str, str], step) -> DataFrame:
    """A long and a double per key as state, renewed by step(long, double, new values), with an idle time-out."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, 0.0)
        for f in frames:
            now = step(*now, f[value])
        state.update(now)
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [k[0]], names[0]: [now[0]], names[1]: [now[1]]})

    kind = stream.schema[key].dataType.simpleString()
    made = f"{names[0]} long, {names[1]} double"
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {made}", made, "update", GroupStateTimeout.ProcessingTimeTimeout)


def answer_prompts(prompts: DataFrame, rules: DataFrame, config) -> DataFrame:
    """Prompt events with their compressed prompt and what was done to it as metadata; an event without text comes back as it is."""
    from ..operators import engines as en

    engine = en.REGISTRY[en.SELECTION[config.level]]
    out = engine(prompts.withColumnRenamed("prompt", "text"), en.rule_list(rules, config), config)
    saved = F.col("original_tokens") - F.col("compressed_tokens")
    note = F.create_map(F.lit("engine"), F.col("engine_used"), F.lit("saved"), saved.cast("string"), F.lit("ratio"), F.round("compression_ratio", 4).cast("string"))
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return out.select(F.coalesce("compressed_text", "text").alias("prompt"), *[c for c in prompts.columns if c not in ("prompt", "metadata")], F.map_concat(own, F.when(F.col("text").isNotNull(), note).otherwise(F.create_map().cast("map<string,string>"))).alias("metadata"))
