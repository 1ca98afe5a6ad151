"""Analytics over many compressions: summaries, comparisons, series, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COST_PER_TOKEN = 2e-5


def _efficiency(scale: float = 1.0) -> Column:
    return (1 - F.avg("compression_ratio")) * F.avg("quality_score") / scale


def summary(metrics: DataFrame) -> DataFrame:
    ok = F.col("success")
    return metrics.agg(
        F.count("*").alias("compressions"),
        F.count_if(ok).alias("successful"),
        (F.count_if(ok) / F.nullif(F.count("*"), F.lit(0))).alias("success_rate"),
        F.sum("original_tokens").alias("input_tokens"),
        F.sum("compressed_tokens").alias("output_tokens"),
        F.try_divide(F.sum("compressed_tokens").cast("double"), F.sum("original_tokens").cast("double")).alias("overall_ratio"),
        *[f(c).alias(f"{n}_{c}") for c in ("quality_score", "processing_time_ms") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))],
        _efficiency().alias("efficiency"),
    )


def usage(metrics: DataFrame) -> DataFrame:
    """Counts by engine, domain and level in one pass over grouping sets."""
    m = metrics.select("engine_used", F.coalesce("domain", F.lit("unknown")).alias("domain"), "level")
    return m.groupingSets([["engine_used"], ["domain"], ["level"]], "engine_used", "domain", "level").agg(F.count("*").alias("n"))


def engines(metrics: DataFrame) -> DataFrame:
    means = [F.avg(c).alias(f"avg_{c}") for c in ("compression_ratio", "quality_score", "processing_time_ms", "pattern_matches_count")]
    return metrics.groupBy("engine_used").agg(F.count("*").alias("n"), *means, _efficiency(10).alias("efficiency"))


def domains(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(
        F.count("*").alias("n"), F.avg("compression_ratio").alias("avg_ratio"), F.avg("quality_score").alias("avg_quality"), ((1 - F.avg("compression_ratio")) * 100).alias("effectiveness")
    )


def sessions(metrics: DataFrame) -> DataFrame:
    saved = F.sum(F.col("original_tokens") - F.col("compressed_tokens"))
    return metrics.groupBy("session_id").agg(F.count("*").alias("compressions"), saved.alias("tokens_saved"), (saved * COST_PER_TOKEN).alias("cost_saved"), F.avg("compression_ratio").alias("avg_ratio"), (F.max("timestamp") - F.min("timestamp")).alias("duration_s"))


def top(rows: DataFrame, by: str, k: int = 5) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def session_details(metrics: DataFrame, k: int = 5) -> DataFrame:
    """Each session's k most frequent domains (by count, then name) and its engines' mean ratio and quality, as two kinds of rows."""
    m = metrics.withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    counted = m.groupBy("session_id", "domain").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "domain"))
    none = F.lit(None).cast("double")
    domains_ = counted.withColumn("rank", rank).where(F.col("rank") <= k).select("session_id", F.lit("domain").alias("kind"), F.col("domain").alias("name"), "n", none.alias("avg_ratio"), none.alias("avg_quality"))
    engines_ = m.groupBy("session_id", "engine_used").agg(F.count("*").alias("n"), F.avg("compression_ratio").alias("avg_ratio"), F.avg("quality_score").alias("avg_quality"))
    return domains_.unionByName(engines_.select("session_id", F.lit("engine").alias("kind"), F.col("engine_used").alias("name"), "n", "avg_ratio", "avg_quality"))


def named_statistics(rows: DataFrame, name: str, value: str, ts: str, tie: str) -> DataFrame:
    """Count, mean, extremes and the latest value of each name; of values of one time that with the greatest tie is the latest."""
    return rows.groupBy(name).agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.max_by(value, F.struct(ts, tie)).alias("latest"))


def last_values(rows: DataFrame, name: str, ts: str, tie: str, k: int = 100) -> DataFrame:
    w = Window.partitionBy(name).orderBy(F.desc(ts), F.desc(tie))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def bottlenecks(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Seconds since the step before, and their share of the key's total."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    steps = rows.withColumn("seconds", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w)), F.lit(0)) / 1e6)
    every = F.sum("seconds").over(Window.partitionBy(key))
    return steps.withColumn("share", F.coalesce(F.try_divide(F.col("seconds"), every), F.lit(0.0)))


def series(rows: DataFrame, ts: str, minutes: int, aggregates: list[Column]) -> DataFrame:
    """Tumbling buckets whose origin is the first event; empty ones are left out."""
    origin = rows.agg(F.min(ts).alias("_origin"))  # one row
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_origin").cast("timestamp"))
    bucket = F.floor(seconds / (minutes * 60_000_000)).cast("long")
    return rows.crossJoin(F.broadcast(origin)).groupBy(bucket.alias("bucket")).agg(*aggregates)


def session_windows(rows: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def recommendations(metrics: DataFrame) -> DataFrame:
    """Advice from the summary, one row."""
    s = summary(metrics)
    best = engines(metrics).agg(F.max_by("engine_used", F.struct(F.round("efficiency", 9), "engine_used")).alias("best_engine"))
    advice = F.array_compact(F.array(F.when(F.col("avg_quality_score") < 7, "raise quality thresholds"), F.when(F.col("avg_processing_time_ms") > 500, "reduce processing time"), F.when(F.col("success_rate") < 0.95, "look into failures"), F.concat(F.lit("prefer "), "best_engine")))
    return s.crossJoin(best).select(advice.alias("advice"))


def report(metrics: DataFrame, price_per_1k: float = 0.03) -> DataFrame:
    """A text of a few lines over the summary, one row."""
    saved = F.col("input_tokens") - F.col("output_tokens")
    lines = F.format_string(
        "compressions: %d (%.1f%% successful)\ntokens: %d -> %d (%d saved, %.1f%%)\nquality: %.2f of 10\nestimated savings: $%.4f",
        "compressions", F.col("success_rate") * 100, "input_tokens", "output_tokens", saved, (1 - F.col("overall_ratio")) * 100, "avg_quality_score", saved / 1000 * price_per_1k,
    )
    return summary(metrics).select(lines.alias("report"))


def with_feedback(sessions_: DataFrame, feedback: DataFrame, key: str = "session_id") -> DataFrame:
    return feedback.join(sessions_, key)


def cost_by_model(tokens_saved: DataFrame, prices: DataFrame) -> DataFrame:
    """Savings times a price table (model, price_per_1k): the savings are summed first, so one row meets the prices, however many."""
    total = tokens_saved.agg(F.sum("token_savings").alias("saved"))
    return prices.crossJoin(F.broadcast(total)).select("model", (F.col("saved") / 1000 * F.col("price_per_1k")).alias("cost"))


def least_recently_used(rows: DataFrame, group: str, key: str, ts: str, capacity: int) -> DataFrame:
    """What a cache of so many keys holds after the rows of its group: the keys used last, with their last use and number of uses."""
    used = rows.groupBy(group, key).agg(F.max(ts).alias("last_used"), F.count("*").alias("uses"))
    w = Window.partitionBy(group).orderBy(F.desc("last_used"), key)
    return used.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= capacity).drop("rank")


LEVELS = ["debug", "info", "warn", "error"]


def structured_log(results: DataFrame, least: str = "info") -> DataFrame:
    """(level, line): a JSON line for each result at or above a level; results with warnings are warnings, those without a rewrite errors."""
    level = F.when(F.col("compressed_text").isNull(), "error").when(F.size("warnings") > 0, "warn").otherwise("info")
    wanted = LEVELS[LEVELS.index(least) :]
    fields = F.struct(level.alias("level"), F.col("doc_id"), F.col("engine_used"), F.round("compression_ratio", 6).alias("compression_ratio"), F.col("original_tokens"), F.col("compressed_tokens"), F.col("warnings"))
    return results.select(level.alias("level"), F.to_json(fields).alias("line")).where(F.col("level").isin(wanted))
