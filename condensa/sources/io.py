"""Readers and writers. Paths are anything Spark can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_texts(spark: SparkSession, path: str, kind: str = "text", text: str = "text", doc_id: str | None = None) -> DataFrame:
    """doc_id, text from whole text files, or from a column of parquet, json or csv files."""
    if kind == "text":
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        return rows.select(F.xxhash64("path").alias("doc_id"), "text", "path")
    rows = spark.read.format(kind).option("header", True).load(path)
    return rows.withColumns({"text": F.col(text), "doc_id": F.col(doc_id) if doc_id else F.xxhash64(text)})


def texts(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def read_rules(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A rule table; missing values get the schema's defaults."""
    rows = spark.read.schema(schemas.RULES).format(kind).option("header", True).load(path)
    return rows.fillna({"priority": 500, "language": "en", "domain": "general", "frequency": 0, "success_rate": 0.0, "version": 1, "is_active": True})


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).json(path)


def read_collection(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(where) if where else rows


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """Parameterised SQL over the given tables."""
    return spark.sql(sql, args=args, **tables)


def write_texts(results: DataFrame, path: str, kind: str = "parquet") -> None:
    out = results.select("compressed_text") if kind == "text" else results
    out.write.mode("overwrite").format(kind).save(path)


def export_metrics(metrics: DataFrame, path: str, kind: str = "json", minutes: int = 60) -> None:
    """csv: the raw rows; json: summary, comparisons, time series and raw rows, each in a folder."""
    from ..operators import metrics as m

    if kind == "csv":
        metrics.write.mode("overwrite").option("header", True).csv(path)
        return
    timed = metrics.withColumn("ts", F.timestamp_seconds("timestamp"))
    saved = F.sum(F.col("original_tokens") - F.col("compressed_tokens")).alias("tokens_saved")
    series = m.series(timed, "ts", minutes, [F.count("*").alias("n"), F.avg("compression_ratio").alias("avg_ratio"), F.avg("quality_score").alias("avg_quality"), saved])
    for name, rows in {"series": series, "summary": m.summary(metrics), "engines": m.engines(metrics), "domains": m.domains(metrics), "usage": m.usage(metrics), "raw": metrics}.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def retained(rows: DataFrame, ts: str, tie: str, most: int = 1000) -> DataFrame:
    """The newest rows of a session store of bounded size: older ones are out first."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(most)


def append_retained(rows: DataFrame, path: str, ts: str, tie: str, most: int = 1000) -> None:
    """Appends to a store that keeps its newest rows: the new table is written beside the old one, then takes its place."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(folder):
        rows = spark.read.schema(rows.schema).parquet(path).unionByName(rows)
    staged = path.rstrip("/") + ".staged"
    retained(rows, ts, tie, most).write.mode("overwrite").parquet(staged)
    files.delete(folder, True)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), folder):
        raise OSError(f"{staged} can't take the place of {path}")


def write_log(results: DataFrame, path: str, least: str = "info") -> None:
    """A JSON line for each result at or above a level, appended."""
    from ..operators import metrics as m

    m.structured_log(results, least).select("line").write.mode("append").text(path)


def overwrite_rules(rules: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a rule table that rows may be derived from: written beside it, then read back over it."""
    staged = path.rstrip("/") + ".staged"
    rules.write.mode("overwrite").format(kind).save(staged)
    rules.sparkSession.read.schema(rules.schema).format(kind).load(staged).write.mode("overwrite").format(kind).save(path)
