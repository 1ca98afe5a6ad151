"""The library in SQL: functions and a table function of a session.

``register`` adds

* ``condensa_tokens(text)``, ``condensa_ratio(text, short)``, ``condensa_redundancy(text)``: SQL functions, so the
  planner sees through them;
* ``condensa_compress(text, level)``: the engine of a level, batch by batch;
* ``condensa_matches(text)``: a table function with a row for each resolved match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .operators import engines, kernel

FUNCTIONS = {
    "condensa_tokens(x STRING) RETURNS BIGINT": "CASE WHEN length(coalesce(x, '')) = 0 THEN 1 ELSE greatest(1, length(x) DIV 4) END",
    "condensa_ratio(o STRING, c STRING) RETURNS DOUBLE": "CASE WHEN length(o) = 0 THEN 1 ELSE length(c) / length(o) END",
    "condensa_redundancy(x STRING) RETURNS DOUBLE": "1 - coalesce(try_divide(size(array_distinct(filter(split(lower(x), '\\\\s+'), t -> t <> ''))), size(filter(split(lower(x), '\\\\s+'), t -> t <> ''))), 1)",
}


def register(spark: SparkSession, rules: DataFrame, config: EngineConfig = EngineConfig()) -> None:
    own = engines.rule_list(rules, config)
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("string")
    def compress(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ready = {}
        for texts, levels in batches:
            out = []
            for text, level in zip(texts, levels):
                if text is None or level == "none":
                    out.append(text)
                    continue
                if level not in ready:
                    ready[level] = kernel.Engines(own, level, config.domain, config.semantic_threshold, config.target_compression)
                e = ready[level]
                out.append(e.semantic(text) if level == "light" else e.extreme(text) if level == "aggressive" else e.hybrid(text)[0])
            yield pd.Series(out, dtype=object)

    spark.udf.register("condensa_compress", compress)

    @F.udtf(returnType="id int, position int, size int, original_text string, compressed_text string, confidence double")
    class Matches:
        def __init__(self):
            self.rules = kernel.Rules(own)

        def eval(self, text: str):
            for at, _, number, size, short, sure, _ in kernel.resolve(self.rules.matches(text or "")):
                yield number, at, size, text[at : at + size], short, sure

    spark.udtf.register("condensa_matches", Matches)
