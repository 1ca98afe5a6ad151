"""The library's calls for one text or a few, as a tool server or a command line gives them: plain values in, plain values out.

Each tool takes a session, a rule table and arguments by name, and answers with a
dictionary that says ``success`` or the error; a failing call never raises.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions import profile as pr
from .functions import tokens as tk
from .operators import engines, rules
from .sources import io


def statistics(rule_table: DataFrame, collection: DataFrame | None = None) -> DataFrame:
    """(section, name, value): rules in all, by domain and type, vectors, and engines."""
    own = rules.statistics(rule_table)
    name = F.when(F.col("domain") != "*", F.concat(F.lit("domain "), "domain")).when(F.col("pattern_type") != "*", F.concat(F.lit("type "), "pattern_type")).otherwise("total")
    out = own.select(F.lit("rules").alias("section"), name.alias("name"), F.col("rules").alias("value"))
    if collection is not None:
        out = out.unionByName(collection.agg(F.count("*").alias("value")).select(F.lit("vectors").alias("section"), F.lit("total").alias("name"), "value"))
    listed = rule_table.sparkSession.createDataFrame([("engines", "total", len(engines.REGISTRY))], "section string, name string, value long")
    return out.unionByName(listed)


def health(rule_table: DataFrame, collection: DataFrame | None = None) -> dict:
    """Of each component whether it answers; without rules or vectors the whole is degraded, without engines unhealthy."""
    found: dict[str, dict] = {}

    def check(name: str, probe: Callable[[], dict], broken: str) -> str:
        try:
            found[name] = {"status": "healthy", **probe()}
            return "healthy"
        except Exception as e:  # noqa: BLE001  an answer about a failing component
            found[name] = {"status": "unhealthy", "error": f"{type(e).__name__}: {e}"}
            return broken

    states = [
        check("rules", lambda: {"available": rule_table.limit(1).count() > 0}, "degraded"),
        check("vectors", lambda: {"enabled": collection is not None, "total": 0 if collection is None else collection.count()}, "degraded"),
        check("engines", lambda: {"available": sorted(engines.REGISTRY)}, "unhealthy"),
    ]
    return {"overall": next((s for s in ("unhealthy", "degraded") if s in states), "healthy"), "components": found, "timestamp": time.time()}


class Service:
    def __init__(self, spark: SparkSession, rule_table: DataFrame, config: EngineConfig = EngineConfig(), collection: DataFrame | None = None):
        self.spark, self.rules, self.config, self.collection = spark, rule_table, config, collection
        self.tools: dict[str, Callable[..., dict]] = {n: getattr(self, f"_{n}") for n in ("compress", "analyse", "compare", "patterns", "stats", "health", "optimise")}

    def call(self, tool: str, **arguments) -> dict:
        try:
            if tool not in self.tools:
                raise ValueError(f"unknown tool: {tool}")
            return {"success": True, **self.tools[tool](**arguments)}
        except Exception as e:  # noqa: BLE001  errors are answers
            return {"success": False, "error": f"{type(e).__name__}: {e}"}

    def _one(self, text: str) -> DataFrame:
        return io.texts(self.spark, text)

    def _settings(self, level: str | None, domain: str | None) -> EngineConfig:
        import dataclasses

        return dataclasses.replace(self.config, level=level or self.config.level, domain=domain or self.config.domain)

    def _compress(self, text: str, level: str | None = None, domain: str | None = None) -> dict:
        began = time.perf_counter()
        row = engines.compress(self._one(text), self.rules, self._settings(level, domain)).first().asDict()
        return {**{k: v for k, v in row.items() if k not in ("doc_id", "text")}, "seconds": time.perf_counter() - began}

    def _analyse(self, text: str) -> dict:
        c = self._one(text).select(
            pr.domain_of("text").alias("domain"), pr.content_type("text").alias("content_type"), pr.complexity("text").alias("complexity"), pr.analyzer_density("text").alias("density"),
            pr.readiness("text").alias("readiness"), pr.reading_minutes("text").alias("minutes"), tk.estimate("text").alias("tokens"), pr.estimated_ratio("text", pr.domain_of("text")).alias("estimated_ratio"),
        )
        s = pr.recommended_strategy(F.col("domain"), F.col("content_type"), F.col("density"), F.col("complexity"), F.col("readiness.overall"))
        return {"analysis": c.withColumn("strategy", s).first().asDict(recursive=True)}

    def _compare(self, text: str, level: str | None = None) -> dict:
        rows = engines.compare_engines(self._one(text), self.rules, self._settings(level, None)).drop("doc_id").collect()
        best = max((r for r in rows if r["error"] is None), key=lambda r: r["score"], default=None)
        return {"engines": [r.asDict() for r in rows], "best": best and best["engine"]}

    def _patterns(self, action: str, domain: str | None = None, search: str | None = None, original: str | None = None, compressed: str | None = None, limit: int = 10) -> dict:
        if action == "add":
            new = rules.starter_rules(self.spark, [((self.rules.agg(F.max("id")).first()[0] or 0) + 1, original, compressed, "phrase" if " " in original else "word", 500, domain or "general", 0, 0.0)])
            added = rules.insertable(new, self.rules).count() > 0
            self.rules = rules.add(self.rules, new)
            return {"added": added}
        rows = rules.search(self.rules, search or "", limit) if action == "search" else rules.scan(self.rules, domain=domain, limit=limit)
        return {"patterns": [r.asDict() for r in rows.select("id", "original", "compressed", "pattern_type", "priority", "domain").collect()]}

    def _stats(self) -> dict:
        out: dict[str, dict] = {}
        for r in statistics(self.rules, self.collection).collect():
            out.setdefault(r["section"], {})[r["name"]] = r["value"]
        return {"statistics": out}

    def _health(self) -> dict:
        return {"health": health(self.rules, self.collection)}

    def _optimise(self, text: str, model: str = "large", max_tokens: int | None = None) -> dict:
        row = engines.optimise(self._one(text), self.rules, model, max_tokens, self.config).first().asDict()
        return {"optimisation": {k: v for k, v in row.items() if k not in ("doc_id", "text")}}
