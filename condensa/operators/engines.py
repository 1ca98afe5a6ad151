"""Compression engines: DataFrame to DataFrame.

The engines that fold matches over a text run in the kernel, one Arrow pass over
the text column; what they give is profiled and scored by Column expressions.
Variants whose rules apply one after another are expressions altogether. Rules
are a bounded list (``MAX_ENGINE_RULES``), read once from the rule table on the
driver: it is a small dimension whose size is checked.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import profile as pr
from ..functions import quality as q
from ..functions import rewrite as rw
from ..functions import tokens as tk
from ..functions.text import ltoks, quoted, replacement, toks
from . import kernel
from . import matching as mt
from . import rules as rl

MAX_ENGINE_RULES = 100_000
#: rules that an expression folds one after another
MAX_FOLDED_RULES = 2_000


class Engine(Protocol):
    def __call__(self, docs: DataFrame, rules: list[dict], config: EngineConfig) -> DataFrame: ...


def rule_list(rules: DataFrame, config: EngineConfig) -> list[dict]:
    """The rules for a context on the driver, in matching order: priority, then length."""
    rows = rules.where(F.col("is_active") & rl.suitable(config.domain, config.language, config.preserve_code)).orderBy(F.desc("priority"), F.desc(F.length("original")), "id").limit(MAX_ENGINE_RULES + 1).collect()
    if len(rows) > MAX_ENGINE_RULES:
        raise ValueError(f"over {MAX_ENGINE_RULES} rules for an engine; use matching.find, which takes them in blocks")
    return [r.asDict() for r in rows]


def plain_extreme(x) -> Column:
    """The extreme engine's expressions without rules and segments."""
    s = rw.drop_adjacent_repeats(rw.squeeze_long_words(rw.shorten_phrases(rw.drop_function_words(x))))
    return rw.one_line(rw.drop_modifiers(rw.drop_fillers(rw.reduce_passive(s))))


def _result(docs: DataFrame, out: str, engine: Column | str, config: EngineConfig) -> DataFrame:
    """Adds the result columns for a rewritten text column."""
    r = q.ratio("text", out)
    estimate = q.extreme_estimate("text", out)
    name = F.lit(engine) if isinstance(engine, str) else engine
    return docs.select(
        "*",
        F.col(out).alias("compressed_text"),
        tk.estimate("text").alias("original_tokens"),
        tk.estimate(out).alias("compressed_tokens"),
        r.alias("compression_ratio"),
        q.final(r, config.target_compression, F.lit(None).cast("double")).alias("quality_score"),
        name.alias("engine_used"),
        q.warnings(r, estimate).alias("warnings"),
    ).drop(out)


def none(docs: DataFrame, rules: list[dict], config: EngineConfig) -> DataFrame:
    return docs.select("*", F.col("text").alias("compressed_text"), tk.estimate("text").alias("original_tokens"), tk.estimate("text").alias("compressed_tokens"), F.lit(1.0).alias("compression_ratio"), F.lit(10.0).alias("quality_score"), F.lit("none").alias("engine_used"), F.array().cast("array<string>").alias("warnings"))


def _kernel(config: EngineConfig, rules: list[dict]) -> kernel.Engines:
    return kernel.Engines(rules, config.level, config.domain, config.semantic_threshold, config.target_compression)


def _rewritten(docs: DataFrame, rules: list[dict], config: EngineConfig, name: str) -> DataFrame:
    """docs with the text that an engine of the kernel makes; only the text goes to Python."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        each = getattr(_kernel(config, rules), name)
        for texts in batches:
            yield pd.Series([None if t is None else each(t) for t in texts], dtype=object)

    return docs.withColumn("_out", run("text"))


def semantic(docs: DataFrame, rules: list[dict], config: EngineConfig) -> DataFrame:
    return _result(_rewritten(docs, rules, config, "semantic"), "_out", "semantic", config)


def extreme(docs: DataFrame, rules: list[dict], config: EngineConfig) -> DataFrame:
    return _result(_rewritten(docs, rules, config, "extreme"), "_out", "extreme", config)


def profiled(docs: DataFrame) -> DataFrame:
    """docs with the profile that the strategy is chosen by; tokens are columns of their own, so each is made once."""
    cols = docs.columns
    bound = docs.withColumns({"_own": toks("text"), "_low": ltoks("text")})
    own, low = F.col("_own"), F.col("_low")
    return bound.select(
        *cols,
        pr.technical_density("text", low=low).alias("technical_density"),
        pr.structural_complexity("text", low).alias("structural_complexity"),
        pr.compression_potential("text", own, low).alias("compression_potential"),
        pr.quality_sensitivity("text", low=low).alias("quality_sensitivity"),
    )


def hybrid(docs: DataFrame, rules: list[dict], config: EngineConfig) -> DataFrame:
    """Profile, strategy, engine, refinement; engine_used names the engine that the text is from."""

    @F.pandas_udf("text string, engine string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engine = _kernel(config, rules)
        for texts in batches:
            made = [(None, None) if t is None else engine.hybrid(t) for t in texts]
            yield pd.DataFrame(made, columns=["text", "engine"], dtype=object)

    now = docs.withColumn("_made", run("text")).withColumn("_out", F.col("_made.text")).withColumn("_engine", F.col("_made.engine"))
    return _result(now.drop("_made"), "_out", F.col("_engine"), config).drop("_engine")


def needs_refinement(config: EngineConfig) -> Column:
    """Of a result whether the hybrid engine would try another engine on it."""
    return ((F.col("compression_ratio") > 0.8) & F.lit(config.target_compression < 0.7)) | (F.col("compression_ratio") < 0.3) | F.exists("warnings", lambda w: F.contains(w, F.lit("quality")))


def ladder_step(level: int, domain: str | None = None) -> Column:
    """The ladder's steps: 1 abbreviations and domain words, 2 punctuation, 3 whitespace, 4 nothing."""
    c = F.col("text")
    return {1: lambda: rw.normalise_whitespace(rw.domain_literals(rw.abbreviate(c), domain)), 2: lambda: rw.normalise_whitespace(rw.normalise_punctuation(c)), 3: lambda: rw.normalise_whitespace(c), 4: lambda: c}[level]()


def fallback(docs: DataFrame, level: int, domain: str | None = None) -> DataFrame:
    now = docs.withColumn("compressed_text", ladder_step(level, domain))
    r = q.ratio("text", "compressed_text")
    return now.withColumns({"compression_ratio": r, "quality_score": q.fallback(F.lit(level), r), "fallback_level": F.lit(level)})


def ladder(docs: DataFrame, domain: str | None = None, levels: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Every document once for each step, from one scan of the documents."""
    steps = F.array(*[F.struct(F.lit(k).alias("fallback_level"), ladder_step(k, domain).alias("compressed_text")) for k in levels])
    now = docs.select("*", F.inline(steps))
    r = q.ratio("text", "compressed_text")
    return now.withColumns({"compression_ratio": r, "quality_score": q.fallback(F.col("fallback_level"), r)})


def fallback_advice(level: Column, quality: Column, failed: Column) -> Column:
    step = F.when(failed, 4).when(quality < 5, 3).when(quality < 7, 2).otherwise(1)
    step = F.greatest(step, F.when(level == "light", 2).otherwise(1))
    expected = F.create_map(*[F.lit(v) for pair in {1: "10-20 %", 2: "5-10 %", 3: "2-5 %", 4: "none"}.items() for v in pair])
    return F.struct(step.alias("fallback_level"), expected[step].alias("expected"))


REGISTRY: dict[str, Engine] = {"none": none, "semantic": semantic, "hybrid": hybrid, "extreme": extreme}
SELECTION = {"none": "none", "light": "semantic", "balanced": "hybrid", "aggressive": "extreme"}


def register_engine(name: str, engine: Engine, level: str | None = None) -> None:
    REGISTRY[name] = engine
    if level:
        SELECTION[level] = name


def select_engine(level: Column, high_quality: Column | None = None) -> Column:
    """The engine of each level; with a high-quality flag, aggressive rows that have it go to hybrid."""
    strong = F.lit(SELECTION["aggressive"]) if high_quality is None else F.when(high_quality, "hybrid").otherwise("extreme")
    return F.when(level == "none", "none").when(level == "light", SELECTION["light"]).when(level == "aggressive", strong).otherwise(SELECTION["balanced"])


Hook = Callable[[DataFrame], DataFrame]


def compress(docs: DataFrame, rules: DataFrame, config: EngineConfig = EngineConfig(), hooks: list[Hook] = (), before: list[Hook] = ()) -> DataFrame:
    """Documents (doc_id, text, ...) with the result columns; blank and over-long ones (see rules.split_valid) come back as they are, with the reason as a warning.

    Hooks in before see the documents, those in hooks the results.
    """
    for hook in before:
        docs = docs.transform(hook)
    accepted, rejected = rl.split_valid(docs, most=config.max_chars)
    out = REGISTRY[SELECTION[config.level]](accepted, rule_list(rules, config), config)
    same = none(rejected, [], config).withColumn("warnings", F.array("reason")).drop("reason")
    out = out.unionByName(same)
    for hook in hooks:
        out = out.transform(hook)
    return out


def _by_level(text: Column, level: Column, rules: list[dict], config: EngineConfig) -> Column:
    """(text, engine) that the level's engine makes of a text, each row by its own level, in one pass; of a null text null."""

    @F.pandas_udf("text string, engine string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ready = {lvl: _kernel(dataclasses.replace(config, level=lvl), rules) for lvl in SELECTION}

        def one(t, lvl):
            if t is None:
                return None, None
            if lvl == "none" or not t.strip(kernel.BLANK):
                return t, "none"
            engine = ready[lvl if lvl in ready else "balanced"]
            return {"light": lambda: (engine.semantic(t), "semantic"), "aggressive": lambda: (engine.extreme(t), "extreme")}.get(lvl, lambda: engine.hybrid(t))()

        for texts, levels in batches:
            yield pd.DataFrame([one(t, lvl) for t, lvl in zip(texts, levels)], columns=["text", "engine"], dtype=object)

    return run(text, level)


def batch_compress(docs: DataFrame, rules: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Rows with a level column of their own (an unknown one counts as balanced), from one scan."""
    made = docs.withColumn("_made", _by_level(F.col("text"), F.col("level"), rule_list(rules, config), config))
    out = made.withColumn("_out", F.col("_made.text")).withColumn("_engine", F.col("_made.engine")).drop("_made")
    return _result(out, "_out", F.col("_engine"), config).drop("_engine")


#: levels of target models by name; others get the balanced one
MODEL_LEVELS = {"small": "light", "medium": "balanced", "large": "balanced"}


def optimise(docs: DataFrame, rules: DataFrame, model: str = "large", max_tokens: int | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Each text at the level that suits the target model, or with a token limit at the level that the needed reduction asks
    for; one that is still over the limit gets the strongest engine's text if that is within it. Adds level and fits.
    """
    folded = rule_list(rules, config)
    need = 1 - F.lit(float(max_tokens or 0)) / F.greatest(F.lit(1.0), F.ceil(F.length("text") / 4))
    level = F.when(need > 0.5, "aggressive").when(need > 0.3, "balanced").otherwise("light") if max_tokens else F.lit(MODEL_LEVELS.get(model, "balanced"))
    made = docs.withColumn("level", level)
    made = made.withColumn("_made", _by_level(F.col("text"), F.col("level"), folded, config)).withColumn("_first", F.col("_made.text")).withColumn("_engine", F.col("_made.engine")).drop("_made")
    if max_tokens:
        over = tk.estimate("_first") > max_tokens
        made = made.withColumn("_last", _by_level(F.when(over, F.col("text")), F.lit("aggressive"), folded, config)["text"])
        better = F.coalesce(over & (tk.estimate("_last") <= max_tokens), F.lit(False))
        made = made.withColumn("_out", F.when(better, F.col("_last")).otherwise(F.col("_first"))).withColumn("_engine", F.when(better, "extreme").otherwise(F.col("_engine"))).drop("_last")
        made = made.withColumn("fits", tk.estimate("_out") <= max_tokens)
    else:
        made = made.withColumn("_out", F.col("_first")).withColumn("fits", F.lit(True))
    return _result(made.drop("_first"), "_out", F.col("_engine"), config).drop("_engine")


def decompress(docs: DataFrame, rules: DataFrame, text: str = "compressed_text") -> DataFrame:
    """The text with the reversible rules applied backwards, in order of id; a list of them is folded, so it is bounded."""
    pairs = [(r["original"], r["compressed"]) for r in rules.where(rl.reversible() & F.col("is_active")).orderBy("id").limit(MAX_FOLDED_RULES + 1).collect()]
    if len(pairs) > MAX_FOLDED_RULES:
        raise ValueError(f"over {MAX_FOLDED_RULES} reversible rules to fold")
    return docs.withColumn("expanded_text", rw.expand(text, pairs))


def compare_engines(docs: DataFrame, rules: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Every engine over every document, from one scan, with a score of .6 compression and .4 quality; seconds is an engine's time for the text.

    A text that an engine fails on gives a row with the error and no ratio.
    """
    folded = rule_list(rules, config)
    names = ["semantic", "hybrid", "extreme"]

    @F.pandas_udf("array<struct<engine:string,out:string,seconds:double,error:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import time

        engine = _kernel(config, folded)

        def one(name, text):
            began = time.perf_counter()
            try:
                out = engine.hybrid(text)[0] if name == "hybrid" else getattr(engine, name)(text)
            except Exception as e:  # noqa: BLE001  reported in the row
                return name, None, time.perf_counter() - began, f"{type(e).__name__}: {e}"
            return name, out, time.perf_counter() - began, None

        for texts in batches:
            yield pd.Series([[dict(zip(("engine", "out", "seconds", "error"), one(n, t or ""))) for n in names] for t in texts], dtype=object)

    now = docs.withColumn("_made", run("text")).select("doc_id", "text", F.inline("_made"))
    r = F.when(F.col("error").isNull(), q.ratio("text", "out"))
    now = now.select("doc_id", "engine", r.alias("compression_ratio"), "seconds", "error")
    now = now.withColumn("quality_score", q.final(F.col("compression_ratio"), config.target_compression, F.lit(None).cast("double")))
    return now.withColumn("score", (1 - F.col("compression_ratio")) * 0.6 + F.col("quality_score") / 10 * 0.4)


def best_engines(compared: DataFrame) -> DataFrame:
    return compared.groupBy("doc_id").agg(F.max_by("engine", F.struct(F.round("score", 9), "engine")).alias("best_engine"))


def benchmark(compared: DataFrame) -> DataFrame:
    """Per engine the texts that went well, those that failed, and the means of ratio and seconds."""
    ok = F.col("error").isNull()
    return compared.groupBy("engine").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), (F.count_if(ok) / F.count("*")).alias("success_rate"), F.avg("compression_ratio").alias("avg_ratio"), F.avg("seconds").alias("avg_seconds"))


#: rules that the advanced engine takes: of a domain, and general ones
ADVANCED_RULES = (1000, 500)


def advanced_rules(rules: list[dict], domain: str | None) -> list[dict]:
    """A domain's rules first, then general ones that aren't among them; without a domain all, as many as both."""
    most, general = ADVANCED_RULES
    if not domain:
        return rules[: most + general]
    own = [r for r in rules if r["domain"] == domain][:most]
    return own + [r for r in rules if r["domain"] == "general" and domain != "general"][:general]


def advanced(docs: DataFrame, rules: list[dict], config: EngineConfig) -> DataFrame:
    """Domain and general rules; where the composite quality is too low, the most confident four fifths of the matches if
    their simple score is higher; where that is too low as well, the safest rules alone.
    """
    own = advanced_rules(rules, config.domain)

    @F.pandas_udf("full string, part string, safe string, sure double, sure_part double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        engine = _kernel(config, own)
        for texts in batches:
            made = [(None,) * 5 if t is None else engine.candidates(t) for t in texts]
            out = pd.DataFrame(made, columns=["full", "part", "safe", "sure", "sure_part"], dtype=object)
            yield out.astype({"sure": "float64", "sure_part": "float64"})

    cols = docs.columns
    now = docs.withColumn("_made", run("text")).select(*cols, *[F.col(f"_made.{c}").alias(f"_{c}") for c in ("full", "part", "safe", "sure", "sure_part")])
    now = scored(now, "_full").withColumn("_quality", q.composite({k: F.col(f"_q.{k}") for k in q.WEIGHTS})).drop("_q")
    now = now.withColumn("_second", F.when(F.col("_sure_part").isNotNull(), q.simple("text", "_part", F.when(F.isnan("_sure_part"), None).otherwise(F.col("_sure_part")))))
    least = q.minimum(F.lit(config.level), config.requires_high_quality)
    low = F.col("_quality") < least
    recovered = low & (F.coalesce("_second", F.lit(-1.0)) > F.col("_quality"))
    reached = F.when(recovered, F.col("_second")).otherwise(F.col("_quality"))
    out = F.when(~low, F.col("_full")).when(reached < least, F.col("_safe")).when(recovered, F.col("_part")).otherwise(F.col("_full"))
    return _result(now.withColumn("_out", rw.basic(out)).select(*cols, "_out"), "_out", "advanced", config)


def scored(rows: DataFrame, out: str, text: str = "text", name: str = "_q") -> DataFrame:
    """rows with a struct of the composite score's parts for a rewritten column.

    What several parts use is bound in columns of its own first, so that no part
    computes it again.
    """
    bound = rows
    for side, x in (("o", text), ("c", out)):
        bound = bound.withColumn(f"_words_{side}", F.lower(x)).withColumn(f"_words_{side}", q.word_list(f"_words_{side}"))
        bound = bound.withColumns({f"_set_{side}": F.array_distinct(f"_words_{side}"), f"_keys_{side}": q.concepts_of(f"_words_{side}"), f"_stops_{side}": q.sentence_lengths(x), f"_names_{side}": q.entities(x)})
    parts = q.components_of(text, out, "_{}_o", "_{}_c")
    return bound.withColumn(name, F.struct(*[v.alias(k) for k, v in parts.items()])).select(*rows.columns, name)


def within_limit(docs: DataFrame, tokens: int) -> DataFrame:
    """The mildest of four rewrites whose token estimate is within the limit, or the strongest."""
    steps = [F.col("text"), rw.clean("text"), rw.drop_modifiers(rw.shorten_phrases("text")), plain_extreme("text")]
    now = docs
    for k, s in enumerate(steps):
        now = now.withColumn(f"_s{k}", s)
    out = F.col(f"_s{len(steps) - 1}")
    used = F.lit(len(steps) - 1)
    for k in reversed(range(len(steps) - 1)):
        fits = tk.estimate(f"_s{k}") <= tokens
        out, used = F.when(fits, F.col(f"_s{k}")).otherwise(out), F.when(fits, k).otherwise(used)
    return now.withColumn("compressed_text", out).withColumn("step", used).drop(*[f"_s{k}" for k in range(len(steps))])


#: name, priority, conditions (kind, value, weight)
STRATEGIES = [("code-safe", 30, [("contains", "```", 1.0), ("longer", "200", 0.3)]), ("long-prompt", 20, [("longer", "2000", 1.0)]), ("default", 10, [("longer", "0", 0.5)])]


def choose_strategy(docs: DataFrame, strategies=STRATEGIES) -> DataFrame:
    """Of each prompt the strategy with the most weight met, higher priority first among equals; a prompt is read once."""
    options = []
    for name, priority, conditions in strategies:
        weight = sum((F.when(F.contains("text", F.lit(v)) if kind == "contains" else F.length("text") > int(v), w).otherwise(0.0) for kind, v, w in conditions), F.lit(0.0))
        options.append(F.struct(weight.alias("weight"), F.lit(priority).alias("priority"), F.lit(name).alias("strategy")))
    return docs.withColumn("strategy", F.array_max(F.array(*options))["strategy"])


def explain_matches(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Every resolved match of every document with its rule and surroundings."""
    return mt.resolved(docs, rules)


# --- variants: rules one after another, as expressions --------------------------------


def _each_rule(x: Column, rules: list[dict]) -> Column:
    """All occurrences of each rule's original replaced, letter case aside, rule by rule."""
    if len(rules) > MAX_FOLDED_RULES:
        raise ValueError(f"over {MAX_FOLDED_RULES} rules to fold")
    for r in rules:
        x = F.regexp_replace(x, f"(?iu){quoted(r['original'])}", replacement(r["compressed"]))
    return x


def variant_confidence(rule: dict, domain: str | None, often: int = 5, strong: bool = True) -> float:
    """The variant engines' confidence in a rule; its success rate counts as .5 where it is 0."""
    sure = (rule["success_rate"] or 0.5) + (0.2 if rule["domain"] == domain else 0.0) + (0.1 if rule["frequency"] > often else 0.0)
    return min(1.0, sure + (0.1 if strong and rule["priority"] > 700 else 0.0))


def _short_word(rule: dict, over: int) -> bool:
    return any(len(w) <= 2 for w in rule["compressed"].split()) and len(rule["original"].split()) > over


def variant_rules(rules: list[dict], config: EngineConfig, least: float = 0.0) -> list[dict]:
    """A domain's active rules by priority, success rate and frequency, without those whose original is to be preserved."""
    import re

    code = re.compile(r"[{}();]|\w\.\w|^\w+\(")
    own = [r for r in rules if (not config.domain or r["domain"] == config.domain) and r["success_rate"] >= least]
    kept = lambda o: (config.preserve_code and code.search(o)) or (config.preserve_urls and re.match("https?://", o)) or (config.preserve_numbers and re.fullmatch(r"[0-9]+(\.[0-9]+)?", o))
    return sorted((r for r in own if not kept(r["original"])), key=lambda r: (-r["priority"], -r["success_rate"], -r["frequency"], r["id"]))


#: rules that the variant of the semantic engine takes
VARIANT_RULES = 50


def variant_semantic(docs: DataFrame, rules: list[dict], config: EngineConfig, similar: list[dict] = ()) -> DataFrame:
    """The first rules with a confidence of .8 and no short word for several; then similar rules (see vectors.search_rules) with a confidence over .9, once each."""
    own = variant_rules(rules, config)[:VARIANT_RULES]
    used = [r for r in own if variant_confidence(r, config.domain, often=10, strong=False) >= 0.8 and not _short_word(r, 1)]
    x = _each_rule(F.col("text"), used)
    for r in similar:
        if r["confidence"] > 0.9:
            x = rw.replace_first(x, F.lit(r["original"]), F.lit(r["compressed"]))
    return _result(docs.withColumn("_out", x), "_out", "semantic", config)


def variant_extreme_text(x: Column, rules: list[dict], config: EngineConfig) -> Column:
    """All rules, those that save most first; then structure, words, symbols and punctuation."""
    own = sorted(variant_rules(rules, config), key=lambda r: len(r["compressed"]) - len(r["original"]))
    return rw.tight_punctuation(rw.symbols(rw.variant_words(rw.structural(_each_rule(x, own)))))


def variant_extreme(docs: DataFrame, rules: list[dict], config: EngineConfig) -> DataFrame:
    return _result(docs.withColumn("_out", variant_extreme_text(F.col("text"), rules, config)), "_out", "extreme", config)


def rolled_back(text: Column, final: Column, stages: list[Column]) -> Column:
    """The final text, or if less than a fifth is left the first stage that leaves three tenths."""
    out = final
    for s in reversed(stages):
        out = F.when(q.ratio(text, s) >= 0.3, s).otherwise(out)
    return F.when(q.ratio(text, final) < 0.2, out).otherwise(final)


def variant_hybrid(docs: DataFrame, rules: list[dict], config: EngineConfig, similar: list[dict] = ()) -> DataFrame:
    """Rules that succeed often, similar rules with a confidence over .85, selective rewrites, and rollback; adds rolled_back."""
    least = 0.7 if config.requires_high_quality else 0.5
    used = [r for r in variant_rules(rules, config, 0.8) if variant_confidence(r, config.domain) >= least and not (config.requires_high_quality and _short_word(r, 2))]
    now = docs.withColumn("_first", _each_rule(F.col("text"), used))
    now = now.withColumn("_second", _each_rule(F.col("_first"), [r for r in similar if r["confidence"] > 0.85]))
    now = now.withColumn("_third", rw.selective("_second", config.level))
    now = now.withColumn("_out", rolled_back(F.col("text"), F.col("_third"), [F.col(c) for c in ("_first", "_second", "_third")]))
    now = now.withColumn("rolled_back", F.col("_out") != F.col("_third"))
    return _result(now.drop("_first", "_second", "_third"), "_out", "hybrid", config)
