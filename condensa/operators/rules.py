"""The rule table: scans, filters, orders, statistics, conflicts and changes. Every function takes and gives DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lx
from .. import schemas
from ..functions.text import any_sub, toks

KEY = ["original", "language", "domain", "version"]


def starter_rules(spark: SparkSession, rules=lx.RULES) -> DataFrame:
    """The library's own rules in the full rule schema."""
    rows = [(i, o, c, t, p, "en", d, f, s, 1, True, None, None, None, None) for i, o, c, t, p, d, f, s in rules]
    return spark.createDataFrame(rows, schemas.RULES)


def effective_priority() -> Column:
    return F.col("priority") * 0.7 + F.col("success_rate") * 300 * 0.3


def scan(rules: DataFrame, domain: str | None = None, pattern_type: str | None = None, language: str | None = None, min_success: float | None = None, limit: int | None = None) -> DataFrame:
    """Active rules by optional equality filters (a domain is exact), by effective priority."""
    out = rules.where("is_active")
    for name, value in (("domain", domain), ("pattern_type", pattern_type), ("language", language)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if min_success is not None:
        out = out.where(F.col("success_rate") >= min_success)
    out = out.withColumn("effective_priority", effective_priority()).orderBy(F.desc("effective_priority"), F.desc("frequency"), "id")
    return out.limit(limit) if limit else out


def by_id(rules: DataFrame, rule_id: int) -> DataFrame:
    return rules.where(F.col("id") == rule_id)


def search(rules: DataFrame, text: str, limit: int = 20, in_domain: bool = False) -> DataFrame:
    like = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.col("original").ilike(like) | F.col("compressed").ilike(like)
    if in_domain:
        hit = hit | F.col("domain").ilike(like)
    return rules.where(F.col("is_active") & hit).orderBy(F.desc("priority"), F.desc("frequency"), "id").limit(limit)


def ranked(rules: DataFrame, by: str = "priority", limit: int = 20) -> DataFrame:
    return rules.orderBy(F.desc(by), "id").limit(limit)


# --- predicates ----------------------------------------------------------------


def looks_like_code(x, marks=lx.CODE_MARKS) -> Column:
    return any_sub(x, marks)


def looks_like_url(x, marks=lx.URL_MARKS) -> Column:
    return any_sub(x, marks)


def preserved(x) -> Column:
    """Text that should stay: code, URLs, decimals and long numbers."""
    return looks_like_code(x) | looks_like_url(x) | F.col(x).rlike(r"[0-9]+\.[0-9]+|[0-9]{4,}")


def preserved_match(x) -> Column:
    return looks_like_code(x) | F.col(x).rlike("^https?://") | F.col(x).rlike("^[0-9]+$")


def suitable(domain: str | None = None, language: str = "en", code: bool = True, urls: bool = False, numbers: bool = False) -> Column:
    """Rules for a context: general or its domain, its language, and no original that must be preserved."""
    ok = F.col("language") == language
    if domain:
        ok = ok & F.col("domain").isin("general", domain)
    if code:
        ok = ok & ~looks_like_code("original")
    if urls:
        ok = ok & ~looks_like_url("original")
    if numbers:
        ok = ok & ~F.col("original").rlike("^[0-9]+$")
    return ok


def semantic_rules(rules: DataFrame) -> DataFrame:
    return rules.where((F.col("success_rate") >= 0.8) | (F.col("priority") >= 800)).orderBy(F.desc(F.col("success_rate") * 0.6 + F.col("priority") / 1000 * 0.4), "id")


def conservative_rules(rules: DataFrame, priority: int = 900, success: float = 0.95) -> DataFrame:
    return rules.where((F.col("priority") >= priority) & (F.col("success_rate") >= success))


def band(rules: DataFrame, low: int, high: int) -> DataFrame:
    return rules.where(F.col("priority").between(low, high))


BANDS = lx.BANDS


def reversible() -> Column:
    """No output word of two characters or fewer, and none of the characters & 2 4."""
    return F.forall(toks("compressed"), lambda w: F.length(w) > 2) & ~F.col("compressed").rlike("[&24]")


def valid_text(x, most: int = 100_000) -> Column:
    return F.col(x).isNotNull() & (F.regexp_replace(x, r"\s", "") != "") & (F.length(x) <= most)


def split_valid(docs: DataFrame, text: str = "text", most: int = 100_000, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with a reason; strict raises at the first rejected row."""
    ok = F.coalesce(valid_text(text, most), F.lit(False))
    if strict:
        return docs.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a text is blank or too long")).cast("boolean"))), docs.limit(0)
    reason = F.when(F.length(text) > most, "too long").otherwise("blank")
    return docs.where(ok), docs.where(~ok).withColumn("reason", reason)


def valid_match(high_quality: bool = False) -> Column:
    short_word = F.exists(toks("compressed_text"), lambda w: F.length(w) <= 2)
    if not high_quality:
        return F.col("confidence") >= 0.5
    return (F.col("confidence") >= 0.7) & ~(short_word & (F.size(toks("original_text")) > 2))


def valid_semantic_match() -> Column:
    return (F.col("confidence") >= 0.8) & ~(F.exists(toks("compressed_text"), lambda w: F.length(w) <= 2) & (F.size(toks("original_text")) > 1))


def can_handle(engine: str, level: Column, high_quality: Column) -> Column:
    return (level == "aggressive") & ~high_quality if engine == "extreme" else level != "none"


# --- statistics and conflicts ----------------------------------------------------


def statistics(rules: DataFrame) -> DataFrame:
    """Counts overall, by domain and by type, in one pass over grouping sets."""
    active = rules.where("is_active")
    return (
        active.groupingSets([[], ["domain"], ["pattern_type"]], "domain", "pattern_type")
        .agg(F.count("*").alias("rules"), F.avg(F.when(F.col("frequency") > 0, F.col("success_rate"))).alias("avg_success"))
        .select(F.coalesce(F.col("domain"), F.lit("*")).alias("domain"), F.coalesce(F.col("pattern_type"), F.lit("*")).alias("pattern_type"), "rules", "avg_success")
    )


def top_used(rules: DataFrame, k: int = 10) -> DataFrame:
    return rules.where("is_active").orderBy(F.desc("frequency"), "id").limit(k)


def contained(rules: DataFrame) -> DataFrame:
    """(id, inner): rules whose original contains another rule's, letter case aside; one automaton pass over the originals."""
    from . import matching as mt

    anywhere = rules.withColumn("pattern_type", F.lit("phrase"))
    found = mt.find(rules.select(F.col("id").alias("doc_id"), F.col("original").alias("text")), anywhere)
    return found.select(F.col("doc_id").alias("id"), F.col("id").alias("inner")).where("id <> inner").distinct()


def conflicts(rules: DataFrame) -> DataFrame:
    """Pairs of rules in conflict, the first kind that holds: circular, ambiguous, substring, collision. No kind compares all pairs."""
    a, b = (rules.select(*[F.col(c).alias(f"{c}_{n}") for c in ("id", "original", "compressed", "priority")]) for n in (1, 2))
    pair = [F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2")]
    circular = a.join(b, (F.col("original_1") == F.col("compressed_2")) & (F.col("compressed_1") == F.col("original_2")))
    ambiguous = a.join(b, F.lower("original_1") == F.lower("original_2"))
    collision = a.join(b, F.lower("compressed_1") == F.lower("compressed_2"))
    substring = contained(rules).select(F.col("id").alias("id_1"), F.col("inner").alias("id_2"))
    kinds = ("circular", "ambiguous", "substring", "collision")
    out = None
    for k, rows in enumerate((circular, ambiguous, substring, collision)):
        one = rows.where("id_1 <> id_2").select(*pair, F.lit(k).alias("rank"))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy("id_1", "id_2").agg(F.min("rank").alias("rank"))
    top = [rules.select(F.col("id").alias(f"id_{n}"), F.col("priority").alias(f"priority_{n}")) for n in (1, 2)]
    found = first.join(top[0], "id_1").join(top[1], "id_2").withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), F.col("rank") + 1))
    base = F.when(F.col("kind") == "circular", "critical").when(F.col("kind") == "ambiguous", "high").otherwise("medium")
    severity = F.when((base == "medium") & (F.greatest("priority_1", "priority_2") > 800), "high").otherwise(base)
    advice = F.create_map(*map(F.lit, ["circular", "drop one of the two rules", "ambiguous", "keep the rule with the higher priority", "substring", "apply the longer rule first", "collision", "give each rule its own short form"]))
    return found.select("id_1", "id_2", "kind", severity.alias("severity"), advice[F.col("kind")].alias("suggestion"))


def cross_domain(rules: DataFrame, least: float = 0.8) -> DataFrame:
    """Rules of separate domains whose originals have nearly the same words; only rules with a word in common are compared."""
    from ..functions.text import ltoks, word_jaccard

    words = rules.select("id", "original", "domain", F.explode(F.array_distinct(ltoks("original"))).alias("word"))
    a, b = (words.select("word", *[F.col(c).alias(f"{c}_{n}") for c in ("id", "original", "domain")]) for n in (1, 2))
    pairs = a.join(b, "word").where((F.col("id_1") < F.col("id_2")) & (F.col("domain_1") != F.col("domain_2")))
    return pairs.select("id_1", "id_2", "original_1", "original_2").distinct().where(word_jaccard("original_1", "original_2") > least).select("id_1", "id_2")


def with_rules(facts: DataFrame, rules: DataFrame, key: str = "pattern_id") -> DataFrame:
    """Facts about rules (usage, versions, conflicts by first_id or second_id) with the rule's own columns."""
    return facts.join(rules.select(F.col("id").alias(key), "original", "compressed", "pattern_type", "domain", "priority"), key)


def variant_confidence(domain: str | None, often: int = 5, strong: bool = True) -> Column:
    """The variant engines' confidence in a rule; a success rate of 0 counts as .5."""
    sure = F.when(F.col("success_rate") == 0, 0.5).otherwise(F.col("success_rate")) + F.when(F.col("domain") == domain if domain else F.lit(False), 0.2).otherwise(0.0) + F.when(F.col("frequency") > often, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), sure + (F.when(F.col("priority") > 700, 0.1).otherwise(0.0) if strong else F.lit(0.0)))


def validated(rules: DataFrame, domain: str | None, limit_domain: int = 1000, limit_general: int = 500) -> DataFrame:
    """A domain's rules and general ones that aren't among them, the best of each."""
    order = [F.desc("priority"), F.desc("frequency"), "id"]
    own = rules.where(F.col("domain") == domain).orderBy(*order).limit(limit_domain)
    return own.unionByName(rules.where(F.col("domain") == "general").orderBy(*order).limit(limit_general)).dropDuplicates(["id"])


# --- changes: each gives the new table ---------------------------------------------


def insertable(new: DataFrame, rules: DataFrame, same_domain: bool = False) -> DataFrame:
    """New rules whose short form is no original, and whose original has no other short form."""
    own = rules.select(F.col("original").alias("_o"), F.col("compressed").alias("_c"), F.col("domain").alias("_d"))
    where = (F.col("domain") == F.col("_d")) if same_domain else F.lit(True)
    free = new.join(own, (F.col("compressed") == F.col("_o")) & where, "left_anti")
    return free.join(own, (F.col("original") == F.col("_o")) & where, "left_anti")


def add(rules: DataFrame, new: DataFrame) -> DataFrame:
    return rules.unionByName(insertable(new, rules).dropDuplicates(KEY), allowMissingColumns=True)


def bulk_add(rules: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new table, and the rows that were added (insert or ignore, by key)."""
    added = new.dropDuplicates(KEY).join(rules.select(*KEY), KEY, "left_anti").select(*new.columns)
    return rules.unionByName(added, allowMissingColumns=True), added


def delete(rules: DataFrame, rule_id: int) -> DataFrame:
    return rules.where(F.col("id") != rule_id)


def record_usage(rules: DataFrame, usage: DataFrame, update_success: bool = False) -> DataFrame:
    """Frequencies plus the uses per pattern_id; on request success rates as running means of the success flags."""
    used = usage.groupBy("pattern_id").agg(F.count("*").alias("_n"), F.sum(F.col("success").cast("double")).alias("_ok"))
    out = rules.join(used, F.col("id") == F.col("pattern_id"), "left")
    n = F.coalesce("_n", F.lit(0))
    rate = (F.col("success_rate") * F.col("frequency") + F.coalesce("_ok", F.lit(0.0))) / F.nullif(F.col("frequency") + n, F.lit(0))
    out = out.withColumn("_rate", F.coalesce(rate, "success_rate")).withColumn("frequency", (F.col("frequency") + n).cast("int"))
    if update_success:
        out = out.withColumn("success_rate", F.col("_rate"))
    return out.select(*rules.columns)


def feedback(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Ratings from 1 to 5 of sessions that exist."""
    return rows.where(F.col("rating").between(1, 5)).join(sessions.select("session_id"), "session_id", "left_semi")


def latest_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("pattern_id").agg(F.max_by(F.struct("version", "original", "compressed"), F.col("version")).alias("v")).select("pattern_id", "v.*")
