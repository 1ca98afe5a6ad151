"""More queries of the library's operators, each with its SQL: rules and their changes, rewrites and variants, quality, similarity, profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..config import EngineConfig
from ..functions import profile as pr
from ..functions import quality as q
from ..functions import rewrite as rw
from ..functions import segment as sg
from ..functions import similarity as sm
from ..functions import tokens as tk
from ..functions.text import word_jaccard
from ..operators import engines as en
from ..operators import matching as mt
from ..operators import metrics as me
from ..operators import rules as rl
from ..operators import vectors as ve
from .catalogue import (
    BASE, RULE_VALUES, S_COMPLEXITY, S_ANALYZER, S_DENSITY, S_ESTIMATE, S_EXTREME, S_FORMAL, S_MATCHES, S_METRICS, S_PHRASE_RED, S_POTENTIAL, S_READING, S_SCORES, S_SENSITIVITY, S_SPLICED, S_VERBOSE, S_WORDS,
    _rounded, _s_content, docs, metrics_table, r6, s_any, s_avg_words, s_count, s_fold, s_grams, s_in, s_jaccard, s_list, s_nocc, s_nsub, s_pad, s_resolved, s_sentences, s_share, s_sum, s_toks, s_trim, s_unpad, spread, table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


# --- rules ------------------------------------------------------------------------------

#: rules that a context must keep out, beside the starter rules
PROBES = [(201, "call();", "c", "word", 950, "general", 1, 0.99), (202, "http://a.example", "u", "word", 700, "general", 0, 0.1), (203, "123456", "n", "word", 500, "general", 3, 0.5), (204, "rate 3.14", "pi", "phrase", 910, "business", 2, 0.96), (205, "</div>", "d", "word", 100, "support", 0, 0.0)]
RULES_AND_PROBES = [*lx.RULES, *PROBES]
V_RULES = "(VALUES " + ", ".join(f"({i}, '{o}', '{c}', '{t}', {p}, '{d}', {f}, {s}::DOUBLE)" for i, o, c, t, p, d, f, s in RULES_AND_PROBES) + ") r(id, original, compressed, pattern_type, priority, domain, frequency, success_rate)"
S_CODE, S_URL = s_any("lower(original)", lx.CODE_MARKS), s_any("lower(original)", lx.URL_MARKS)


@query(
    f"""SELECT id, NOT {S_CODE} AND domain IN ('general', 'business') AS suitable, NOT {S_CODE} AND NOT {S_URL} AS compressor, NOT {S_CODE} AND NOT {S_URL} AND NOT regexp_matches(original, '^[0-9]+$') AS candidate,
    {S_CODE} AS code, {S_URL} AS url, {S_CODE} OR {S_URL} OR regexp_matches(original, '[0-9]+\\.[0-9]+|[0-9]{{4,}}') AS preserved, {S_CODE} OR regexp_matches(original, '^https?://') OR regexp_matches(original, '^[0-9]+$') AS preserved_match,
    success_rate >= 0.8 OR priority >= 800 AS semantic, priority >= 900 AND success_rate >= 0.95 AS conservative, priority >= 800 AND success_rate >= 0.8 AS safe,
    round(least(1e0, CASE WHEN success_rate = 0 THEN 0.5e0 ELSE success_rate END + CASE WHEN domain = 'business' THEN 0.2e0 ELSE 0e0 END + CASE WHEN frequency > 5 THEN 0.1e0 ELSE 0e0 END + CASE WHEN priority > 700 THEN 0.1e0 ELSE 0e0 END), 6) AS variant_confidence FROM {V_RULES}"""
)
def rule_predicates(spark, sf_dir):
    rules = rl.starter_rules(spark, RULES_AND_PROBES)
    ids = lambda rows, name: rows.select("id", F.lit(True).alias(name))
    out = rules.select("id", rl.suitable("business").alias("suitable"), rl.suitable(urls=True).alias("compressor"), rl.suitable(urls=True, numbers=True).alias("candidate"), rl.looks_like_code("original").alias("code"), rl.looks_like_url("original").alias("url"),
                       rl.preserved("original").alias("preserved"), rl.preserved_match("original").alias("preserved_match"), r6(rl.variant_confidence("business")).alias("variant_confidence"))
    for name, rows in {"semantic": rl.semantic_rules(rules), "conservative": rl.conservative_rules(rules), "safe": rl.conservative_rules(rules, 800, 0.8)}.items():
        out = out.join(ids(rows, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@query(
    f"""SELECT 'scan' AS kind, id FROM (SELECT id FROM {RULE_VALUES} WHERE success_rate >= 0.9 ORDER BY priority * 0.7e0 + success_rate * 90 DESC, frequency DESC, id LIMIT 4)
    UNION ALL SELECT 'typed', id FROM {RULE_VALUES} WHERE pattern_type = 'word' AND domain = 'general' UNION ALL SELECT 'by_id', id FROM {RULE_VALUES} WHERE id = 5
    UNION ALL SELECT 'ranked', id FROM (SELECT id FROM {RULE_VALUES} ORDER BY success_rate DESC, id LIMIT 3) UNION ALL SELECT 'used', id FROM (SELECT id FROM {RULE_VALUES} ORDER BY frequency DESC, id LIMIT 5)
    UNION ALL SELECT 'search', id FROM (SELECT id FROM {RULE_VALUES} WHERE original ILIKE '%busi%' OR compressed ILIKE '%busi%' OR domain ILIKE '%busi%' ORDER BY priority DESC, frequency DESC, id LIMIT 20)
    UNION ALL SELECT 'advanced', id FROM {RULE_VALUES} WHERE domain IN ('logistics', 'general')"""
)
def rule_lookup(spark, sf_dir):
    rules = rl.starter_rules(spark)
    parts = {"scan": rl.scan(rules, language="en", min_success=0.9, limit=4), "typed": rl.scan(rules, "general", "word"), "by_id": rl.by_id(rules, 5), "ranked": rl.ranked(rules, "success_rate", 3), "used": rl.top_used(rules, 5), "search": rl.search(rules, "busi", in_domain=True), "advanced": rl.validated(rules, "logistics")}
    return union(rows.select(F.lit(kind).alias("kind"), "id") for kind, rows in parts.items())


MORE_RULES = [(301, "shipment", "shpt", "word", 700, "general", 0, 0.0), (302, "order", "o", "word", 700, "general", 0, 0.0), (303, "shipment", "shp", "word", 10, "general", 0, 0.0), (304, "order", "ord", "word", 600, "logistics", 0, 0.0)]


@query(
    f"""WITH r AS (SELECT * FROM {RULE_VALUES}), n(id, original, compressed, domain) AS (VALUES {", ".join(f"({x[0]}, '{x[1]}', '{x[2]}', '{x[5]}')" for x in MORE_RULES)}),
    free AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.original = n.compressed) AND NOT EXISTS (SELECT 1 FROM r WHERE r.original = n.original)),
    same AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.original = n.compressed AND r.domain = n.domain) AND NOT EXISTS (SELECT 1 FROM r WHERE r.original = n.original AND r.domain = n.domain)),
    bulk AS (SELECT DISTINCT original, domain FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.original = n.original AND r.domain = n.domain))
    SELECT 'add' AS change, count(*)::BIGINT AS rules FROM (SELECT original FROM r UNION ALL SELECT DISTINCT original FROM free) UNION ALL SELECT 'same_domain', count(*)::BIGINT FROM same
    UNION ALL SELECT 'bulk', (SELECT count(*) FROM r) + (SELECT count(*) FROM bulk) UNION ALL SELECT 'added', count(*)::BIGINT FROM bulk UNION ALL SELECT 'delete', count(*)::BIGINT FROM r WHERE id <> 4"""
)
def rule_changes(spark, sf_dir):
    """Rules after each kind of change."""
    rules, new = rl.starter_rules(spark), rl.starter_rules(spark, MORE_RULES)
    everything, added = rl.bulk_add(rules, new)
    parts = {"add": rl.add(rules, new), "same_domain": rl.insertable(new, rules, same_domain=True), "bulk": everything, "added": added, "delete": rl.delete(rules, 4)}
    return union(rows.agg(F.count("*").alias("rules")).select(F.lit(change).alias("change"), "rules") for change, rows in parts.items())


@query(
    f"""WITH u AS (SELECT r.id AS pattern_id, doc_id % 3 = 0 AS ok FROM documents JOIN {RULE_VALUES} ON contains(lower(text), lower(original))), g AS (SELECT pattern_id, count(*) AS n, sum(ok::INT) AS good FROM u GROUP BY pattern_id)
    SELECT id, (frequency + coalesce(n, 0))::INT AS frequency, round(coalesce((success_rate * frequency + coalesce(good, 0)) / nullif(frequency + coalesce(n, 0), 0), success_rate), 6) AS success_rate FROM {RULE_VALUES} LEFT JOIN g ON id = pattern_id"""
)
def rule_usage(spark, sf_dir):
    """Frequencies and running success rates after a use for each document that a rule occurs in."""
    rules = rl.starter_rules(spark)
    anywhere = rules.withColumn("pattern_type", F.lit("phrase"))
    used = mt.find(docs(spark, sf_dir), anywhere).select(F.col("id").alias("pattern_id"), "doc_id").distinct()
    out = rl.record_usage(rules, used.withColumn("success", F.col("doc_id") % 3 == 0), update_success=True)
    return out.select("id", "frequency", r6(F.col("success_rate")).alias("success_rate"))


@query("SELECT doc_id, rating FROM (SELECT doc_id, (doc_id % 7)::INT AS rating FROM documents) WHERE rating BETWEEN 1 AND 5 AND doc_id IN (SELECT doc_id FROM labels)")
def feedback_valid(spark, sf_dir):
    """Ratings that count: from 1 to 5, of sessions that exist (here: labelled documents)."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("session_id"), (F.col("doc_id") % 7).cast("int").alias("rating"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"))
    return rl.feedback(rows, known).withColumnRenamed("session_id", "doc_id")


@query(
    """WITH n AS (SELECT vec_id + 500 AS vec_id, label FROM embeddings), u AS (SELECT vec_id, label, 'new' AS made FROM n UNION ALL SELECT vec_id, label, 'old' FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n))
    SELECT vec_id, label, made FROM u WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 3)"""
)
def vector_changes(spark, sf_dir):
    """A collection after an upsert of shifted ids and a delete."""
    old = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit("old").alias("made"))
    new = old.select((F.col("vec_id") + 500).alias("vec_id"), "label", F.lit("new").alias("made"))
    return ve.delete(ve.upsert(old, new), old.where("vec_id % 10 = 3"))


@query(f"WITH c AS (SELECT * FROM (VALUES (4, 13), (6, 8), (3, 4)) c(first_id, second_id)) SELECT first_id, second_id, original, compressed, priority FROM c JOIN {RULE_VALUES} ON id = first_id")
def conflict_rules(spark, sf_dir):
    facts = spark.createDataFrame([(4, 13), (6, 8), (3, 4)], "first_id int, second_id int")
    return rl.with_rules(facts, rl.starter_rules(spark), "first_id").select("first_id", "second_id", "original", "compressed", "priority")


_S_SHORT = f"len(list_filter({s_toks('compressed')}, lambda w: length(w) <= 2)) > 0"


@query(
    f"""WITH {S_MATCHES} SELECT doc_id, id, position, confidence >= 0.5 AS loose, confidence >= 0.7 AND NOT ({_S_SHORT} AND len({s_toks('original_text')}) > 2) AS strict,
    confidence >= 0.8 AND NOT ({_S_SHORT} AND len({s_toks('original_text')}) > 1) AS semantic, md5(substr(text, greatest(0, position - 20) + 1, position + size + 20 - greatest(0, position - 20))) AS context FROM m"""
)
def match_validity(spark, sf_dir):
    found = mt.find(docs(spark, sf_dir), rl.starter_rules(spark))
    return found.select("doc_id", "id", "position", rl.valid_match().alias("loose"), rl.valid_match(True).alias("strict"), rl.valid_semantic_match().alias("semantic"), F.md5("context").alias("context"))


@query(
    f"""WITH {S_MATCHES}, a AS (SELECT *, coalesce(position >= lag(position + size) OVER w, true) AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY position, priority DESC, id)),
    g AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY position, priority DESC, id ROWS UNBOUNDED PRECEDING) AS grp FROM a),
    s AS (SELECT g.*, strategy, CASE strategy WHEN 'priority' THEN priority::DOUBLE WHEN 'length' THEN size::DOUBLE ELSE confidence END AS score FROM g, (VALUES ('priority'), ('length'), ('confidence')) t(strategy)),
    b AS (SELECT *, row_number() OVER (PARTITION BY strategy, doc_id, grp ORDER BY round(score, 9) DESC, position, priority DESC, id) AS rk FROM s)
    SELECT strategy, doc_id, grp::BIGINT AS "group", id, position FROM b WHERE rk = 1"""
)
def overlap_strategies(spark, sf_dir):
    found = mt.find(docs(spark, sf_dir), rl.starter_rules(spark))
    return union(mt.best_of_groups(found, s).select(F.lit(s).alias("strategy"), "doc_id", "group", "id", "position") for s in ("priority", "length", "confidence"))


@query(f"SELECT doc_id, CASE WHEN {s_trim('text')} = '' THEN 'blank' WHEN length(text) > 3000 THEN 'too long' ELSE 'accepted' END AS verdict FROM documents")
def text_validity(spark, sf_dir):
    accepted, rejected = rl.split_valid(docs(spark, sf_dir), most=3000)
    return accepted.select("doc_id", F.lit("accepted").alias("verdict")).unionByName(rejected.select("doc_id", F.col("reason").alias("verdict")))


_S_SCORE = "CASE strategy WHEN 'length' THEN %s.size::DOUBLE WHEN 'confidence' THEN round(%s.confidence, 9) ELSE (length(%s.original_text) - length(%s.compressed))::DOUBLE END"
_S_RANK = lambda m: f"row({_S_SCORE.replace('%s', m)}, {m}.priority, {m}.size, -{m}.id, -{m}.position)"


@query(
    f"""WITH {S_MATCHES} SELECT strategy, x.doc_id, x.id, x.position FROM m x, (VALUES ('length'), ('confidence'), ('compression')) t(strategy)
    WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = x.doc_id AND o.position < x.position + x.size AND x.position < o.position + o.size AND {_S_RANK('o')} > {_S_RANK('x')})"""
)
def pairwise_strategies(spark, sf_dir):
    found = mt.find(docs(spark, sf_dir), rl.starter_rules(spark))
    return union(mt.pairwise_elimination(found, s).select(F.lit(s).alias("strategy"), "doc_id", "id", "position") for s in ("length", "confidence", "compression"))


@query(
    f"""WITH {S_MATCHES}, r AS {s_resolved()}, v AS (SELECT doc_id, list_avg(list_transform(t, lambda x: x.c)) AS sure, length({S_SPLICED})::DOUBLE / length(text) AS r FROM r)
    SELECT doc_id, round(10 * (0.4e0 * (1 - abs(r - 0.6e0)) + 0.3e0 * sure + 0.2e0 * CASE WHEN r > 0.2e0 THEN 1e0 ELSE 5 * r END + 0.1e0 * 0.5e0), 6) AS quality FROM v"""
)
def final_quality(spark, sf_dir):
    """The final score of texts with their resolved matches applied: mean confidence, ratio, and a time score of its least."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    m = mt.resolved(d, rl.starter_rules(spark)).groupBy("doc_id").agg(F.avg("confidence").alias("sure"), F.sum(F.length("compressed_text") - F.length("original_text")).alias("more"))
    r = (F.length("text") + F.col("more")) / F.length("text")
    return d.join(m, "doc_id").select("doc_id", r6(q.final(r, 0.6, F.col("sure"), time_score=0.0)).alias("quality"))


# --- tokens and formats ----------------------------------------------------------------------

_S_WE = lambda x: f"CASE WHEN len({s_toks(x)}) = 0 THEN 0 ELSE greatest(1, floor(len({s_toks(x)}) * 1.3e0))::BIGINT END"


@query(
    S_EXTREME
    + f""", e AS (SELECT doc_id, length(text) AS lo, length(c) AS lc, {_S_WE('text')} AS o, {_S_WE('c')} AS k FROM out)
    SELECT doc_id, o::BIGINT AS original_tokens, k::BIGINT AS compressed_tokens, (o - k)::BIGINT AS token_savings, round(CASE WHEN o = 0 THEN 1e0 ELSE {s_share('k', 'o')} END, 6) AS compression_ratio, round(CASE WHEN o = 0 THEN 0e0 ELSE (1 - {s_share('k', 'o')}) * 100 END, 6) AS savings_percentage,
    round({s_share('lo - lc', 'lo')}, 6) AS character_ratio, round(CASE WHEN o > 0 AND lo > lc THEN {s_share('o - k', 'lo - lc')} ELSE 0e0 END, 6) AS efficiency_ratio FROM e"""
)
def token_efficiency(spark, sf_dir):
    rewritten = docs(spark, sf_dir).withColumn("c", en.plain_extreme("text"))
    return _rounded(rewritten.select("doc_id", tk.efficiency("text", "c").alias("e")).select("doc_id", "e.*"))


@query(
    BASE
    + f"""SELECT doc_id, {S_ESTIMATE} AS chars, {S_WORDS} AS words, CASE WHEN lang = 'en' THEN 'abbreviate' WHEN lang = 'de' THEN 'keep structure, shorten phrases' ELSE 'balanced' END AS strategy,
    list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(source || ':' || lang, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::BIGINT AS cache_key FROM d"""
)
def model_comparison(spark, sf_dir):
    """Estimates by several models, the advice for a model's name, and the cache key of each document's group."""
    model = F.when(F.col("lang") == "en", "small-1").when(F.col("lang") == "de", "large-2").otherwise("other")
    out = docs(spark, sf_dir).select("doc_id", tk.compare_models("text").alias("m"), tk.strategy(model).alias("strategy"), tk.string_hash(F.concat("source", F.lit(":"), "lang")).alias("cache_key"))
    return out.select("doc_id", F.col("m")["chars"].alias("chars"), F.col("m")["words"].alias("words"), "strategy", "cache_key")


@query(
    """WITH v AS (SELECT doc_id, n_chars::DOUBLE * 40013.7137e0 * (doc_id % 3 + 1) AS b, n_chars::DOUBLE * 30.0137e0 AS ms FROM documents)
    SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d B', b::BIGINT) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.1f GB', b / 1073741824) END AS bytes,
    CASE WHEN ms < 1000 THEN printf('%dms', ms::BIGINT) WHEN ms < 60000 THEN printf('%.1fs', (ms / 1000)) ELSE printf('%.1fm', (ms / 60000)) END AS duration,
    CASE WHEN b < 1000 THEN printf('%d', b::BIGINT) WHEN b < 1e6 THEN printf('%.1fK', b / 1e3) WHEN b < 1e9 THEN printf('%.1fM', b / 1e6) ELSE printf('%.1fB', b / 1e9) END AS number FROM v"""
)
def format_values(spark, sf_dir):
    # factors that keep values away from halves of the last place, which the two engines round in different ways
    v = docs(spark, sf_dir).select("doc_id", (F.col("n_chars").cast("double") * 40013.7137 * (F.col("doc_id") % 3 + 1)).alias("b"), (F.col("n_chars").cast("double") * 30.0137).alias("ms"))
    return v.select("doc_id", tk.bytes_text(F.col("b")).alias("bytes"), tk.duration_text(F.col("ms")).alias("duration"), tk.number_text(F.col("b")).alias("number"))


# --- rewrites ------------------------------------------------------------------------------------


def s_rules(x: str, rules) -> str:
    """All occurrences of each original replaced, letter case aside, rule by rule."""
    for r in rules:
        x = f"regexp_replace({x}, '(?i){r['original']}', '" + r["compressed"].replace("'", "''") + "', 'g')"
    return x


def s_structural(x: str) -> str:
    x = s_fold(rf"regexp_replace({x}, '(?i)\b(?:the|a|an)\b\s+', '', 'g')", lx.VARIANT_PHRASES)
    for a, b in lx.OPENERS:
        x = rf"regexp_replace({x}, '(?i)\b{a},\s*', '{b}', 'g')"
    return x


S_TIGHT = r"trim(regexp_replace(regexp_replace(regexp_replace(%s, '\s+', ' ', 'g'), '\s*([.!?])\s*', '\1 ', 'g'), '\s*,\s*', ',', 'g'))"
S_CLEAN = r"translate(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.{2,}', '...', 'g'), '!{2,}', '!', 'g'), '\?{2,}', '?', 'g'), '“”‘’', chr(34) || chr(34) || chr(39) || chr(39))"


def s_selective(x: str) -> str:
    return rf"trim(regexp_replace({s_unpad(s_fold(s_fold(s_pad(x), lx.SELECTIVE), lx.SELECTIVE_PHRASES))}, '\s+', ' ', 'g'))"


@query(
    rf"""SELECT doc_id, md5({S_CLEAN}) AS clean, md5({s_trim("replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), '  '), chr(160), ' ')")}) AS normal, md5({s_unpad(s_structural(s_pad('text')))}) AS structural,
    md5({s_unpad(s_fold(s_pad('text'), lx.VARIANT_WORDS))}) AS words, md5({s_unpad(s_fold(s_pad('text'), lx.VARIANT_SYMBOLS))}) AS symbols, md5(CASE WHEN n_chars > 1000 THEN {s_selective('text')} ELSE text END) AS selective,
    md5(CASE WHEN position('the' IN text) = 0 THEN text ELSE left(text, position('the' IN text) - 1) || 't' || substr(text, position('the' IN text) + 3) END) AS first_only,
    array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches({s_pad('text')}, '(?i)" + chr(92) + f"b{w}" + chr(92) + f"b') THEN '{w}' END" for w, _ in [*lx.ABBREVIATIONS, *lx.SYMBOLS])}], lambda w: w IS NOT NULL), ',') AS applied,
    md5(replace(replace(text, 'payment', 'pmt'), 'invoice', 'inv')) AS literals FROM documents"""
)
def text_rewrites(spark, sf_dir):
    level = F.when(F.col("n_chars") > 1000, "balanced").otherwise("light")
    out = {"clean": rw.clean("text"), "normal": rw.normalise_text("text"), "structural": rw.structural("text"), "words": rw.variant_words("text"), "symbols": rw.symbols("text"), "selective": rw.selective("text", level), "first_only": rw.replace_first(F.col("text"), F.lit("the"), F.lit("t")), "literals": rw.domain_literals("text", "finance")}
    return docs(spark, sf_dir).select("doc_id", *[F.md5(c).alias(k) for k, c in out.items()], F.array_join(rw.abbreviations_applied("text"), ",").alias("applied"))


def _variant_config() -> EngineConfig:
    return EngineConfig(level="balanced")


def _rules(rules=lx.RULES) -> list[dict]:
    return [dict(zip(("id", "original", "compressed", "pattern_type", "priority", "domain", "frequency", "success_rate"), r)) for r in rules]


_V_ALL = en.variant_rules(_rules(), _variant_config())
_V_SEMANTIC = [r for r in _V_ALL if min(1.0, r["success_rate"] + (0.1 if r["frequency"] > 10 else 0.0)) >= 0.8 and not (any(len(w) <= 2 for w in r["compressed"].split()) and len(r["original"].split()) > 1)]
_V_EXTREME = sorted(_V_ALL, key=lambda r: len(r["compressed"]) - len(r["original"]))
_V_HYBRID = [r for r in _V_ALL if r["success_rate"] >= 0.8]


@query(
    f"""WITH s AS (SELECT doc_id, text, {s_rules('text', _V_SEMANTIC)} AS semantic, {S_TIGHT % s_unpad(s_fold(s_fold(s_structural(s_pad(s_rules('text', _V_EXTREME))), lx.VARIANT_WORDS), lx.VARIANT_SYMBOLS))} AS extreme, {s_rules('text', _V_HYBRID)} AS first FROM documents),
    h AS (SELECT *, {s_selective('first')} AS hybrid FROM s)
    SELECT doc_id, md5(semantic) AS semantic, md5(extreme) AS extreme, md5(hybrid) AS hybrid, round({s_share('length(semantic)', 'length(text)')}, 6) AS semantic_ratio, round({s_share('length(extreme)', 'length(text)')}, 6) AS extreme_ratio, round({s_share('length(hybrid)', 'length(text)')}, 6) AS hybrid_ratio FROM h"""
)
def variant_engines(spark, sf_dir):
    rules = en.rule_list(rl.starter_rules(spark), _variant_config())
    now = docs(spark, sf_dir).select("doc_id", "text")
    for name, engine in (("semantic", en.variant_semantic), ("extreme", en.variant_extreme), ("hybrid", en.variant_hybrid)):
        made = engine(now, rules, _variant_config())
        now = made.select(*now.columns, F.md5("compressed_text").alias(name), r6(F.col("compression_ratio")).alias(f"{name}_ratio"))
    return now.drop("text")


_S_R = lambda x: f"CASE WHEN length(text) = 0 THEN 1e0 ELSE length({x})::DOUBLE / length(text) END"


@query(
    f"""WITH s AS (SELECT doc_id, text, regexp_replace(text, '[aeiou]', '', 'g') AS a, regexp_replace(text, '[a-m]', '', 'g') AS b, regexp_replace(text, '[a-z ]', '', 'g') AS c FROM documents)
    SELECT doc_id, md5(CASE WHEN {_S_R('c')} >= 0.2 THEN c WHEN {_S_R('b')} >= 0.3 THEN b WHEN {_S_R('a')} >= 0.3 THEN a ELSE c END) AS kept, {_S_R('c')} < 0.2 AND ({_S_R('b')} >= 0.3 OR {_S_R('a')} >= 0.3) AS rolled_back FROM s"""
)
def stage_rollback(spark, sf_dir):
    """Stages that leave less and less; a final one of under a fifth goes back to the first that leaves three tenths."""
    s = docs(spark, sf_dir).select("doc_id", "text", *[F.regexp_replace("text", p, "").alias(k) for k, p in (("a", "[aeiou]"), ("b", "[a-m]"), ("c", "[a-z ]"))])
    kept = en.rolled_back(F.col("text"), F.col("c"), [F.col("b"), F.col("a")])
    return s.select("doc_id", F.md5(kept).alias("kept"), (kept != F.col("c")).alias("rolled_back"))


_REVERSIBLE = sorted((r for r in _rules() if all(len(w) > 2 for w in r["compressed"].split()) and not set(r["compressed"]) & set("&24")), key=lambda r: r["id"])


def s_expand(x: str) -> str:
    for r in _REVERSIBLE:
        x = f"replace({x}, '{r['compressed']}', '{r['original']}')"
    return x


@query(f"SELECT doc_id, md5({s_expand('text')}) AS expanded, length({s_expand('text')})::BIGINT AS chars FROM documents")
def decompressed(spark, sf_dir):
    out = en.decompress(docs(spark, sf_dir), rl.starter_rules(spark), "text")
    return out.select("doc_id", F.md5("expanded_text").alias("expanded"), F.length("expanded_text").cast("long").alias("chars"))


_S_L0, _S_L1 = "text", S_CLEAN
_S_MODS = r"regexp_replace(%s, '(?i)\b(?:" + "|".join(lx.MODIFIERS) + r")\b\s+', '', 'g')"


@query(
    S_EXTREME
    + f""", s AS (SELECT doc_id, text, {S_CLEAN} AS s1, {s_unpad(_S_MODS % s_fold(s_pad('text'), lx.PHRASES))} AS s2, c AS s3 FROM out),
    e AS (SELECT *, {S_ESTIMATE} AS e0, {S_ESTIMATE.replace('text', 's1')} AS e1, {S_ESTIMATE.replace('text', 's2')} AS e2, {S_ESTIMATE.replace('text', 's3')} AS e3 FROM s)
    SELECT doc_id, CASE WHEN e0 <= 400 THEN 0 WHEN e1 <= 400 THEN 1 WHEN e2 <= 400 THEN 2 ELSE 3 END::INT AS step, CASE WHEN e0 <= 400 THEN e0 WHEN e1 <= 400 THEN e1 WHEN e2 <= 400 THEN e2 ELSE e3 END::BIGINT AS tokens,
    CASE WHEN e0 <= 400 THEN e0 WHEN e1 <= 400 THEN e1 WHEN e2 <= 400 THEN e2 ELSE e3 END <= 400 AS fits FROM e"""
)
def within_token_limit(spark, sf_dir):
    out = en.within_limit(docs(spark, sf_dir), 400)
    tokens = tk.estimate("compressed_text")
    return out.select("doc_id", "step", tokens.alias("tokens"), (tokens <= 400).alias("fits"))


@query(
    """WITH l AS (SELECT doc_id, text, n_chars, CASE WHEN n_chars % 4 = 0 THEN 'none' WHEN n_chars % 4 = 1 THEN 'light' WHEN n_chars % 4 = 2 THEN 'balanced' ELSE 'aggressive' END AS level, n_chars % 3 = 0 AS high FROM documents)
    SELECT doc_id, CASE level WHEN 'none' THEN 'none' WHEN 'light' THEN 'semantic' WHEN 'balanced' THEN 'hybrid' ELSE 'extreme' END AS engine, CASE level WHEN 'none' THEN 'none' WHEN 'light' THEN 'semantic' WHEN 'balanced' THEN 'hybrid' ELSE CASE WHEN high THEN 'hybrid' ELSE 'extreme' END END AS variant,
    level = 'aggressive' AND NOT high AS extreme_can, level <> 'none' AS others_can, greatest(CASE WHEN n_chars % 5 = 0 THEN 4 WHEN n_chars % 10 < 5 THEN 3 WHEN n_chars % 10 < 7 THEN 2 ELSE 1 END, CASE WHEN level = 'light' THEN 2 ELSE 1 END)::INT AS fallback_level,
    CASE WHEN contains(text, '```') THEN 'code-safe' WHEN length(text) > 2000 THEN 'long-prompt' ELSE 'default' END AS strategy FROM l"""
)
def engine_choice(spark, sf_dir):
    """Which engine, fallback step and strategy rows of mixed levels get."""
    n = F.col("n_chars")
    level = F.when(n % 4 == 0, "none").when(n % 4 == 1, "light").when(n % 4 == 2, "balanced").otherwise("aggressive")
    rows = en.choose_strategy(docs(spark, sf_dir)).withColumn("level", level).withColumn("high", n % 3 == 0)
    lvl, high = F.col("level"), F.col("high")
    advice = en.fallback_advice(lvl, (n % 10).cast("double"), n % 5 == 0)
    return rows.select("doc_id", en.select_engine(lvl).alias("engine"), en.select_engine(lvl, high).alias("variant"), rl.can_handle("extreme", lvl, high).alias("extreme_can"), rl.can_handle("hybrid", lvl, high).alias("others_can"), advice["fallback_level"].alias("fallback_level"), "strategy")


# --- segments and extraction ---------------------------------------------------------------------------

_S_LINES = f"list_filter(string_split(p, chr(10)), lambda s: {s_trim('s')} <> '')"
_S_PART = f"""CASE WHEN len(list_filter({_S_LINES}, lambda s: regexp_matches(s, '^(?: {{4}}|\t)'))) > len({_S_LINES}) * 0.5 OR {s_nsub('lower(p)', lx.CODE_MARKS)} >= 2 THEN 'code'
    WHEN len(list_filter({_S_LINES}, lambda s: regexp_matches(s, '^\\s*(?:[-*•]|[0-9]+\\.)\\s'))) > len({_S_LINES}) * 0.5 THEN 'list'
    WHEN regexp_matches(p, '^#') OR (length(p) < 100 AND ends_with(p, ':')) OR (length(p) < 50 AND p = upper(p) AND p <> lower(p)) THEN 'heading' ELSE 'paragraph' END"""


@query(
    f"""WITH src AS (SELECT 'd' || doc_id AS id, text AS x FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages), s AS (SELECT id, list_filter(list_transform(string_split(x, chr(10) || chr(10)), lambda p: {s_trim('p')}), lambda p: p <> '') AS ps FROM src),
    u AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS idx FROM s) SELECT id, idx::INT AS idx, md5(p) AS digest, {_S_PART} AS kind FROM u"""
)
def headings_lists(spark, sf_dir):
    """Paragraphs of documents and pages with their kind."""
    both = docs(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("x"))
    both = both.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("x")))
    return both.select("id", F.posexplode(sg.structure("x")).alias("idx", "s")).select("id", "idx", F.md5("s.text").alias("digest"), F.col("s.type").alias("kind"))


#: fenced and inline code before each text, as the corpus has none
_FENCE = "use `let x` or\n```py\nz = 1\n```\nthen `y`\n"


@query(
    rf"""WITH x AS (SELECT doc_id, '{_FENCE.replace(chr(10), "' || chr(10) || '")}' || text || chr(10) || '```' || chr(10) || 'end' || chr(10) || '```' AS t FROM documents),
    f AS (SELECT *, regexp_extract_all(t, '```[A-Za-z0-9_+-]*\n(?:[^`]|`[^`]|``[^`])*?```') AS fenced FROM x), g AS (SELECT *, regexp_extract_all(regexp_replace(t, '```[A-Za-z0-9_+-]*\n(?:[^`]|`[^`]|``[^`])*?```', ' ', 'g'), '`[^`\n]+`') AS inline FROM f)
    SELECT doc_id, len(fenced)::BIGINT AS fenced, len(inline)::BIGINT AS inline, array_to_string(list_transform(fenced, lambda b: regexp_extract(b, '^```([A-Za-z0-9_+-]*)', 1)), ',') AS languages, array_to_string(inline, ',') AS code,
    (position(fenced[1] IN t) - 1)::INT AS first_at, (position(inline[1] IN t) - 1)::INT AS inline_at FROM g"""
)
def code_blocks(spark, sf_dir):
    x = docs(spark, sf_dir).select("doc_id", F.concat(F.lit(_FENCE), "text", F.lit("\n```\nend\n```")).alias("t")).select("doc_id", sg.code_blocks("t").alias("b"))
    f, i = F.filter("b", lambda b: b["fenced"]), F.filter("b", lambda b: ~b["fenced"])
    return x.select("doc_id", F.size(f).cast("long").alias("fenced"), F.size(i).cast("long").alias("inline"), F.array_join(F.transform(f, lambda b: b["language"]), ",").alias("languages"), F.array_join(F.transform(i, lambda b: b["code"]), ",").alias("code"), f[0]["position"].alias("first_at"), i[0]["position"].alias("inline_at"))


@query(
    r"""WITH x AS (SELECT page_id, url || ' in ' || html || ' and ' || url AS html FROM pages), f AS (SELECT page_id, html, regexp_extract_all(html, 'https?://[^\s<>"'']+') AS u, regexp_split_to_array(html, 'https?://[^\s<>"'']+') AS parts FROM x), k AS (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM f)
    SELECT page_id, u[i] AS url, (list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(u[1:i - 1], lambda p: length(p))), 0))::INT AS position FROM k"""
)
def url_positions(spark, sf_dir):
    x = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit(" in "), "html", F.lit(" and "), "url").alias("x"))
    return x.select("page_id", F.inline(sg.url_places("x"))).select("page_id", F.col("text").alias("url"), "position")


def _s_concepts(t: str) -> str:
    return f"list_concat(list_filter({t}, lambda w: length(w) > 3 AND w NOT IN {s_in(lx.STOP)}), list_filter({s_grams(t, 2)}, lambda g: {s_any('g', lx.STEMS)}))"


_S_GRAMS3 = s_grams("lt", 3)


@query(
    S_EXTREME
    + f""", k AS (SELECT doc_id, {s_toks('lower(text)')} AS lt, {s_toks('lower(c)')} AS lc FROM out), w AS (SELECT doc_id, lt, {_s_concepts('lt')} AS o, {_s_concepts('lc')} AS n, {_S_GRAMS3} AS g FROM k)
    SELECT doc_id, md5(array_to_string(o, ' ')) AS concepts, len(o)::BIGINT AS n, (len(list_distinct(o)) - len(list_intersect(list_distinct(o), list_distinct(n))))::BIGINT AS lost,
    CASE WHEN len(lt) > 10 THEN list_filter(g, lambda x, i: list_position(g, x) < i)[1] END AS repeated FROM w"""
)
def key_concepts(spark, sf_dir):
    """Key concepts, how many of them a rewrite loses, and the first phrase that comes again."""
    out = docs(spark, sf_dir).withColumn("c", en.plain_extreme("text")).select("doc_id", "text", sg.key_concepts("text").alias("o"), sg.key_concepts("c").alias("n"))
    return out.select("doc_id", F.md5(F.array_join("o", " ")).alias("concepts"), F.size("o").cast("long").alias("n"), F.size(F.array_except("o", "n")).cast("long").alias("lost"), sg.repeated_phrase("text").alias("repeated"))


@query(
    f"""WITH p AS (SELECT page_id, html, [url, CASE WHEN page_id % 3 = 0 THEN 'src/main.py' WHEN page_id % 3 = 1 THEN 'a/package.json' ELSE 'x/view.tsx' END, CASE WHEN page_id % 5 = 0 THEN 'Dockerfile' ELSE 'q.sql' END] AS files FROM pages),
    e AS (SELECT *, list_transform(files, lambda f: lower(regexp_extract(f, '\\.([A-Za-z0-9]+)$', 1))) AS ends FROM p)
    SELECT page_id, CASE WHEN list_contains(ends, 'go') THEN 'go' WHEN list_contains(ends, 'java') THEN 'java' WHEN list_contains(ends, 'js') OR list_contains(ends, 'ts') THEN 'javascript' WHEN list_contains(ends, 'py') THEN 'python' WHEN list_contains(ends, 'sql') THEN 'sql' END AS language,
    CASE WHEN list_contains(ends, 'tsx') OR list_contains(ends, 'jsx') THEN 'react' WHEN list_contains(ends, 'ipynb') THEN 'notebook' END AS framework, CASE WHEN len(list_filter(files, lambda f: contains(f, 'package.json'))) > 0 THEN 'web' WHEN len(list_filter(files, lambda f: contains(f, 'pyproject'))) > 0 THEN 'library' END AS project,
    CASE WHEN {s_any('lower(html)', lx.DOMAINS['finance'])} THEN 'finance' WHEN {s_any('lower(html)', lx.DOMAINS['support'])} THEN 'support' WHEN len(list_filter(files, lambda f: contains(f, 'Dockerfile'))) > 0 THEN 'operations' ELSE 'general' END AS domain,
    CASE WHEN length(html) < 500 THEN 'simple' WHEN length(html) < 2000 THEN 'medium' ELSE 'complex' END AS complexity FROM e"""
)
def context_hints(spark, sf_dir):
    n = F.col("page_id")
    files = F.array("url", F.when(n % 3 == 0, "src/main.py").when(n % 3 == 1, "a/package.json").otherwise("x/view.tsx"), F.when(n % 5 == 0, "Dockerfile").otherwise("q.sql"))
    return table(spark, sf_dir, "pages").withColumn("files", files).select("page_id", sg.context_hints("html", "files").alias("h")).select("page_id", "h.*")


_S_PAIRS = "list_transform(range(1, len(st)), lambda i: st[i] || st[i + 1])"


@query(
    f"""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{1,5}}'), lambda t: t <> '') AS st FROM documents), h AS (SELECT *, [CASE WHEN length(st[i]) > 2 AND length(st[i + 1]) > 2 AND (st[i] || st[i + 1]) IN {s_in(lx.SPLIT_WORDS)} THEN 1 ELSE 0 END FOR i IN range(1, len(st))] AS hit FROM s)
    SELECT doc_id, (least(10, list_sum(hit)))::BIGINT AS n FROM h WHERE list_sum(hit) > 0"""
)
def split_words(spark, sf_dir):
    """Words of the list cut in two by a vocabulary, here pieces of at most five letters; no listed word's end begins another, so hits don't overlap."""
    pieces = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{1,5})"), 1)
    out = docs(spark, sf_dir).select("doc_id", F.size(sg.split_words(pieces)).cast("long").alias("n"))
    return out.where("n > 0")


# --- profiles --------------------------------------------------------------------------------------------


def _s_ratio(words, n: str = "len(lt)") -> str:
    return f"least(1e0, {s_share(s_count(s_pad('text'), '(?i)' + chr(92) + 'b(?:' + '|'.join(words) + ')' + chr(92) + 'b'), n)})"


@query(
    BASE
    + f""", w AS (SELECT *, list_filter(lt, lambda x: length(x) > 3) AS lw FROM d) SELECT doc_id, len(lt)::BIGINT AS words, round({_s_ratio(lx.VARIANT_TECH)}, 6) AS technical, round(least(1e0, {s_share(s_count('text', '[{}()' + chr(92) + '[' + chr(92) + ']<>]'), 'length(text)')}), 6) AS structural,
    round({_s_ratio(lx.VARIANT_DOMAIN)}, 6) AS domain, round(least(1e0, {s_share('len(lw) - len(list_distinct(lw))', 'len(lt)')}), 6) AS potential, round({_s_ratio(lx.VARIANT_FORMAL)}, 6) AS sensitivity FROM w"""
)
def variant_profile(spark, sf_dir):
    return _rounded(docs(spark, sf_dir).select("doc_id", pr.variant_profile("text").alias("p")).select("doc_id", "p.*"))


@query(
    BASE
    + f""", s AS (SELECT doc_id, {S_READING} AS k, {S_DENSITY} AS dn, {S_PHRASE_RED} AS r, {S_FORMAL} AS f, {s_nsub('low', lx.DOMAINS['finance'])}::DOUBLE / {len(lx.DOMAINS['finance'])} AS finance, {s_nsub('low', lx.DOMAINS['support'])}::DOUBLE / {len(lx.DOMAINS['support'])} AS support FROM d),
    p AS (SELECT *, greatest(0.1e0, least(0.8e0, 0.3e0 + 0.4e0 * r + 0.2e0 * dn + 0.15e0 * k - 0.1e0 * f)) AS potential FROM s)
    SELECT doc_id, round(potential, 6) AS potential, array_to_string(list_filter([CASE WHEN r > 0.3e0 THEN 'repetitive' END, CASE WHEN dn > 0.3e0 THEN 'technical' END, CASE WHEN potential > 0.6e0 THEN 'aggressive' END, CASE WHEN f > 0.7e0 THEN 'formal' END], lambda a: a IS NOT NULL), ',') AS advice,
    round(finance, 6) AS finance, round(support, 6) AS support, 0.5e0 AS unknown FROM p"""
)
def potential_advice(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", pr.potential_with_advice("text").alias("p"), *[r6(pr.domain_specificity("text", d)).alias(n) for n, d in (("finance", "finance"), ("support", "support"), ("unknown", None))])
    return out.select("doc_id", r6(F.col("p.potential")).alias("potential"), F.array_join("p.advice", ",").alias("advice"), "finance", "support", "unknown")


_S_BEST = "greatest(" + ", ".join(S_SCORES) + ")"
_S_DOMAIN = f"CASE WHEN {_S_BEST} = 0 THEN 'general' " + " ".join(f"WHEN {k} = {_S_BEST} THEN '{k}'" for k in S_SCORES) + " END"


@query(
    BASE
    + rf""", e AS (SELECT *, {s_sentences('text')} AS se, text AS x, doc_id AS id FROM d), s AS (SELECT doc_id, {S_COMPLEXITY} AS cx, {S_ANALYZER} AS dn, {", ".join(f"{v} AS {k}" for k, v in S_SCORES.items())},
    {s_share("least(10, coalesce(len(list_filter(map_values(list_aggregate(lt, 'histogram')), lambda c: c > 1)), 0))", 'len(list_distinct(lt))')} * 0.4e0 + least(1e0, {s_share(S_VERBOSE, 'len(lt)')} * 10) * 0.3e0 + least(1e0, {s_share(s_count('text', r'[A-Za-z0-9_]{8,}\s+[A-Za-z0-9_]{8,}'), 'greatest(1, len(lt) // 10)')}) * 0.3e0 AS rd FROM e),
    ct AS (SELECT id, {_s_content('x')[1]} AS content FROM {_s_content('x')[0].replace('src', '(SELECT doc_id AS id, text AS x FROM documents)')}),
    b AS (SELECT s.doc_id, cx, dn, rd, content, {_S_DOMAIN} AS domain FROM s JOIN ct ON ct.id = s.doc_id),
    l AS (SELECT *, CASE WHEN content = 'code' THEN 'light' WHEN content = 'prose' THEN 'aggressive' ELSE 'balanced' END AS l1 FROM b), m AS (SELECT *, CASE WHEN dn > 0.7e0 THEN l1 WHEN dn < 0.3e0 THEN 'aggressive' ELSE l1 END AS l2 FROM l),
    n AS (SELECT *, CASE WHEN cx > 0.8e0 THEN 'light' WHEN cx < 0.4e0 THEN 'aggressive' ELSE l2 END AS l3 FROM m)
    SELECT doc_id, CASE WHEN rd > 0.7e0 AND l3 = 'balanced' THEN 'aggressive' WHEN rd < 0.3e0 AND l3 = 'aggressive' THEN 'balanced' ELSE l3 END AS level, CASE WHEN dn > 0.7e0 OR domain = 'finance' THEN 'semantic' ELSE 'hybrid' END AS engine,
    array_to_string(list_filter([CASE WHEN domain = 'finance' THEN 'terms of the domain' END, CASE content WHEN 'code' THEN 'code stays' WHEN 'documentation' THEN 'documentation' WHEN 'prose' THEN 'prose' END, CASE WHEN dn > 0.7e0 THEN 'many technical terms' WHEN dn < 0.3e0 THEN 'few technical terms' END,
      CASE WHEN cx > 0.8e0 THEN 'complex' WHEN cx < 0.4e0 THEN 'simple' END, CASE WHEN rd > 0.7e0 THEN 'much to save' WHEN rd < 0.3e0 THEN 'little to save' END], lambda r: r IS NOT NULL), ', ') AS reasons FROM n"""
)
def recommended_strategy(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", pr.domain_of("text").alias("d"), pr.content_type("text").alias("t"), pr.analyzer_density("text").alias("n"), pr.complexity("text").alias("c"), pr.readiness("text")["overall"].alias("r"))
    out = p.select("doc_id", pr.recommended_strategy(F.col("d"), F.col("t"), F.col("n"), F.col("c"), F.col("r")).alias("s"))
    return out.select("doc_id", "s.level", "s.engine", F.array_join("s.reasons", ", ").alias("reasons"))


@query(
    BASE
    + f""", s AS (SELECT doc_id, text, {S_SENSITIVITY} AS sens, {S_POTENTIAL} AS pot, {S_READING} AS k, {", ".join(f"{v} AS {d}" for d, v in S_SCORES.items())} FROM d), p AS (SELECT *, {_S_DOMAIN} AS domain FROM s)
    SELECT doc_id, CASE WHEN sens > 0.7e0 THEN 'semantic' WHEN pot > 0.8e0 AND sens < 0.4e0 THEN 'extreme' ELSE 'semantic' END AS light, CASE WHEN sens > 0.7e0 THEN 'semantic' ELSE 'extreme' END AS aggressive,
    round(greatest(0.5e0, least(0.95e0, (0.7e0 + CASE WHEN k > 0.8e0 THEN 0.1e0 WHEN k < 0.3e0 THEN -0.1e0 ELSE 0e0 END) * CASE domain WHEN 'finance' THEN 0.95e0 WHEN 'support' THEN 0.9e0 WHEN 'logistics' THEN 0.85e0 ELSE 1e0 END + CASE WHEN length(text) > 2000 THEN -0.05e0 WHEN length(text) < 200 THEN 0.1e0 ELSE 0e0 END)), 6) AS ratio FROM p"""
)
def strategies_by_level(spark, sf_dir):
    """The strategy of each text on the light and the aggressive level, and what its domain lets a rewrite leave."""
    p = en.profiled(docs(spark, sf_dir))
    s, c = F.col("quality_sensitivity"), F.col("compression_potential")
    return p.select("doc_id", pr.strategy(s, c, F.lit("light")).alias("light"), pr.strategy(s, c, F.lit("aggressive")).alias("aggressive"), r6(pr.estimated_ratio("text", pr.domain_of("text"))).alias("ratio"))


# --- quality ---------------------------------------------------------------------------------------------

_S_SENTENCES = f"CASE WHEN len(so) = 0 THEN 1e0 ELSE greatest(0.2e0, least(1e0, (len(sc)::DOUBLE / len(so) + CASE WHEN len(sc) > 0 AND {s_avg_words('so')} > 0 THEN {s_avg_words('sc')} / {s_avg_words('so')} ELSE 1e0 END) / 2)) END"
_S_PARTS = lambda x: f"len(list_filter(string_split({x}, chr(10) || chr(10)), lambda p: {s_trim('p')} <> ''))"
_S_KEPT = lambda n, m, least: f"CASE WHEN {m} > {least} THEN least(1e0, {s_share(n, m)}) ELSE 1e0 END"
_S_ENT = rf"'\b([A-Z][a-z]+|[0-9]+)\b', 1"


#: CTEs that end in p: (doc_id and the composite score's parts) of rows (doc_id, text, c) named out
S_QUALITY = rf"""v AS MATERIALIZED (SELECT doc_id, text, c, {s_toks('lower(text)')} AS a, {s_toks('lower(c)')} AS b, {s_toks('c')} AS tc, {s_sentences('text')} AS so, {s_sentences('c')} AS sc, CASE WHEN length(text) = 0 THEN 1e0 ELSE length(c)::DOUBLE / length(text) END AS r,
    list_distinct(regexp_extract_all({s_pad('text')}, {_S_ENT})) AS eo, list_distinct(regexp_extract_all({s_pad('c')}, {_S_ENT})) AS ec FROM out),
    v2 AS MATERIALIZED (SELECT *, {_s_concepts('a')} AS ko, {_s_concepts('b')} AS kc, lower(c) AS lc FROM v),
    w AS (SELECT *, CASE WHEN len(list_distinct(ko)) = 0 THEN 1e0 ELSE len(list_intersect(list_distinct(ko), list_distinct(kc)))::DOUBLE / len(list_distinct(ko)) END AS info FROM v2),
    p AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN 1e0 ELSE least(1e0, 0.4e0 * {s_jaccard('a', 'b')} + 0.4e0 * CASE WHEN len(ko) = 0 THEN 1e0 ELSE len(list_filter(ko, lambda k: contains(lc, k)))::DOUBLE / len(ko) END + 0.2e0 * {_S_SENTENCES}) END AS semantic,
    CASE WHEN length(c) = 0 THEN 0e0 ELSE least(1e0, CASE WHEN r < 1 THEN info / r ELSE info END) END AS density,
    CASE WHEN length(text) = 0 THEN 1e0 ELSE greatest(0e0, least(1e0, CASE WHEN r >= 0.3e0 AND r <= 0.7e0 THEN 1 - 2 * abs(r - 0.5e0) WHEN r < 0.3e0 THEN 0.5e0 - (0.3e0 - r) ELSE 1 - 2 * (r - 0.7e0) END)) END AS efficiency,
    greatest(0e0, least(1e0, 0.8e0 - CASE WHEN {s_share(s_count(s_pad('c'), r'\b[A-Z]{2,}\b'), 'len(tc)')} > 0.3e0 THEN 0.2e0 ELSE 0e0 END + {s_nsub('lc', lx.CLUES)}::DOUBLE / {len(lx.CLUES)} * 0.1e0
      - CASE WHEN {s_share(s_count('c', r'[^\p{L}\p{N}_\s]'), 'length(c)')} > 0.2e0 THEN ({s_share(s_count('c', r'[^\p{L}\p{N}_\s]'), 'length(c)')} - 0.2e0) * 0.5e0 ELSE 0e0 END)) AS interpretability,
    0.5e0 * {_S_KEPT('len(sc)', 'len(so)', 0)} + 0.3e0 * {_S_KEPT(_S_PARTS('c'), _S_PARTS('text'), 1)} + 0.2e0 * {_S_KEPT(s_count('c', '(?m)^ *[-*•] '), s_count('text', '(?m)^ *[-*•] '), 0)} AS structure,
    CASE WHEN len(tc) = 0 THEN 0e0 WHEN len(tc) < 2 THEN 0.5e0 ELSE greatest(0e0, least(1e0, 0.8e0 - CASE WHEN len(list_filter(tc, lambda w: regexp_matches(w, '^\p{{L}}$'))) > len(tc) * 0.3e0 THEN 0.3e0 ELSE 0e0 END - least(0.2e0, 0.05e0 * {s_count('c', r'[\p{L}\p{N}_][^\p{L}\p{N}_\s][\p{L}\p{N}_]')})
      - CASE WHEN {s_share('list_sum(list_transform(tc, lambda w: length(w)))', 'len(tc)')} < 2 THEN 0.2e0 WHEN {s_share('list_sum(list_transform(tc, lambda w: length(w)))', 'len(tc)')} > 12 THEN 0.1e0 ELSE 0e0 END)) END AS coherence,
    CASE WHEN len(eo) = 0 THEN 1e0 ELSE len(list_intersect(eo, ec))::DOUBLE / len(eo) END AS entities FROM w)"""
S_COMPOSITE = "10 * (" + " + ".join(f"{w}::DOUBLE * {k}" for k, w in q.WEIGHTS.items()) + ")"


@query(S_EXTREME + f", {S_QUALITY} SELECT doc_id, {', '.join(f'round({k}, 6) AS {k}' for k in q.WEIGHTS)}, round({S_COMPOSITE}, 5) AS composite FROM p")
def quality_components(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", "text", en.plain_extreme("text").alias("c"))
    scored = en.scored(out, "c")
    parts = {k: F.col(f"_q.{k}") for k in q.WEIGHTS}
    return scored.select("doc_id", *[r6(v).alias(k) for k, v in parts.items()], F.round(q.composite(parts), 5).alias("composite"))


_S_CRIT = f"list_filter({s_list(lx.CRITICAL)}, lambda t: contains(lower(text), t))"


@query(
    S_EXTREME
    + rf""", v AS (SELECT *, CASE WHEN length(text) = 0 THEN 1e0 ELSE length(c)::DOUBLE / length(text) END AS r, {s_share(f"len({s_toks('c')})", f"len({s_toks('text')})")} AS w, len({s_toks('c')}) AS nw, {s_count('c', r'[(\[{]')} <> {s_count('c', r'[)\]}]')} AS open_, {_S_CRIT} AS own, {s_sentences('text')} AS so, {s_sentences('c')} AS sc,
    list_distinct({s_toks('lower(text)')}) AS a, list_distinct({s_toks('lower(c)')}) AS b FROM out),
    e AS (SELECT *, least(1e0, 0.7e0 * CASE WHEN len(a) = 0 THEN 1e0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END + 0.3e0 * (1 - r)) AS est, greatest(0e0, 10e0 - CASE WHEN r < 0.3e0 THEN 3 ELSE 0 END - CASE WHEN w < 0.5e0 THEN 2 ELSE 0 END - CASE WHEN nw < 3 THEN 1 ELSE 0 END - CASE WHEN open_ THEN 1 ELSE 0 END) AS score FROM v)
    SELECT doc_id, score, array_to_string(list_filter([CASE WHEN r < 0.3e0 THEN 'over-compressed' END, CASE WHEN w < 0.5e0 THEN 'many words lost' END, CASE WHEN nw < 3 THEN 'too short' END, CASE WHEN open_ THEN 'unbalanced brackets' END], lambda i: i IS NOT NULL), ', ') AS issues,
    array_to_string(list_filter([CASE WHEN r < 0.3e0 THEN 'very strong compression' END, CASE WHEN r > 0.95e0 THEN 'little compression' END, CASE WHEN est < 0.75e0 THEN 'low quality estimate' END], lambda i: i IS NOT NULL), ', ') AS warnings,
    CASE WHEN score >= 9 THEN 'excellent' WHEN score >= 8 THEN 'very good' WHEN score >= 7 THEN 'good' WHEN score >= 6 THEN 'fair' WHEN score >= 5 THEN 'acceptable' ELSE 'poor' END AS rating,
    len(own)::BIGINT AS critical, len(list_filter(own, lambda t: contains(lower(c), t)))::BIGINT AS preserved, round({_S_SENTENCES}, 6) AS sentences, CASE doc_id % 3 WHEN 0 THEN 7e0 WHEN 1 THEN 6e0 ELSE 5e0 END AS least, CASE doc_id % 3 WHEN 0 THEN 8.5e0 WHEN 1 THEN 7.5e0 ELSE 6.5e0 END AS least_high FROM e"""
)
def quality_checks(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", "text", en.plain_extreme("text").alias("c"))
    level = F.when(F.col("doc_id") % 3 == 0, "light").when(F.col("doc_id") % 3 == 1, "balanced").otherwise("aggressive")
    v, crit = q.validate("text", "c"), q.critical_terms("text", "c")
    out = out.select("doc_id", v.alias("v"), q.warnings(q.ratio("text", "c"), q.extreme_estimate("text", "c")).alias("w"), crit.alias("t"), r6(q.sentence_structure("text", "c")).alias("sentences"), q.minimum(level).alias("least"), q.minimum(level, True).alias("least_high"))
    return out.select("doc_id", F.col("v.score").alias("score"), F.array_join("v.issues", ", ").alias("issues"), F.array_join("w", ", ").alias("warnings"), rw.quality_rating(F.col("v.score")).alias("rating"), F.col("t.original").alias("critical"), F.col("t.preserved").alias("preserved"), "sentences", "least", "least_high")


# --- similarity ------------------------------------------------------------------------------------------

_S_STRIP = lambda x: s_toks(f"lower(regexp_replace({x}, '[^" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "s]', '', 'g'))")
_S_BAG = """CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0e0 ELSE list_sum(list_transform(un, lambda w: len(list_filter(u, lambda x: x = w)) * len(list_filter(v, lambda x: x = w)))) /
    (sqrt(list_sum(list_transform(un, lambda w: len(list_filter(u, lambda x: x = w)) ** 2))) * sqrt(list_sum(list_transform(un, lambda w: len(list_filter(v, lambda x: x = w)) ** 2)))) END"""
_S_EDIT = "CASE WHEN greatest(length(x), length(y)) = 0 THEN 1e0 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END"
_S_BIG, _S_SMALL = "CASE WHEN length(x) >= length(y) THEN x ELSE y END", "CASE WHEN length(x) >= length(y) THEN y ELSE x END"
_S_STRUCTURAL = f"CASE WHEN x = y THEN 1e0 WHEN length({_S_SMALL}) > 0 AND contains({_S_BIG}, {_S_SMALL}) THEN 0.7e0 + 0.3e0 * (1 - (position({_S_SMALL} IN {_S_BIG}) - 1)::DOUBLE / length({_S_BIG})) * length({_S_SMALL}) / length({_S_BIG}) ELSE 0.8e0 * {s_jaccard('tx', 'ty')} END"
_S_PAIRED = lambda a, b: f"lower({a}) AS x, lower({b}) AS y, {s_toks(f'lower({a})')} AS tx, {s_toks(f'lower({b})')} AS ty, {_S_STRIP(a)} AS u, {_S_STRIP(b)} AS v, list_distinct(list_concat({_S_STRIP(a)}, {_S_STRIP(b)})) AS un"


@query(
    f"""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS b FROM conversations), c AS (SELECT *, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM t), p AS (SELECT conv_id, turn, {_S_PAIRED('a', 'b')} FROM c WHERE a IS NOT NULL)
    SELECT conv_id, turn, round({s_jaccard('tx', 'ty')}, 6) AS jaccard, round({s_jaccard('u', 'v')}, 6) AS stripped, round({_S_BAG}, 6) AS bag, round({_S_STRUCTURAL}, 6) AS structural, round({_S_EDIT}, 6) AS edit, round(CASE WHEN least(length(x), length(y)) <= 10 THEN {_S_EDIT} ELSE {s_jaccard('tx', 'ty')} END, 6) AS lexical FROM p"""
)
def jaccard_pairs(spark, sf_dir):
    """Each turn of a conversation against the one before it, in ASCII: the SQL's edit distance counts bytes."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "").alias("b"))
    p = c.withColumn("a", F.lag("b").over(Window.partitionBy("conv_id").orderBy("turn"))).where("a is not null")
    parts = {"jaccard": word_jaccard("a", "b"), "stripped": sm.stripped_jaccard("a", "b"), "bag": sm.bag_cosine("a", "b"), "structural": sm.structural("a", "b"), "edit": sm.edit("a", "b"), "lexical": sm.lexical("a", "b")}
    return p.select("conv_id", "turn", *[r6(v).alias(k) for k, v in parts.items()])


def _s_queries() -> str:
    """Texts that are rules' originals, begin or end with one, or are nothing like one."""
    return "CASE p_partkey % 4 WHEN 0 THEN original WHEN 1 THEN original || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || original ELSE p_name END"


_S_SEARCH = f"""WITH qs AS (SELECT p_partkey AS doc_id, {_s_queries()} AS a FROM part JOIN {RULE_VALUES} ON r.id = p_partkey % 14 + 1),
    p AS (SELECT doc_id, r.id, priority, success_rate, domain, length(original) AS lo, length(compressed) AS lc, len({s_toks('lower(a)')}) AS n, {_S_PAIRED('a', 'original')} FROM qs, {RULE_VALUES}),
    s AS (SELECT doc_id, id, n, {_S_BAG} AS semantic, {_S_STRUCTURAL} AS structural, least(1e0, 0.5e0 + CASE WHEN domain = 'business' THEN 0.4e0 WHEN domain = 'general' THEN 0.2e0 ELSE -0.2e0 END + least(0.3e0, priority / 3333e0) + success_rate * 0.2e0) AS contextual,
      CASE WHEN least(length(x), length(y)) <= 10 THEN {_S_EDIT} ELSE {s_jaccard('tx', 'ty')} END AS lexical, least(1e0, CASE WHEN 1 - lc::DOUBLE / lo > 0.5 THEN 1 - lc::DOUBLE / lo + 0.2e0 ELSE 1 - lc::DOUBLE / lo END) AS compression FROM p WHERE domain IN ('general', 'business')),
    t AS (SELECT *, 0.4e0 * semantic + 0.2e0 * structural + 0.2e0 * contextual + 0.1e0 * lexical + 0.1e0 * compression AS score, greatest(0.3e0, least(0.9e0, 0.6e0 + CASE WHEN n > 20 THEN -0.1e0 WHEN n < 5 THEN 0.1e0 ELSE 0e0 END - 0.05e0)) AS least FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, id) AS rank FROM t WHERE score >= least)"""


@query(
    _S_SEARCH
    + """ SELECT doc_id, id, rank::INT AS rank, round(score, 6) AS score, round(semantic, 6) AS semantic, round(structural, 6) AS structural, round(contextual, 6) AS contextual, round(lexical, 6) AS lexical, round(compression, 6) AS compression,
    round(least(1e0, score * 0.8e0 + CASE WHEN semantic > 0.8e0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN structural > 0.9e0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN contextual > 0.8e0 THEN 0.05e0 ELSE 0e0 END), 6) AS confidence FROM k WHERE rank <= 3"""
)
def rule_similarity_search(spark, sf_dir):
    rules = rl.starter_rules(spark)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 14 + 1).alias("rule_id"))
    first = p.join(F.broadcast(rules.select(F.col("id").alias("rule_id"), "original")), "rule_id")
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    n = F.col("p_partkey") % 4
    text = F.when(n == 0, F.col("original")).when(n == 1, F.concat("original", F.lit(" "), word(1))).when(n == 2, F.concat(word(2), F.lit(" "), "original")).otherwise(F.col("p_name"))
    found = ve.search_rules(first.select(F.col("p_partkey").alias("doc_id"), text.alias("text")), rules, domain="business", k=3)
    return _rounded(found)


@query(
    """WITH s AS (SELECT s_suppkey, list_transform(range(1, 385), lambda i: CASE WHEN i <= length(s_name) THEN unicode(substr(lower(s_name), i, 1))::DOUBLE ELSE 0e0 END) AS v FROM supplier), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda e: e * e))) AS norm FROM s)
    SELECT s_suppkey, len(v)::INT AS size, round(list_sum(list_transform(v, lambda e: (e / norm)::FLOAT::DOUBLE)), 4) AS total, round((v[1] / norm)::FLOAT::DOUBLE, 5) AS first, round((v[length('Supplier#')] / norm)::FLOAT::DOUBLE, 5) AS ninth FROM n"""
)
def fallback_embeddings(spark, sf_dir):
    s = ve.embed(spread(table(spark, sf_dir, "supplier"), "s_suppkey"), text="s_name")
    e = F.col("embedding")
    return s.select("s_suppkey", F.size(e).alias("size"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), F.round(e[0].cast("double"), 5).alias("first"), F.round(e[8].cast("double"), 5).alias("ninth"))


# --- metrics ----------------------------------------------------------------------------------------------


@query(
    S_METRICS
    + """, u AS (SELECT *, coalesce(domain, 'unknown') AS dom FROM m), d AS (SELECT session_id, dom AS name, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, dom) AS rk FROM u GROUP BY session_id, dom)
    SELECT session_id, 'domain' AS kind, name, n::BIGINT AS n, NULL::DOUBLE AS avg_ratio, NULL::DOUBLE AS avg_quality FROM d WHERE rk <= 5
    UNION ALL SELECT session_id, 'engine', engine_used, count(*)::BIGINT, round(avg(compression_ratio), 6), round(avg(quality_score), 6) FROM u GROUP BY session_id, engine_used"""
)
def session_details(spark, sf_dir):
    return _rounded(me.session_details(metrics_table(spark, sf_dir)))


@query(
    S_METRICS
    + """, e AS (SELECT engine_used, round((1 - avg(compression_ratio)) * avg(quality_score) / 10, 9) AS f FROM m GROUP BY engine_used), s AS (SELECT avg(quality_score) AS ql, avg(processing_time_ms) AS ms, count(*) FILTER (success)::DOUBLE / count(*) AS ok FROM m)
    SELECT array_to_string(list_filter([CASE WHEN ql < 7 THEN 'raise quality thresholds' END, CASE WHEN ms > 500 THEN 'reduce processing time' END, CASE WHEN ok < 0.95 THEN 'look into failures' END, (SELECT 'prefer ' || arg_max(engine_used, (f, engine_used)) FROM e)], lambda a: a IS NOT NULL), '; ') AS advice FROM s"""
)
def metric_recommendations(spark, sf_dir):
    return me.recommendations(metrics_table(spark, sf_dir)).select(F.array_join("advice", "; ").alias("advice"))


@query(S_METRICS + "SELECT domain, count(*)::BIGINT AS n FROM m GROUP BY domain ORDER BY n DESC, domain NULLS FIRST LIMIT 2")
def top_domains(spark, sf_dir):
    return me.top(metrics_table(spark, sf_dir), "domain", 2)


@query(
    """WITH u AS (SELECT event_type, user_id, max(ts) AS last_used, count(*) AS uses FROM events GROUP BY event_type, user_id), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY last_used DESC, user_id) AS rk FROM u)
    SELECT event_type, user_id, epoch_us(last_used)::BIGINT AS last_used, uses::BIGINT AS uses FROM r WHERE rk <= 7"""
)
def cache_contents(spark, sf_dir):
    """What caches of seven users hold after all events of their type."""
    out = me.least_recently_used(table(spark, sf_dir, "events"), "event_type", "user_id", "ts", 7)
    return out.withColumn("last_used", F.unix_micros(F.col("last_used").cast("timestamp")))
