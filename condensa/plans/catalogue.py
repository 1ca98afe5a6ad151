"""Queries of the library's operators over whole tables, each with the SQL that DuckDB runs to check it.

Doubles are rounded to six places and arrays spelled as text, so that rows can
be compared by hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..config import EngineConfig
from ..functions import profile as pr
from ..functions import quality as q
from ..functions import rewrite as rw
from ..functions import segment as sg
from ..functions import similarity as sm
from ..functions import tokens as tk
from ..functions.text import ltoks, toks
from ..operators import engines as en
from ..operators import matching as mt
from ..operators import metrics as me
from ..operators import mining as mi
from ..operators import rules as rl
from ..operators import vectors as ve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows as the scan splits them; only a small input of fewer splits than the cluster has cores is dealt over these."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# --- SQL building blocks ----------------------------------------------------------


def s_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def s_in(words) -> str:
    return "(" + s_list(words)[1:-1] + ")"


def s_toks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def s_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '" + pattern.replace("'", "''") + "'))"


def s_nocc(x: str, literal: str) -> str:
    return f"((length({x}) - length(replace({x}, '{literal}', ''))) // {len(literal)})"


def s_sum(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def s_nsub(x: str, words) -> str:
    return s_sum(f"contains({x}, '{w}')::BIGINT" for w in words)


def s_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def s_share(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0e0)"


def s_grams(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"


def s_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1e0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def s_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def s_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, '.'), lambda s: {s_trim('s')}), lambda s: s <> '')"


def s_avg_words(s: str) -> str:
    return s_share(f"list_sum(list_transform({s}, lambda x: len({s_toks('x')})))", f"len({s})")


def s_pad(x: str) -> str:
    """Accented letters between word characters, as word borders know ASCII only."""
    return f"regexp_replace({x}, '([À-ÖØ-öø-ɏ])', '_9_\\1_9_', 'g')"


def s_unpad(x: str) -> str:
    return f"regexp_replace({x}, '_9_([À-ÖØ-öø-ɏ])_9_', '\\1', 'g')"


def s_words_replace(x: str, words, to: str = "", after: str = r"\s+") -> str:
    return f"regexp_replace({x}, '(?i)\\b(?:" + "|".join(w.replace("'", "''") for w in words) + rf")\b{after}', '{to}', 'g')"


def s_fold(x: str, rules) -> str:
    for a, b in rules:
        x = f"regexp_replace({x}, '(?i)\\b{a}\\b', '" + b.replace("'", "''") + "', 'g')"
    return x


BASE = f"WITH d AS MATERIALIZED (SELECT doc_id, lang, source, text, lower(text) AS low, {s_toks('text')} AS t, {s_toks('lower(text)')} AS lt FROM documents) "
RULE_VALUES = "(VALUES " + ", ".join(f"({i}, '{o}', '{c}', '{t}', {p}, '{d}', {f}, {s}::DOUBLE)" for i, o, c, t, p, d, f, s in lx.RULES) + ") r(id, original, compressed, pattern_type, priority, domain, frequency, success_rate)"

# --- tokens -------------------------------------------------------------------------

S_ESTIMATE = "CASE WHEN length(text) = 0 THEN 1 ELSE greatest(1, length(text) // 4) END::BIGINT"
S_WORDS = "CASE WHEN len(t) = 0 THEN 0 ELSE greatest(1, floor(len(t) * 1.3e0)) END::BIGINT"


@query(
    BASE
    + f"""SELECT doc_id, {S_ESTIMATE} AS base,
    greatest(1, floor(length(text)::DOUBLE / 4 * CASE WHEN length(text)::DOUBLE / nullif(len(t), 0) > 8 THEN 1.2e0 WHEN length(text)::DOUBLE / nullif(len(t), 0) < 4 THEN 0.9e0 ELSE 1e0 END
      * CASE WHEN {s_nsub('low', lx.TECH)} >= 2 THEN 1.1e0 ELSE 1e0 END))::BIGINT AS adjusted, {S_WORDS} AS words FROM d"""
)
def token_estimates(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tk.estimate("text").alias("base"), tk.adjusted_estimate("text").alias("adjusted"), tk.word_estimate("text").alias("words"))


@query(
    BASE
    + f"""SELECT doc_id, least(ceil(length(text) / 4e0), floor(len(t) * 1.3e0 + {s_count('text', '[.,!?;:]')} * 0.5e0 + {s_count('text', '[0-9]+')} * 0.3e0 + {s_count('text', '[a-z][A-Z]')} * 0.2e0 + {s_count('text', '[A-Z]{2,}')} * 0.1e0 + 0.5e0))::BIGINT AS patterns,
    ceil(length(text) * 0.25)::BIGINT AS model_a, ceil(length(text) * 0.24)::BIGINT AS model_b FROM d"""
)
def token_patterns(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tk.pattern_estimate("text").alias("patterns"), tk.model_estimate("text", 0.25).alias("model_a"), tk.model_estimate("text", 0.24).alias("model_b"))


@query(
    BASE
    + f"""SELECT doc_id, 100 + 50 * ceil(length(text) / 1e3)::BIGINT AS ms, round(least(0.7e0, {s_share(f"{s_nsub('low', lx.VERBOSE)} * 3 + len(list_filter(lt, lambda w: w IN {s_in(lx.STOP)})) * 0.5e0", 'len(t)')}), 6) AS savings,
    printf('%.1f%%', round(least(0.7e0, {s_share('len(t)', 'length(text)')}) * 100e0, 3) + 1e-9) AS words_per_char,
    round({S_ESTIMATE} / 1e3 * 0.03e0, 6) AS cost FROM d"""
)
def cost_estimates(spark, sf_dir):
    share = F.least(F.lit(0.7), F.coalesce(F.try_divide(F.size(toks("text")).cast("double"), F.length("text").cast("double")), F.lit(0.0)))
    return docs(spark, sf_dir).select("doc_id", tk.processing_ms("text").alias("ms"), r6(tk.model_savings("text")).alias("savings"), tk.percentage_text(F.round(share * 100, 3) / 100 + 1e-11).alias("words_per_char"), r6(tk.cost(tk.estimate("text"))).alias("cost"))


@query(
    BASE
    + """SELECT doc_id, array_to_string(list_transform(t, lambda w, i: ((list_sum(list_transform(string_split(w, ''), lambda c: unicode(c))) + i - 1) % 50000)::INT), ' ') AS ids FROM d"""
)
def pseudo_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(tk.pseudo_ids("text"), lambda i: i.cast("string")), " ").alias("ids"))


# --- profiles -------------------------------------------------------------------------


@query(
    BASE
    + rf"""SELECT doc_id, length(text)::BIGINT AS chars, len(t)::BIGINT AS words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: {s_trim('s')} <> ''))::BIGINT AS sentences,
    round({s_share('list_sum(list_transform(t, lambda w: length(w)))', 'len(t)')}, 6) AS avg_word_length, round({s_share('len(t)', "len(regexp_split_to_array(text, '[.!?]+'))")}, 6) AS avg_sentence_length FROM d"""
)
def text_characteristics(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", pr.characteristics("text").alias("c")).select("doc_id", "c.*")
    return out.withColumns({c: r6(F.col(c)) for c in ("avg_word_length", "avg_sentence_length")})


@query(
    BASE
    + rf"""SELECT doc_id, round({s_share(s_count('text', r'\p{L}'), 'length(text)')}, 6) AS alphabetic, round({s_share(s_count('text', '[0-9]'), 'length(text)')}, 6) AS numeric, round({s_share(s_count('text', r'\s'), 'length(text)')}, 6) AS whitespace,
    round({s_share(f"length(text) - {s_count('text', r'\p{L}')} - {s_count('text', '[0-9]')} - {s_count('text', r'\s')}", 'length(text)')}, 6) AS punctuation,
    len(list_filter(t, lambda w: regexp_matches(w, '^.[^A-Z]*[A-Z]')))::BIGINT AS camel_case, {s_count('text', r'[^\p{L}\p{N}\s]')}::BIGINT AS special, round({s_share('len(list_distinct(t))', 'len(t)')}, 6) AS diversity FROM d"""
)
def char_distribution(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", pr.char_distribution("text").alias("c")).select("doc_id", "c.*")
    return out.withColumns({c: r6(F.col(c)) for c in ("alphabetic", "numeric", "whitespace", "punctuation", "diversity")})


S_REDUNDANCY = f"CASE WHEN len(lt) = 0 THEN 0e0 ELSE 1 - {s_share('len(list_distinct(lt))', 'len(lt)')} END"


@query(BASE + f"SELECT lang, count(*)::BIGINT AS documents, round(avg({S_REDUNDANCY}), 6) AS redundancy FROM d GROUP BY lang")
def redundancy_by_lang(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents"), r6(F.avg(pr.redundancy("text"))).alias("redundancy"))


S_DENSITY = s_share(f"len(list_filter(lt, lambda w: {s_any('w', lx.TECH)}))", "len(lt)")
S_STRUCTURE = f"least(1e0, {s_share(s_count('text', '[.!?]') + ' + ' + s_count('text', ',') + ' * 0.5e0 + ' + s_count('text', ';') + ' * 0.8e0 + ' + s_count('text', '[()]') + ' * 0.3e0 + ' + s_count('text', '[-*•]') + ' * 0.6e0', 'len(t)')} * 10)"
S_FORMAL = f"CASE WHEN {s_nsub('low', lx.FORMAL)} + {s_nsub('low', lx.INFORMAL)} = 0 THEN 0.5e0 ELSE {s_share(s_nsub('low', lx.FORMAL), s_nsub('low', lx.FORMAL) + ' + ' + s_nsub('low', lx.INFORMAL))} END"


@query(BASE + f"SELECT doc_id, round({S_DENSITY}, 6) AS density, round({S_STRUCTURE}, 6) AS structural, round({S_FORMAL}, 6) AS formality FROM d")
def text_densities(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(pr.technical_density("text")).alias("density"), r6(pr.structural_complexity("text")).alias("structural"), r6(pr.formality("text")).alias("formality"))


S_SCORES = {d: s_sum(f"{s_nocc('low', k)} * {len(k.split())}" for k in keys) for d, keys in lx.DOMAINS.items()}


@query(
    BASE
    + ", s AS (SELECT doc_id, "
    + ", ".join(f"{v} AS {k}" for k, v in S_SCORES.items())
    + " FROM d), b AS (SELECT *, greatest(logistics, finance, support) AS best, logistics + finance + support AS every FROM s) SELECT doc_id, CASE WHEN best = 0 THEN 'general' WHEN logistics = best THEN 'logistics' WHEN finance = best THEN 'finance' ELSE 'support' END AS domain, "
    + ", ".join(f"round({s_share(k, 'every')}, 6) AS {k}" for k in lx.DOMAINS)
    + " FROM b"
)
def domain_detection(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", pr.domain_of("text").alias("domain"), pr.domain_confidence("text").alias("c"))
    return out.select("doc_id", "domain", *[r6(F.col("c")[k]).alias(k) for k in lx.DOMAINS])


def _s_content(x: str) -> str:
    scores = {k: s_sum(s_count(x, f"(?im){p}") for p in ps) for k, ps in lx.CONTENT_PATTERNS.items()}
    names = list(scores)
    best = f"greatest({', '.join(names)})"
    return (
        "(SELECT id, x, " + ", ".join(f"{v} AS {k}" for k, v in scores.items()) + " FROM src) s",
        f"CASE WHEN {s_sum(names)} > 0 AND {best}::DOUBLE / nullif({s_sum(names)}, 0) > 0.3e0 THEN CASE " + " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in names) + " END "
        f"WHEN len(string_split(x, chr(10))) > len(string_split(x, '. ')) THEN 'structured' WHEN contains(x, '.') AND len(string_split(x, '. ')) > 2 THEN 'prose' ELSE 'general' END",
    )


@query("WITH src AS (SELECT 'd' || doc_id AS id, text AS x FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages) SELECT id, " + _s_content("x")[1] + " AS content_type FROM " + _s_content("x")[0])
def content_type(spark, sf_dir):
    both = docs(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("x"))
    both = both.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("x")))
    return both.select("id", pr.content_type("x").alias("content_type"))


@query(
    BASE
    + rf""", s AS (SELECT doc_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {s_trim('p')} <> '')) AS paragraphs, len({s_sentences('text')}) AS sentences,
    {s_count('text', '(?m)^ *[-*•] +')} + {s_count('text', r'(?m)^ *[0-9]+\. +')} AS list_items, {s_count('text', '(?m)^#+ ')} > 0 AS has_headers, contains(text, '```') AS has_code FROM d)
    SELECT doc_id, paragraphs::BIGINT AS paragraphs, sentences::BIGINT AS sentences, list_items::BIGINT AS list_items, has_headers, has_code,
    CASE WHEN has_headers AND paragraphs > 3 THEN 'hierarchical' WHEN list_items > 0 THEN 'list-based' WHEN paragraphs > 1 THEN 'multi-paragraph' WHEN sentences > 5 THEN 'narrative' ELSE 'flat' END AS structure FROM s"""
)
def text_structure(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pr.text_structure("text").alias("s")).select("doc_id", "s.*")


def _s_repeats(n: int) -> str:
    return f"{n} * coalesce(len(list_filter(map_values(list_aggregate({s_grams('lt', n)}, 'histogram')), lambda c: c > 1)), 0)"


S_REPEATS = s_sum(_s_repeats(n) for n in (2, 3, 4))
S_VERBOSE = s_sum(s_nocc("low", v) for v in lx.VERBOSE)
S_POTENTIAL = f"least(1e0, {s_share('len(list_filter(t, lambda w: length(w) > 8))', 'len(t)')} * 0.3e0 + {s_share(S_REPEATS, 'len(t)')} * 0.3e0 + {s_share(S_VERBOSE, 'len(t)')} * 0.2e0 + {S_REDUNDANCY} * 0.2e0)"
S_SENSITIVITY = f"least(1e0, {S_DENSITY} * 0.4e0 + {S_STRUCTURE} * 0.3e0 + least(0.3e0, {s_share(s_nsub('low', lx.FORMAL), 'len(t)')} * 10))"


@query(
    BASE
    + f""", s AS (SELECT doc_id, length(text) AS n, {S_DENSITY} AS density, {S_POTENTIAL} AS potential, {S_SENSITIVITY} AS sensitivity FROM d)
    SELECT doc_id, round(potential, 6) AS potential, round(sensitivity, 6) AS sensitivity,
    CASE WHEN sensitivity > 0.7e0 THEN 'semantic' WHEN potential > 0.8e0 AND sensitivity < 0.4e0 THEN 'extreme' ELSE 'hybrid' END AS strategy,
    CASE WHEN sensitivity > 0.7e0 THEN 'semantic' WHEN potential > 0.8e0 AND sensitivity < 0.3e0 THEN 'extreme' WHEN n > 5000 THEN 'hybrid' WHEN density > 0.6e0 THEN 'semantic' ELSE 'hybrid' END AS recommended FROM s"""
)
def profile_and_strategy(spark, sf_dir):
    p = en.profiled(docs(spark, sf_dir))
    s, c = F.col("quality_sensitivity"), F.col("compression_potential")
    return p.select("doc_id", r6(c).alias("potential"), r6(s).alias("sensitivity"), pr.strategy(s, c, F.lit("balanced")).alias("strategy"), pr.recommended_engine(s, c, F.length("text"), F.col("technical_density")).alias("recommended"))


S_ANALYZER = f"least(1e0, {s_share(f'len(list_filter(lt, lambda w: w IN {s_in(lx.TECH)})) + ' + ' + '.join(s_count('text', p) for p in (pr.CAMEL, pr.ACRONYM, pr.SNAKE, pr.KEBAB, pr.VERSION)), 'len(lt)')})"
S_NESTING = " + ".join(s_count("text", p) for p in (r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}", r"\n\n"))
S_COMPLEXITY = f"CASE WHEN len(lt) = 0 THEN 0e0 ELSE (least(1e0, {s_avg_words('se')} / 20) + {s_share('len(list_distinct(lt))', 'len(lt)')} + {S_ANALYZER} + least(1e0, {s_share(S_NESTING, 'len(lt)')})) / CASE WHEN len(se) > 0 THEN 4 ELSE 3 END END"


@query(
    BASE
    + rf""", e AS (SELECT *, {s_sentences('text')} AS se FROM d), s AS (SELECT doc_id, {S_COMPLEXITY} AS complexity, {S_ANALYZER} AS density,
    {s_share("least(10, coalesce(len(list_filter(map_values(list_aggregate(lt, 'histogram')), lambda c: c > 1)), 0))", 'len(list_distinct(lt))')} AS redundancy, least(1e0, {s_share(S_VERBOSE, 'len(lt)')} * 10) AS verbosity,
    least(1e0, {s_share(s_count('text', r'[A-Za-z0-9_]{8,}\s+[A-Za-z0-9_]{8,}'), 'greatest(1, len(lt) // 10)')}) AS abbreviation FROM e),
    o AS (SELECT *, redundancy * 0.4e0 + verbosity * 0.3e0 + abbreviation * 0.3e0 AS overall FROM s)
    SELECT doc_id, round(complexity, 6) AS complexity, round(density, 6) AS density, round(overall, 6) AS readiness,
    array_to_string(list_filter([CASE WHEN redundancy > 0.3e0 THEN 'redundant words' END, CASE WHEN verbosity > 0.2e0 THEN 'verbose phrases' END, CASE WHEN abbreviation > 0.3e0 THEN 'long phrases' END], lambda a: a IS NOT NULL), ', ') AS advice,
    round(greatest(0.2e0, least(0.9e0, 0.6e0 + CASE WHEN complexity > 0.8e0 THEN 0.2e0 WHEN complexity < 0.3e0 THEN -0.1e0 ELSE 0e0 END + CASE WHEN density > 0.7e0 THEN 0.15e0 WHEN density < 0.2e0 THEN -0.1e0 ELSE 0e0 END
      + CASE WHEN overall > 0.7e0 THEN -0.1e0 WHEN overall < 0.3e0 THEN 0.1e0 ELSE 0e0 END)), 6) AS target FROM o"""
)
def readiness_and_target(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", pr.complexity("text").alias("complexity"), pr.analyzer_density("text").alias("density"), pr.readiness("text").alias("r"))
    return p.select("doc_id", r6(F.col("complexity")).alias("complexity"), r6(F.col("density")).alias("density"), r6(F.col("r.overall")).alias("readiness"), F.array_join("r.advice", ", ").alias("advice"), r6(pr.target_compression(F.col("complexity"), F.col("density"), F.col("r.overall"))).alias("target"))


@query(
    BASE
    + rf""", e AS (SELECT *, {s_sentences('text')} AS se FROM d) SELECT doc_id, round({s_share(r"list_sum(list_transform(t, lambda w: length(regexp_replace(w, '^[.,!?;:" + '"' + r"()\[\]{}]+|[.,!?;:" + '"' + r"()\[\]{}]+$', '', 'g'))))", 'len(t)')}, 6) AS avg_word_length,
    round({s_share(s_count('text', r'[.,!?;:"()\[\]{}/-]'), 'length(text)')}, 6) AS punctuation_density, {s_count('text', '[A-Z]{2,}')}::BIGINT AS all_caps, {s_count('text', '[A-Z][a-z]+')}::BIGINT AS title_case, {s_count('text', '[a-z]+[A-Z]')}::BIGINT AS camel_case,
    round(CASE WHEN len(se) = 0 THEN 0e0 ELSE least(1e0, ({s_avg_words('se')} / 15 + {s_share(s_sum(s_nocc('low', c) for c in lx.CONNECTIVES), 'len(t)')}) / 2) END, 6) AS complexity FROM e"""
)
def language_characteristics(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", pr.language_characteristics("text").alias("c")).select("doc_id", "c.*")
    return out.withColumns({c: r6(F.col(c)) for c in ("avg_word_length", "punctuation_density", "complexity")})


S_PHRASE_RED = f"CASE WHEN len(lt) < 10 THEN 0e0 ELSE least(1e0, {s_share(f'len(lt) - len(list_distinct(lt)) + 2 * (len({s_grams('lt', 3)}) - len(list_distinct({s_grams('lt', 3)})))', 'len(lt)')}) END"
S_READING = f"least({s_share('len(t)', f"len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: {s_trim('s')} <> ''))")} / 20, 1e0) * 0.4e0 + least({s_share('list_sum(list_transform(t, lambda w: length(w)))', 'len(t)')} / 8, 1e0) * 0.3e0 + {s_share('len(list_distinct(lt))', 'len(t)')} * 0.3e0"


@query(
    BASE
    + f""", s AS (SELECT doc_id, length(text) AS n, len(t) AS w, {S_READING} AS reading, {S_PHRASE_RED} AS repeats,
    least(1e0, {s_share('len(list_filter(t, lambda w: length(w) > 8))', 'len(t)')} + least(0.3e0, {s_share(s_nsub('low', lx.VERBOSE), 'len(t)')}) + {S_DENSITY} * 0.4e0 + {S_PHRASE_RED} * 0.3e0) AS potential FROM d)
    SELECT doc_id, round(reading, 6) AS reading, round(repeats, 6) AS repeats, round(potential, 6) AS potential, ceil(w / 200e0)::BIGINT AS minutes,
    round(greatest(0.5e0, least(0.95e0, 0.7e0 + CASE WHEN reading > 0.8e0 THEN 0.1e0 WHEN reading < 0.3e0 THEN -0.1e0 ELSE 0e0 END + CASE WHEN n > 2000 THEN -0.05e0 WHEN n < 200 THEN 0.1e0 ELSE 0e0 END)), 6) AS ratio FROM s"""
)
def reading_profile(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", r6(pr.reading_complexity("text")).alias("reading"), r6(pr.phrase_redundancy("text")).alias("repeats"), r6(pr.rewrite_potential("text")).alias("potential"), pr.reading_minutes("text").alias("minutes"), r6(pr.estimated_ratio("text", F.lit("general"))).alias("ratio"))


# --- rewrites ------------------------------------------------------------------------------

_KEEP = " OR ".join(f"(lower(w) = '{k}' AND coalesce(lower(t[i + 1]) IN {s_in(v)}, false))" for k, v in lx.KEPT_BEFORE.items())
S_DROP = f"array_to_string(list_filter(t, lambda w, i: i = 1 OR lower(w) NOT IN {s_in(lx.DROPPABLE)} OR {_KEEP}), ' ')"


@query(BASE + f"SELECT doc_id, {S_DROP} AS rewritten FROM d")
def remove_function_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", rw.drop_function_words("text").alias("rewritten"))


@query(BASE + "SELECT doc_id, array_to_string(list_filter(t, lambda w, i: i = 1 OR lower(w) <> lower(t[i - 1])), ' ') AS rewritten FROM d")
def dedupe_adjacent(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", rw.drop_adjacent_repeats("text").alias("rewritten"))


S_SQUEEZED = "left(w, 2) || regexp_replace(substr(w, 3, length(w) - 4), '(?i)[aeiou]', '', 'g') || right(w, 2)"


@query(
    BASE
    + rf"""SELECT doc_id, array_to_string(list_transform(t, lambda w: CASE WHEN length(w) > 6 AND regexp_matches(w, '^\p{{L}}+$') AND {s_nsub('lower(w)', lx.CLUSTERS)} >= 2 AND length({S_SQUEEZED}) >= greatest(4e0, length(w) * 0.6e0) THEN {S_SQUEEZED} ELSE w END), ' ') AS rewritten FROM d"""
)
def vowel_squeeze(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", rw.squeeze_long_words("text").alias("rewritten"))


@query(f"SELECT doc_id, {s_unpad(s_fold(s_pad('text'), lx.PHRASES))} AS rewritten FROM documents")
def phrase_rewrite(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", rw.shorten_phrases("text").alias("rewritten"))


@query(f"SELECT doc_id, {s_unpad(s_words_replace(s_words_replace(s_pad('text'), lx.FILLERS, after=r'\s*'), lx.MODIFIERS))} AS rewritten FROM documents")
def filler_removal(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", rw.drop_modifiers(rw.drop_fillers("text")).alias("rewritten"))


@query(
    "SELECT doc_id, "
    + s_unpad(rf"regexp_replace(regexp_replace(regexp_replace({s_pad('text')}, '(?i)\b(?:was|were) (\w+ed) by\b', '\1 via', 'g'), '(?i)\bis (\w+ed) by\b', '\1 via', 'g'), '(?i)\bare being (\w+ed)\b', '\1', 'g')")
    + " AS rewritten FROM documents"
)
def passive_reduction(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", rw.reduce_passive("text").alias("rewritten"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one_line,
    regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '(?m) +$', '', 'g') AS tidy,
    regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.{2,}', '...', 'g'), '!{2,}', '!', 'g'), '\?{2,}', '?', 'g') AS basic,
    trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s*([.!?])\s*', '\1 ', 'g'), '\s*,\s*', ',', 'g')) AS tight FROM documents"""
)
def whitespace_normalise(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", rw.one_line("text").alias("one_line"), rw.tidy_lines("text").alias("tidy"), rw.basic("text").alias("basic"), rw.tight_punctuation("text").alias("tight"))


S_L3 = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^ +| +$', '', 'g'), '^\s+|\s+$', '', 'g')"
S_L2 = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(%s, '[ \t]+', ' ', 'g'), '“”‘’', {QUOTES}), '\s+([,.;:!?])', '\1', 'g'), ',{2,}', ',', 'g'), ';{2,}', ';', 'g'), ':{2,}', ':', 'g')"
S_L2B = r"regexp_replace(regexp_replace(regexp_replace(%s, '\.{4,}', '...', 'g'), '!{2,}', '!', 'g'), '\?{2,}', '?', 'g')"


@query(
    "WITH s AS (SELECT doc_id, text, "
    + S_L3 % s_unpad(s_fold(s_pad("text"), [*lx.ABBREVIATIONS, *lx.SYMBOLS]))
    + " AS l1, "
    + S_L3 % (S_L2B % (S_L2.replace("{QUOTES}", "chr(34) || chr(34) || chr(39) || chr(39)") % "text"))
    + " AS l2, "
    + S_L3 % "text"
    + """ AS l3 FROM documents), u AS (SELECT doc_id, text, 1 AS level, l1 AS out FROM s UNION ALL SELECT doc_id, text, 2, l2 FROM s UNION ALL SELECT doc_id, text, 3, l3 FROM s UNION ALL SELECT doc_id, text, 4, text FROM s),
    r AS (SELECT *, CASE WHEN length(text) = 0 THEN 1e0 ELSE length(out)::DOUBLE / length(text) END AS ratio FROM u)
    SELECT doc_id, level, md5(out) AS digest, round(ratio, 6) AS ratio, round(greatest(1e0, least(10e0, 6e0 + level + CASE WHEN ratio < 0.9e0 THEN 0.5e0 ELSE 0e0 END + CASE WHEN ratio < 0.8e0 THEN 0.5e0 ELSE 0e0 END - CASE WHEN level <= 2 AND ratio < 0.5e0 THEN 1e0 ELSE 0e0 END)), 6) AS quality FROM r"""
)
def fallback_ladder(spark, sf_dir):
    out = en.ladder(docs(spark, sf_dir))
    return out.select("doc_id", F.col("fallback_level").alias("level"), F.md5("compressed_text").alias("digest"), r6(F.col("compression_ratio")).alias("ratio"), r6(F.col("quality_score")).alias("quality"))


# --- segments and extraction -----------------------------------------------------------------


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    f AS (SELECT *, starts_with(ltrim(line), '```') AS fence, regexp_replace(line, '^\s+|\s+$', '', 'g') = '' AS blank FROM l),
    c AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM f),
    b AS (SELECT *, (fences - fence::INT) % 2 = 1 AS code, fence OR (blank AND fences % 2 = 0) AS cut FROM c),
    g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM b),
    s AS (SELECT doc_id, grp, bool_or(code) AS code, string_agg(line, chr(10) ORDER BY i) AS text FROM g WHERE NOT cut GROUP BY doc_id, grp)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INT AS idx, text, CASE WHEN code THEN 'code' ELSE 'text' END AS type FROM s"""
)
def segments(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.inline(sg.segments("text"))).drop("compressible")


@query(
    r"""SELECT page_id, len(u)::BIGINT AS urls, array_to_string(u, ' ') AS found FROM (SELECT page_id, regexp_extract_all(html, 'https?://[^\s<>"'']+') AS u FROM pages)"""
)
def urls(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", sg.urls("html").alias("u"))
    return found.select("page_id", F.size("u").cast("long").alias("urls"), F.array_join("u", " ").alias("found"))


@query(
    BASE
    + rf"""SELECT doc_id, array_to_string(list_filter(list_transform(lt, lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: length(w) > 3 AND w NOT IN {s_in(lx.STOP)} AND NOT regexp_matches(w, '^[0-9]+$')), ' ') AS key_words,
    len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {s_trim('s')}), lambda s: s <> ''))::BIGINT AS sentences,
    len(list_distinct(regexp_extract_all({s_pad('text')}, '\b([A-Z][a-z]+|[0-9]+)\b', 1)))::BIGINT AS entities,
    array_to_string(list_filter({s_list(lx.VERBOSE)}, lambda p: contains(low, p)), ', ') AS verbose FROM d"""
)
def extraction(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(sg.key_words("text"), " ").alias("key_words"), F.size(sg.split_sentences("text")).cast("long").alias("sentences"), F.size(sg.entities("text")).cast("long").alias("entities"), F.array_join(sg.verbose_phrases("text"), ", ").alias("verbose"))


# --- rules -------------------------------------------------------------------------------------


@query(f"SELECT id, original, round(priority * 0.7e0 + success_rate * 300 * 0.3e0, 6) AS effective_priority FROM {RULE_VALUES} WHERE domain = 'general' ORDER BY effective_priority DESC, frequency DESC, id LIMIT 5")
def rule_scan(spark, sf_dir):
    return rl.scan(rl.starter_rules(spark), domain="general", limit=5).select("id", "original", r6(F.col("effective_priority")).alias("effective_priority"))


@query(f"SELECT id, original FROM {RULE_VALUES} WHERE original ILIKE '%ord%' OR compressed ILIKE '%ord%'")
def rule_search(spark, sf_dir):
    return rl.search(rl.starter_rules(spark), "ORD").select("id", "original")


@query(
    f"SELECT coalesce(domain, '*') AS domain, coalesce(pattern_type, '*') AS pattern_type, count(*)::BIGINT AS rules, round(avg(success_rate) FILTER (frequency > 0), 6) AS avg_success FROM {RULE_VALUES} GROUP BY GROUPING SETS ((), (domain), (pattern_type))"
)
def rule_stats(spark, sf_dir):
    return rl.statistics(rl.starter_rules(spark)).withColumn("avg_success", r6(F.col("avg_success")))


@query(f"SELECT CASE WHEN priority >= 900 THEN 'high' WHEN priority >= 700 THEN 'medium' ELSE 'low' END AS band, count(*)::BIGINT AS rules FROM {RULE_VALUES} WHERE priority >= 500 GROUP BY 1")
def rule_bands(spark, sf_dir):
    rules = rl.starter_rules(spark)
    out = None
    for name, low, high in rl.BANDS:
        one = rl.band(rules, low, high).select(F.lit(name).alias("band"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("band").agg(F.count("*").alias("rules"))


@query(
    f"""WITH r AS (SELECT * FROM {RULE_VALUES}), p AS (SELECT a.id AS id_1, b.id AS id_2, greatest(a.priority, b.priority) AS top,
    CASE WHEN a.original = b.compressed AND a.compressed = b.original THEN 'circular' WHEN lower(a.original) = lower(b.original) THEN 'ambiguous' WHEN contains(lower(a.original), lower(b.original)) OR contains(lower(b.original), lower(a.original)) THEN 'substring' WHEN lower(a.compressed) = lower(b.compressed) THEN 'collision' END AS kind
    FROM r a JOIN r b ON a.id < b.id) SELECT id_1, id_2, kind, CASE WHEN kind = 'circular' THEN 'critical' WHEN kind = 'ambiguous' THEN 'high' WHEN top > 800 THEN 'high' ELSE 'medium' END AS severity FROM p WHERE kind IS NOT NULL"""
)
def rule_conflicts(spark, sf_dir):
    return rl.conflicts(rl.starter_rules(spark)).drop("suggestion")


NEW_RULES = [(101, "shipment", "shpt", "word", 700, "general", 0, 0.0), (102, "order", "o", "word", 700, "general", 0, 0.0), (103, "timber", "order", "word", 700, "general", 0, 0.0), (104, "from", "frm", "word", 560, "general", 0, 0.0)]


@query(
    f"WITH r AS (SELECT * FROM {RULE_VALUES}), n(id, original, compressed) AS (VALUES "
    + ", ".join(f"({x[0]}, '{x[1]}', '{x[2]}')" for x in NEW_RULES)
    + ") SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.original = n.compressed) AND NOT EXISTS (SELECT 1 FROM r WHERE r.original = n.original)"
)
def rule_insert_antijoin(spark, sf_dir):
    return rl.insertable(rl.starter_rules(spark, NEW_RULES), rl.starter_rules(spark)).select("id")


@query(f"SELECT id FROM {RULE_VALUES} WHERE len(list_filter({s_toks('compressed')}, lambda w: length(w) <= 2)) = 0 AND NOT regexp_matches(compressed, '[&24]')")
def rule_reversible(spark, sf_dir):
    return rl.starter_rules(spark).where(rl.reversible()).select("id")


@query(
    f"SELECT r.id, count(*)::BIGINT AS documents, sum((length(text) - length(replace(lower(text), lower(original), ''))) // length(original))::BIGINT AS occurrences FROM documents JOIN {RULE_VALUES} ON contains(lower(text), lower(original)) GROUP BY r.id"
)
def match_counts(spark, sf_dir):
    return mt.counts(docs(spark, sf_dir), rl.starter_rules(spark))


S_MATCHES = rf"""c0 AS (SELECT doc_id, r.*, text, string_split(lower(text), lower(original)) AS parts, len(list_filter(range(1, length(original)), lambda k: left(lower(original), k) = right(lower(original), k))) > 0 AS border FROM documents JOIN {RULE_VALUES} ON contains(lower(text), lower(original))),
    p0 AS (SELECT doc_id, id, pattern_type, priority, success_rate, domain, text, compressed, original, list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(original) AS position FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM c0 WHERE NOT border)
      UNION ALL SELECT doc_id, id, pattern_type, priority, success_rate, domain, text, compressed, original, unnest(list_filter(range(0, length(text)), lambda i: substr(lower(text), i + 1, length(original)) = lower(original))) FROM c0 WHERE border),
    m1 AS (SELECT doc_id, id, pattern_type, priority, success_rate, domain, text, compressed, length(original) AS size, position::INT AS position FROM p0),
    m AS (SELECT *, substr(text, position + 1, size) AS original_text, least(1e0, 0.8e0 + least(0.2e0, priority / 5e3) + success_rate * 0.1e0 + CASE WHEN domain = 'general' AND {s_any('lower(substr(text, greatest(0, position - 20) + 1, position + size + 20 - greatest(0, position - 20)))', lx.TECH_CONTEXT)} THEN 0.1e0 ELSE 0e0 END) AS confidence
      FROM m1 WHERE pattern_type <> 'word' OR (NOT regexp_matches(substr(text, position, CASE WHEN position > 0 THEN 1 ELSE 0 END), '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(substr(text, position + size + 1, 1), '[\p{{L}}\p{{N}}]')))"""


@query(f"WITH {S_MATCHES} SELECT doc_id, id, position, original_text, round(confidence, 6) AS confidence FROM m")
def match_positions(spark, sf_dir):
    found = mt.find(docs(spark, sf_dir), rl.starter_rules(spark))
    return found.select("doc_id", "id", "position", "original_text", r6(F.col("confidence")).alias("confidence"))


@query(
    f"""WITH {S_MATCHES} SELECT doc_id, count(*)::BIGINT AS matches, sum(length(original_text) - length(compressed))::BIGINT AS chars_saved, floor(sum(length(original_text) - length(compressed)) / 4e0)::BIGINT AS tokens_saved, round(avg(confidence), 6) AS avg_confidence,
    count(*) FILTER (pattern_type = 'word')::BIGINT AS word_matches, count(*) FILTER (pattern_type = 'phrase')::BIGINT AS phrase_matches, count(*) FILTER (pattern_type = 'compound')::BIGINT AS compound_matches FROM m GROUP BY doc_id"""
)
def match_statistics(spark, sf_dir):
    return mt.statistics(mt.find(docs(spark, sf_dir), rl.starter_rules(spark))).withColumn("avg_confidence", r6(F.col("avg_confidence")))


@query(
    f"""WITH {S_MATCHES}, a AS (SELECT *, coalesce(position >= lag(position + size) OVER w, true) AS new FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY position, priority DESC, id)),
    g AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY position, priority DESC, id ROWS UNBOUNDED PRECEDING) AS grp FROM a),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY round(least(1e0, priority / 1e3) * 0.4e0 + confidence * 0.3e0 + least(1e0, size / 50e0) * 0.2e0 + success_rate * 0.1e0, 9) DESC, position, priority DESC, id) AS rk FROM g)
    SELECT doc_id, grp::BIGINT AS "group", id, position FROM b WHERE rk = 1"""
)
def overlap_groups_best(spark, sf_dir):
    return mt.best_of_groups(mt.find(docs(spark, sf_dir), rl.starter_rules(spark))).select("doc_id", "group", "id", "position")


def s_resolved(source: str = "m") -> str:
    """Rows (doc_id, text, t): of each document its matches after the greedy resolution, as a list in order of position."""
    return f"""(SELECT doc_id, any_value(text) AS text, list_reduce(list_transform(list({{'p': position, 'z': size, 'r': priority, 'i': id, 'c': confidence, 's': compressed, 'u': success_rate}} ORDER BY position, priority DESC, id), lambda x: [x]),
      lambda a, x: CASE WHEN a[-1].p + a[-1].z <= x[1].p THEN a || x WHEN x[1].r > a[-1].r * 1.2e0 OR x[1].c > a[-1].c + 0.2e0 THEN a[:-2] || x ELSE a END) AS t FROM {source} GROUP BY doc_id)"""


S_SPLICED = "array_to_string(list_transform(t, lambda x, i: substr(text, CASE WHEN i = 1 THEN 0 ELSE t[i - 1].p + t[i - 1].z END + 1, x.p - CASE WHEN i = 1 THEN 0 ELSE t[i - 1].p + t[i - 1].z END) || x.s), '') || substr(text, t[-1].p + t[-1].z + 1)"


@query(f"WITH {S_MATCHES}, r AS {s_resolved()}, u AS (SELECT doc_id, unnest(t) AS x FROM r) SELECT doc_id, x.i AS id, x.p AS position, x.z::INT AS size FROM u")
def resolved_matches(spark, sf_dir):
    return mt.resolved(docs(spark, sf_dir), rl.starter_rules(spark)).select("doc_id", "id", "position", "size")


@query(
    f"""WITH {S_MATCHES} SELECT doc_id, id, position FROM m x WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = x.doc_id AND o.position < x.position + x.size AND x.position < o.position + o.size AND
    (o.priority > x.priority OR (o.priority = x.priority AND (o.size > x.size OR (o.size = x.size AND (o.id < x.id OR (o.id = x.id AND o.position < x.position)))))))"""
)
def pairwise_winners(spark, sf_dir):
    return mt.pairwise_elimination(mt.find(docs(spark, sf_dir), rl.starter_rules(spark))).select("doc_id", "id", "position")


@query(f"WITH {S_MATCHES}, r AS {s_resolved()} SELECT d.doc_id, md5(coalesce({S_SPLICED.replace('text', 'r.text')}, d.text)) AS rewritten FROM documents d LEFT JOIN r USING (doc_id)")
def rule_rewrite(spark, sf_dir):
    """Every text with its resolved matches applied, by a fold over the collected matches."""
    d, rules = docs(spark, sf_dir).select("doc_id", "text"), rl.starter_rules(spark)
    found = mt.as_array(mt.resolved(d, rules))
    by_place = F.array_sort("matches", lambda a, b: a["position"] - b["position"])
    return d.join(found, "doc_id", "left").select("doc_id", F.md5(F.when(F.col("matches").isNull(), F.col("text")).otherwise(mt.splice(F.col("text"), by_place))).alias("rewritten"))


# --- engines --------------------------------------------------------------------------------------


def _engine(level: str):
    def run(spark, sf_dir):
        out = en.compress(docs(spark, sf_dir), rl.starter_rules(spark), EngineConfig(level=level, max_chars=2**31 - 1))
        return out.select("doc_id", "engine_used", "compressed_text", "original_tokens", "compressed_tokens", r6(F.col("compression_ratio")).alias("compression_ratio"), r6(F.col("quality_score")).alias("quality_score"))

    return run


for _level, _name in (("light", "semantic_compress"), ("balanced", "hybrid_compress"), ("aggressive", "extreme_compress")):
    QUERIES[_name] = _engine(_level)


@query()
def advanced_compress(spark, sf_dir):
    rules = rl.starter_rules(spark)
    out = en.advanced(docs(spark, sf_dir), en.rule_list(rules, EngineConfig()), EngineConfig())
    return out.select("doc_id", "compressed_text", r6(F.col("compression_ratio")).alias("compression_ratio"))


@query()
def engine_benchmark(spark, sf_dir):
    """Every engine over every document; times differ from run to run and are left out."""
    compared = en.compare_engines(docs(spark, sf_dir), rl.starter_rules(spark))
    return _rounded(en.benchmark(compared).drop("avg_seconds"))


_X1 = BASE + f", a1 AS (SELECT doc_id, text, {S_DROP} AS x FROM d), a2 AS (SELECT doc_id, text, {s_toks(s_unpad(s_fold(s_pad('x'), lx.PHRASES)))} AS t FROM a1), "
_X2 = rf"a3 AS (SELECT doc_id, text, list_transform(t, lambda w: CASE WHEN length(w) > 6 AND regexp_matches(w, '^\p{{L}}+$') AND {s_nsub('lower(w)', lx.CLUSTERS)} >= 2 AND length({S_SQUEEZED}) >= greatest(4e0, length(w) * 0.6e0) THEN {S_SQUEEZED} ELSE w END) AS t FROM a2), "
_X3 = "a4 AS (SELECT doc_id, text, array_to_string(list_filter(t, lambda w, i: i = 1 OR lower(w) <> lower(t[i - 1])), ' ') AS x FROM a3), "
_X4 = rf"a5 AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace({s_pad('x')}, '(?i)\b(?:was|were) (\w+ed) by\b', '\1 via', 'g'), '(?i)\bis (\w+ed) by\b', '\1 via', 'g'), '(?i)\bare being (\w+ed)\b', '\1', 'g') AS x FROM a4), "
S_EXTREME = _X1 + _X2 + _X3 + _X4 + rf"out AS (SELECT doc_id, text, trim(regexp_replace({s_unpad(s_words_replace(s_words_replace('x', lx.FILLERS, after=r'\s*'), lx.MODIFIERS))}, '\s+', ' ', 'g')) AS c FROM a5) "


@query(S_EXTREME + "SELECT doc_id, c AS rewritten, round(CASE WHEN length(text) = 0 THEN 1e0 ELSE length(c)::DOUBLE / length(text) END, 6) AS ratio FROM out")
def plain_extreme(spark, sf_dir):
    out = docs(spark, sf_dir).withColumn("rewritten", en.plain_extreme("text"))
    return out.select("doc_id", "rewritten", r6(q.ratio("text", "rewritten")).alias("ratio"))


@query(
    S_EXTREME
    + f""", v AS (SELECT doc_id, text, c, CASE WHEN length(text) = 0 THEN 1e0 ELSE length(c)::DOUBLE / length(text) END AS r, list_distinct({s_toks('lower(text)')}) AS a, list_distinct({s_toks('lower(c)')}) AS b FROM out),
    k AS (SELECT *, CASE WHEN len(a) = 0 THEN 1e0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS kept FROM v)
    SELECT doc_id, round(10 * (0.4e0 * (1 - abs(r - 0.6e0)) + 0.3e0 + 0.2e0 * CASE WHEN r > 0.2e0 THEN 1e0 ELSE 5 * r END + 0.1e0), 6) AS final, round(least(1e0, 0.7e0 * kept + 0.3e0 * (1 - r)), 6) AS estimate,
    round(CASE WHEN length(text) = 0 OR length(c) = 0 THEN 0e0 ELSE greatest(0e0, least(10e0, 8e0 - CASE WHEN r < 0.3e0 THEN 2e0 WHEN r < 0.5e0 THEN 1e0 WHEN r > 0.9e0 THEN 1.5e0 ELSE 0e0 END - CASE WHEN kept < 0.3e0 THEN 2e0 WHEN kept < 0.5e0 THEN 1e0 ELSE 0e0 END)) END, 6) AS simple FROM k"""
)
def quality_final(spark, sf_dir):
    out = docs(spark, sf_dir).withColumn("c", en.plain_extreme("text"))
    return out.select("doc_id", r6(q.final(q.ratio("text", "c"), 0.6, F.lit(None).cast("double"))).alias("final"), r6(q.extreme_estimate("text", "c")).alias("estimate"), r6(q.simple("text", "c")).alias("simple"))


# --- similarity --------------------------------------------------------------------------------------


@query(
    BASE
    + f""", b AS (SELECT DISTINCT item_id, unnest({s_grams(s_toks('lower(text)'), 5)}) AS gram FROM benchmark), g AS (SELECT DISTINCT doc_id, unnest({s_grams('lt', 5)}) AS gram FROM d)
    SELECT item_id, doc_id, count(*)::BIGINT AS shared FROM b JOIN g USING (gram) GROUP BY item_id, doc_id"""
)
def benchmark_overlap(spark, sf_dir):
    from ..functions.text import ngrams

    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(ngrams(ltoks("text"), 5))).alias("gram"))
    g = docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(ngrams(ltoks("text"), 5))).alias("gram"))
    return b.join(g, "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings),
    s AS (SELECT query_id, vec_id, round(list_cosine_similarity(a, b), 9) AS c FROM q, v WHERE list_cosine_similarity(a, b) >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, rank::INT AS rank, round(c, 6) AS similarity FROM r WHERE rank <= 5"""
)
def cosine_topk(spark, sf_dir):
    """The stated query set (ids divisible by 50) against all rows."""
    v = table(spark, sf_dir, "embeddings")
    return ve.top_k(v.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), v, 5).withColumn("similarity", r6(F.col("similarity")))


@query(f"SELECT p_partkey, r.id, round(1 - levenshtein(lower(p_name), lower(original))::DOUBLE / greatest(length(p_name), length(original)), 6) AS similarity FROM part, {RULE_VALUES}")
def edit_similarity(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").crossJoin(F.broadcast(rl.starter_rules(spark).select("id", "original")))
    return pairs.select("p_partkey", "id", r6(sm.edit("p_name", "original")).alias("similarity"))


# --- metrics -----------------------------------------------------------------------------------------


def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric events of a light rewrite of every document; times and outcomes are functions of the id."""
    m = docs(spark, sf_dir).withColumn("c", rw.one_line(rw.drop_modifiers("text")))
    r = q.ratio("text", "c")
    return m.select(
        F.col("source").alias("session_id"),
        F.col("doc_id").cast("double").alias("timestamp"),
        tk.estimate("text").alias("original_tokens"),
        tk.estimate("c").alias("compressed_tokens"),
        r.alias("compression_ratio"),
        q.final(r, 0.6, F.lit(None).cast("double")).alias("quality_score"),
        F.pmod(F.length("text"), F.lit(700)).alias("processing_time_ms"),
        F.when(F.length("text") > 2500, "hybrid").when(F.length("text") > 800, "semantic").otherwise("extreme").alias("engine_used"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("domain"),
        F.when(F.col("n_chars") > 1500, "balanced").otherwise("light").alias("level"),
        F.size(sg.verbose_phrases("text")).alias("pattern_matches_count"),
        (F.col("doc_id") % 10 != 0).alias("success"),
    )


S_METRICS = f"""WITH c AS (SELECT *, trim(regexp_replace({s_unpad(s_words_replace(s_pad('text'), lx.MODIFIERS))}, '\\s+', ' ', 'g')) AS c FROM documents),
    r AS (SELECT *, CASE WHEN length(text) = 0 THEN 1e0 ELSE length(c)::DOUBLE / length(text) END AS compression_ratio FROM c),
    m AS (SELECT source AS session_id, doc_id::DOUBLE AS timestamp, {S_ESTIMATE} AS original_tokens, {S_ESTIMATE.replace('text', 'c')} AS compressed_tokens, compression_ratio,
      10 * (0.4e0 * (1 - abs(compression_ratio - 0.6e0)) + 0.3e0 + 0.2e0 * CASE WHEN compression_ratio > 0.2e0 THEN 1e0 ELSE 5 * compression_ratio END + 0.1e0) AS quality_score, length(text) % 700 AS processing_time_ms,
      CASE WHEN length(text) > 2500 THEN 'hybrid' WHEN length(text) > 800 THEN 'semantic' ELSE 'extreme' END AS engine_used, CASE WHEN lang <> 'es' THEN lang END AS domain, CASE WHEN n_chars > 1500 THEN 'balanced' ELSE 'light' END AS level,
      len(list_filter({s_list(lx.VERBOSE)}, lambda p: contains(lower(text), p))) AS pattern_matches_count, doc_id % 10 <> 0 AS success FROM r) """


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    S_METRICS
    + """SELECT count(*)::BIGINT AS compressions, count(*) FILTER (success)::BIGINT AS successful, round(count(*) FILTER (success)::DOUBLE / count(*), 6) AS success_rate, sum(original_tokens)::BIGINT AS input_tokens, sum(compressed_tokens)::BIGINT AS output_tokens,
    round(sum(compressed_tokens)::DOUBLE / sum(original_tokens), 6) AS overall_ratio, round(avg(quality_score), 6) AS avg_quality_score, round(min(quality_score), 6) AS min_quality_score, round(max(quality_score), 6) AS max_quality_score,
    round(avg(processing_time_ms), 6) AS avg_processing_time_ms, min(processing_time_ms)::INT AS min_processing_time_ms, max(processing_time_ms)::INT AS max_processing_time_ms, round((1 - avg(compression_ratio)) * avg(quality_score), 6) AS efficiency FROM m"""
)
def metrics_summary(spark, sf_dir):
    return _rounded(me.summary(metrics_table(spark, sf_dir)))


@query(
    S_METRICS
    + "SELECT engine_used, count(*)::BIGINT AS n, round(avg(compression_ratio), 6) AS avg_compression_ratio, round(avg(quality_score), 6) AS avg_quality_score, round(avg(processing_time_ms), 6) AS avg_processing_time_ms, round(avg(pattern_matches_count), 6) AS avg_pattern_matches_count, round((1 - avg(compression_ratio)) * avg(quality_score) / 10, 6) AS efficiency FROM m GROUP BY engine_used"
)
def engine_comparison(spark, sf_dir):
    return _rounded(me.engines(metrics_table(spark, sf_dir)))


@query(S_METRICS + "SELECT coalesce(domain, 'unknown') AS domain, count(*)::BIGINT AS n, round(avg(compression_ratio), 6) AS avg_ratio, round(avg(quality_score), 6) AS avg_quality, round((1 - avg(compression_ratio)) * 100, 6) AS effectiveness FROM m GROUP BY 1")
def domain_analysis(spark, sf_dir):
    return _rounded(me.domains(metrics_table(spark, sf_dir)))


@query(S_METRICS + ", u AS (SELECT engine_used, coalesce(domain, 'unknown') AS domain, level FROM m) SELECT engine_used, domain, level, count(*)::BIGINT AS n FROM u GROUP BY GROUPING SETS ((engine_used), (domain), (level))")
def usage_grouping_sets(spark, sf_dir):
    return me.usage(metrics_table(spark, sf_dir))


@query(
    S_METRICS
    + "SELECT session_id, count(*)::BIGINT AS compressions, sum(original_tokens - compressed_tokens)::BIGINT AS tokens_saved, round(sum(original_tokens - compressed_tokens) * 2e-5, 6) AS cost_saved, round(avg(compression_ratio), 6) AS avg_ratio, round(max(timestamp) - min(timestamp), 6) AS duration_s FROM m GROUP BY session_id"
)
def session_analytics(spark, sf_dir):
    return _rounded(me.sessions(metrics_table(spark, sf_dir)))


@query(
    """WITH o AS (SELECT min(ts) AS t0 FROM events) SELECT floor((epoch_us(ts) - epoch_us(t0)) / 3.6e9)::BIGINT AS bucket, count(*)::BIGINT AS n, round(avg(value), 6) AS avg_value, round(sum(value), 4) AS total FROM events, o GROUP BY 1"""
)
def time_series_tumbling(spark, sf_dir):
    return me.series(table(spark, sf_dir, "events"), "ts", 60, [F.count("*").alias("n"), r6(F.avg("value")).alias("avg_value"), F.round(F.sum("value"), 4).alias("total")])


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts))::BIGINT AS start, epoch_us(max(ts))::BIGINT + 1800000000 AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""
)
def sessions_30min(spark, sf_dir):
    out = me.session_windows(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query(
    """WITH s AS (SELECT user_id, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) / 1e6 AS seconds FROM events)
    SELECT user_id, event_id, round(seconds, 6) AS seconds, round(coalesce(seconds / nullif(sum(seconds) OVER (PARTITION BY user_id), 0), 0e0), 6) AS share FROM s"""
)
def stage_bottlenecks(spark, sf_dir):
    return _rounded(me.bottlenecks(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "seconds", "share"))


@query("SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, round(arg_max(value, (ts, event_id)), 6) AS latest FROM events GROUP BY event_type")
def named_statistics(spark, sf_dir):
    return _rounded(me.named_statistics(table(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk <= 100")
def last_values(spark, sf_dir):
    return me.last_values(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_type", "event_id")


@query("SELECT quality, toxic, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS avg_chars FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic")
def session_feedback_join(spark, sf_dir):
    joined = me.with_feedback(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(joined.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.avg("n_chars").alias("avg_chars")))


@query(
    S_METRICS
    + ", p(model, price) AS (VALUES "
    + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in lx.PRICES.items())
    + ") SELECT model, round(sum((original_tokens - compressed_tokens) / 1e3 * price), 6) AS cost FROM m, p GROUP BY model"
)
def cost_savings(spark, sf_dir):
    prices = spark.createDataFrame(list(lx.PRICES.items()), "model string, price_per_1k double")
    saved = metrics_table(spark, sf_dir).select((F.col("original_tokens") - F.col("compressed_tokens")).alias("token_savings"))
    return _rounded(me.cost_by_model(saved, prices))


# --- mining ------------------------------------------------------------------------------------------


@query(BASE + "SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(lt) AS word FROM d) GROUP BY word ORDER BY n DESC, encode(word) LIMIT 10")
def top_terms(spark, sf_dir):
    return mi.top_words(docs(spark, sf_dir))


@query(
    BASE
    + f", g AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({s_grams('lt', 3)}) AS gram FROM d) GROUP BY doc_id, gram) SELECT doc_id, sum(n - 1)::BIGINT AS repeats, count(*) FILTER (n > 1)::BIGINT AS repeated_grams FROM g GROUP BY doc_id"
)
def repeated_ngrams(spark, sf_dir):
    return mi.repeated(docs(spark, sf_dir))


@query(BASE + ", w AS (SELECT doc_id, list_filter(lt, lambda x: length(x) > 3) AS l FROM d) SELECT doc_id, (len(l) - len(list_distinct(l)))::BIGINT AS repeats FROM w")
def boilerplate(spark, sf_dir):
    return mi.boilerplate(docs(spark, sf_dir))


@query(
    BASE
    + f""", g AS (SELECT lang, unnest(list_concat(list_filter(lt, lambda w: length(w) > 3 AND w NOT IN {s_in(lx.STOP)}), {s_grams('lt', 2)})) AS term FROM d), c AS (SELECT lang, term, count(*)::BIGINT AS n FROM g GROUP BY lang, term),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(term)) AS rank FROM c) SELECT lang, term, n, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def key_phrases(spark, sf_dir):
    return mi.key_phrases(docs(spark, sf_dir))


@query(
    BASE
    + f""", g AS (SELECT doc_id, unnest(list_concat({s_grams('lt', 2)}, {s_grams('lt', 3)})) AS original FROM d), c AS (SELECT doc_id, original, count(*) AS n FROM g GROUP BY doc_id, original),
    f AS (SELECT original, sum(n)::BIGINT AS frequency, count(*)::BIGINT AS documents FROM c GROUP BY original HAVING sum(n) >= 3),
    s AS (SELECT *, array_to_string(list_transform(string_split(original, ' '), lambda w: left(w, 1)), '') AS compressed FROM f)
    SELECT original, compressed, frequency, documents, (frequency * (length(original) - length(compressed)))::BIGINT AS chars_saved FROM s WHERE frequency * (length(original) - length(compressed)) > 0"""
)
def learn_rules(spark, sf_dir):
    return mi.learn_rules(docs(spark, sf_dir))


# --- flagship ----------------------------------------------------------------------------------------


@query(
    S_EXTREME
    + f""", m AS (SELECT o.doc_id, lang, o.text, c FROM out o JOIN documents USING (doc_id)) SELECT lang, count(*)::BIGINT AS documents, sum({S_ESTIMATE})::BIGINT AS input_tokens, sum({S_ESTIMATE.replace('text', 'c')})::BIGINT AS output_tokens,
    round(avg(CASE WHEN length(text) = 0 THEN 1e0 ELSE length(c)::DOUBLE / length(text) END), 6) AS avg_ratio FROM m GROUP BY lang"""
)
def compression_by_lang(spark, sf_dir):
    out = docs(spark, sf_dir).withColumn("c", en.plain_extreme("text"))
    return out.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(tk.estimate("text")).alias("input_tokens"), F.sum(tk.estimate("c")).alias("output_tokens"), r6(F.avg(q.ratio("text", "c"))).alias("avg_ratio"))
