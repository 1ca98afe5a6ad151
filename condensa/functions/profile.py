"""Profiles of texts: densities, complexity, domain, content type, readiness for compression.

Functions that read tokens take them as an optional column (``words``: as they
are, ``low``: in lower case), so that a plan with several profiles binds them once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx
from .text import LEFT, RIGHT, any_sub_token, avg_words, clamp, col, let, ltoks, n_sub, ngram_hashes, ngrams, nocc, nocc_all, quoted, rcount, sentences, share, toks, total, trimmed

CAMEL, ACRONYM, SNAKE, KEBAB, VERSION = r"[A-Za-z0-9_]+[A-Z][A-Za-z0-9_]*", "[A-Z]{2,}", "[A-Za-z0-9]+_[A-Za-z0-9]+", "[A-Za-z0-9]+-[A-Za-z0-9]+", r"v?[0-9]+\.[0-9]+"


def words(x) -> Column:
    return F.size(toks(x))


def technical_density(x, stems=lx.TECH, low: Column | None = None) -> Column:
    """Share of tokens that contain a technical stem."""
    t = ltoks(x) if low is None else low
    return share(F.size(F.filter(t, lambda w: any_sub_token(w, stems))), F.size(t))


def structural_complexity(x, low: Column | None = None) -> Column:
    c = col(x)
    marks = rcount(c, "[.!?]") + rcount(c, ",") * 0.5 + rcount(c, ";") * 0.8 + rcount(c, "[()]") * 0.3 + rcount(c, "[-*•]") * 0.6
    return F.least(F.lit(1.0), share(marks, words(x) if low is None else F.size(low)) * 10)


def domain_specificity(x, domain: str | None, domains=lx.DOMAINS) -> Column:
    if not domain or domain not in domains:
        return F.lit(0.5)
    return n_sub(x, domains[domain]) / len(domains[domain])


def redundancy(x, low: Column | None = None) -> Column:
    """1 minus the share of distinct tokens; 0 without tokens."""
    t = ltoks(x) if low is None else low
    return F.when(F.size(t) == 0, 0.0).otherwise(1 - share(F.size(F.array_distinct(t)), F.size(t)))


def repeated_ngrams(x, sizes=(2, 3, 4), low: Column | None = None) -> Column:
    """n for every n-gram that occurs more than once, counted by hashes."""
    return total([let(ltoks(x) if low is None else low, lambda t: seen_again(ngram_hashes(t, n))) * n for n in sizes]).cast("long")


def seen_again(values: Column) -> Column:
    """How many distinct values occur more than once: in sorted order a second occurrence equals the one before it, not the one two before."""
    return let(F.sort_array(values), lambda g: F.size(F.filter(g, lambda v, i: (i > 0) & (v == F.get(g, i - 1)) & ((i == 1) | (v != F.get(g, i - 2))))))


def verbose_count(x, verbose=lx.VERBOSE) -> Column:
    return nocc_all(F.lower(col(x)), verbose)


def compression_potential(x, own: Column | None = None, low: Column | None = None) -> Column:
    t = toks(x) if own is None else own
    n = F.size(t)
    long_words = F.size(F.filter(t, lambda w: F.length(w) > 8))
    return F.least(F.lit(1.0), share(long_words, n) * 0.3 + share(repeated_ngrams(x, low=low), n) * 0.3 + share(verbose_count(x), n) * 0.2 + redundancy(x, low) * 0.2)


def quality_sensitivity(x, formal=lx.FORMAL, low: Column | None = None) -> Column:
    n = words(x) if low is None else F.size(low)
    return F.least(F.lit(1.0), technical_density(x, low=low) * 0.4 + structural_complexity(x, low) * 0.3 + F.least(F.lit(0.3), share(n_sub(x, formal), n) * 10))


def strategy(sensitivity: Column, potential: Column, level: Column) -> Column:
    return F.when(sensitivity > 0.7, "semantic").when((potential > 0.8) & (sensitivity < 0.4), "extreme").when(level == "aggressive", "extreme").when(level == "light", "semantic").otherwise("hybrid")


def recommended_engine(sensitivity: Column, potential: Column, length: Column, density: Column) -> Column:
    return F.when(sensitivity > 0.7, "semantic").when((potential > 0.8) & (sensitivity < 0.3), "extreme").when(length > 5000, "hybrid").when(density > 0.6, "semantic").otherwise("hybrid")


def domain_scores(x, domains=lx.DOMAINS) -> dict[str, Column]:
    """Occurrences of each domain's keywords, weighted by their number of words."""
    low = F.lower(col(x))
    return {d: total([nocc(low, k) * len(k.split()) for k in keys]) for d, keys in domains.items()}


def domain_of(x, domains=lx.DOMAINS) -> Column:
    scores = domain_scores(x, domains)
    best = F.greatest(*scores.values())
    out = F.lit("general")
    for d, s in reversed(scores.items()):
        out = F.when(s == best, d).otherwise(out)
    return F.when(best > 0, out).otherwise("general")


def domain_confidence(x, domains=lx.DOMAINS) -> Column:
    scores = domain_scores(x, domains)
    every = total(list(scores.values()))
    return F.create_map(*[c for d, s in scores.items() for c in (F.lit(d), share(s, every))])


def content_scores(x, patterns=lx.CONTENT_PATTERNS) -> dict[str, Column]:
    return {kind: total([rcount(x, f"(?im){p}") for p in ps]) for kind, ps in patterns.items()}


def content_type(x, patterns=lx.CONTENT_PATTERNS) -> Column:
    c, scores = col(x), content_scores(x, patterns)
    every, best = total(list(scores.values())), F.greatest(*scores.values())
    kind = F.lit("general")
    for k, s in reversed(scores.items()):
        kind = F.when(s == best, k).otherwise(kind)
    rows, stops = F.size(F.split(c, "\n")), F.size(F.split(c, r"\. "))
    other = F.when(rows > stops, "structured").when(F.contains(c, F.lit(".")) & (stops > 2), "prose").otherwise("general")
    return F.when((every > 0) & (share(best, every) > 0.3), kind).otherwise(other)


def analyzer_density(x, terms=lx.TECH) -> Column:
    c, t = col(x), ltoks(x)
    patterns = total([rcount(c, p) for p in (CAMEL, ACRONYM, SNAKE, KEBAB, VERSION)])
    return F.least(F.lit(1.0), share(F.size(F.filter(t, lambda w: w.isin(terms))) + patterns, F.size(t)))


def complexity(x) -> Column:
    """Mean of sentence length, lexical diversity, technical density and nesting, each at most 1; 0 for empty texts."""
    c, s, t = col(x), sentences(x), ltoks(x)
    nesting = total([rcount(c, p) for p in (r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}", "\n\n")])
    parts = F.least(F.lit(1.0), avg_words(s) / 20) + share(F.size(F.array_distinct(t)), F.size(t)) + analyzer_density(x) + F.least(F.lit(1.0), share(nesting, F.size(t)))
    return F.when(F.size(t) == 0, 0.0).otherwise(parts / F.when(F.size(s) > 0, 4).otherwise(3))


def readiness(x) -> Column:
    t = ltoks(x)
    repeated = share(F.least(F.lit(10), seen_again(t)), F.size(F.array_distinct(t)))
    verbose = F.least(F.lit(1.0), share(verbose_count(x), F.size(t)) * 10)
    pairs = rcount(x, r"[A-Za-z0-9_]{8,}\s+[A-Za-z0-9_]{8,}")
    short = F.least(F.lit(1.0), share(pairs, F.greatest(F.lit(1), F.floor(F.size(t) / 10))))
    return F.struct(
        repeated.alias("redundancy"),
        verbose.alias("verbosity"),
        short.alias("abbreviation_potential"),
        (repeated * 0.4 + verbose * 0.3 + short * 0.3).alias("overall"),
        F.array_compact(F.array(F.when(repeated > 0.3, "redundant words"), F.when(verbose > 0.2, "verbose phrases"), F.when(short > 0.3, "long phrases"))).alias("advice"),
    )


def language_characteristics(x, connectives=lx.CONNECTIVES) -> Column:
    c, t, s = col(x), toks(x), sentences(x)
    bare = F.transform(t, lambda w: F.length(F.regexp_replace(w, r"""^[.,!?;:"()\[\]{}]+|[.,!?;:"()\[\]{}]+$""", "")))
    return F.struct(
        share(F.aggregate(bare, F.lit(0), lambda a, n: a + n), F.size(t)).alias("avg_word_length"),
        share(rcount(c, r"""[.,!?;:"()\[\]{}/-]"""), F.length(c)).alias("punctuation_density"),
        rcount(c, "[A-Z]{2,}").alias("all_caps"),
        rcount(c, "[A-Z][a-z]+").alias("title_case"),
        rcount(c, "[a-z]+[A-Z]").alias("camel_case"),
        F.when(F.size(s) == 0, 0.0).otherwise(F.least(F.lit(1.0), (avg_words(s) / 15 + share(nocc_all(F.lower(c), connectives), F.size(t))) / 2)).alias("complexity"),
    )


def text_structure(x) -> Column:
    c = col(x)
    parts = F.size(F.filter(F.split(c, "\n\n"), lambda p: trimmed(p) != ""))
    stops, items = F.size(sentences(x)), rcount(c, r"(?m)^ *[-*•] +") + rcount(c, r"(?m)^ *[0-9]+\. +")
    headers, code = rcount(c, "(?m)^#+ ") > 0, F.contains(c, F.lit("```"))
    kind = F.when(headers & (parts > 3), "hierarchical").when(items > 0, "list-based").when(parts > 1, "multi-paragraph").when(stops > 5, "narrative").otherwise("flat")
    return F.struct(parts.cast("long").alias("paragraphs"), stops.cast("long").alias("sentences"), items.alias("list_items"), headers.alias("has_headers"), code.alias("has_code"), kind.alias("structure"))


def recommended_strategy(domain: Column, content: Column, density: Column, complex_: Column, ready: Column) -> Column:
    """Level, engine and the reasons, where each later finding may change what earlier ones chose."""
    engine = F.when(density > 0.7, "semantic").when(domain.isin("finance"), "semantic").otherwise("hybrid")
    by_content = F.when(content == "code", "light").when(content == "prose", "aggressive").otherwise("balanced")
    by_density = F.when(density > 0.7, by_content).when(density < 0.3, "aggressive").otherwise(by_content)
    by_complexity = F.when(complex_ > 0.8, "light").when(complex_ < 0.4, "aggressive").otherwise(by_density)
    level = F.when((ready > 0.7) & (by_complexity == "balanced"), "aggressive").when((ready < 0.3) & (by_complexity == "aggressive"), "balanced").otherwise(by_complexity)
    reasons = [
        F.when(domain.isin("finance"), "terms of the domain"),
        F.when(content == "code", "code stays").when(content == "documentation", "documentation").when(content == "prose", "prose"),
        F.when(density > 0.7, "many technical terms").when(density < 0.3, "few technical terms"),
        F.when(complex_ > 0.8, "complex").when(complex_ < 0.4, "simple"),
        F.when(ready > 0.7, "much to save").when(ready < 0.3, "little to save"),
    ]
    return F.struct(level.alias("level"), engine.alias("engine"), F.array_compact(F.array(*reasons)).alias("reasons"))


def variant_profile(x, tech=lx.VARIANT_TECH, domain=lx.VARIANT_DOMAIN, formal=lx.VARIANT_FORMAL) -> Column:
    """The variant's five ratios: terms of three lists by word, brackets by character, repeats of long words by word; each at most 1."""
    c = col(x)
    whole = lambda words: f"(?iu){LEFT}(?:" + "|".join(map(quoted, words)) + f"){RIGHT}"
    least = lambda a, b: F.least(F.lit(1.0), share(a, b))

    def of(t: Column) -> Column:
        long_words = F.filter(t, lambda w: F.length(w) > 3)
        return F.struct(
            F.size(t).cast("long").alias("words"),
            least(rcount(c, whole(tech)), F.size(t)).alias("technical"),
            least(rcount(c, r"[{}()\[\]<>]"), F.length(c)).alias("structural"),
            least(rcount(c, whole(domain)), F.size(t)).alias("domain"),
            least(F.size(long_words) - F.size(F.array_distinct(long_words)), F.size(t)).alias("potential"),
            least(rcount(c, whole(formal)), F.size(t)).alias("sensitivity"),
        )

    return let(ltoks(x), of)


def recommended_level(domain: Column, content: Column, density: Column, complex_: Column, ready: Column) -> Column:
    return F.when(content == "code", "light").when(domain == "finance", "light").when(density > 0.7, "light").when(complex_ > 0.8, "light").when(ready > 0.6, "aggressive").otherwise("balanced")


def target_compression(complex_: Column, density: Column, ready: Column) -> Column:
    moved = F.lit(0.6) + F.when(complex_ > 0.8, 0.2).when(complex_ < 0.3, -0.1).otherwise(0.0) + F.when(density > 0.7, 0.15).when(density < 0.2, -0.1).otherwise(0.0)
    return clamp(moved + F.when(ready > 0.7, -0.1).when(ready < 0.3, 0.1).otherwise(0.0), 0.2, 0.9)


def characteristics(x) -> Column:
    c, t = col(x), toks(x)
    stops = F.size(F.split(c, r"[.!?]+"))
    return F.struct(
        F.length(c).cast("long").alias("chars"),
        F.size(t).cast("long").alias("words"),
        F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: trimmed(s) != "")).cast("long").alias("sentences"),
        share(F.aggregate(t, F.lit(0), lambda a, w: a + F.length(w)), F.size(t)).alias("avg_word_length"),
        share(F.size(t), stops).alias("avg_sentence_length"),
    )


def formality(x, formal=lx.FORMAL, informal=lx.INFORMAL) -> Column:
    f, i = n_sub(x, formal), n_sub(x, informal)
    return F.when(f + i == 0, 0.5).otherwise(share(f, f + i))


def phrase_redundancy(x) -> Column:
    """Repeats of words plus twice those of three-word phrases, per word; 0 under ten words."""
    t = ltoks(x)
    g = ngrams(t, 3)
    extra = lambda a: F.size(a) - F.size(F.array_distinct(a))
    return F.when(F.size(t) < 10, 0.0).otherwise(F.least(F.lit(1.0), share(extra(t) + extra(g) * 2, F.size(t))))


def rewrite_potential(x) -> Column:
    t, n = toks(x), words(x)
    return F.least(F.lit(1.0), share(F.size(F.filter(t, lambda w: F.length(w) > 8)), n) + F.least(F.lit(0.3), share(n_sub(x, lx.VERBOSE), n)) + technical_density(x) * 0.4 + phrase_redundancy(x) * 0.3)


def char_distribution(x) -> Column:
    c, n, t = col(x), F.length(col(x)), toks(x)
    alpha, digit, space = rcount(c, r"\p{L}"), rcount(c, "[0-9]"), rcount(c, r"\s")
    return F.struct(
        share(alpha, n).alias("alphabetic"),
        share(digit, n).alias("numeric"),
        share(space, n).alias("whitespace"),
        share(n - alpha - digit - space, n).alias("punctuation"),
        F.size(F.filter(t, lambda w: w.rlike("^.[^A-Z]*[A-Z]"))).cast("long").alias("camel_case"),
        rcount(c, r"[^\p{L}\p{N}\s]").alias("special"),
        share(F.size(F.array_distinct(t)), F.size(t)).alias("diversity"),
    )


def reading_complexity(x) -> Column:
    t = toks(x)
    s = F.size(F.filter(F.split(col(x), r"[.!?]+"), lambda v: trimmed(v) != ""))
    chars = F.aggregate(t, F.lit(0), lambda a, w: a + F.length(w))
    return F.least(share(F.size(t), s) / 20, F.lit(1.0)) * 0.4 + F.least(share(chars, F.size(t)) / 8, F.lit(1.0)) * 0.3 + share(F.size(F.array_distinct(ltoks(x))), F.size(t)) * 0.3


def reading_minutes(x) -> Column:
    return F.ceil(words(x) / 200).cast("long")


def estimated_ratio(x, domain: Column) -> Column:
    """What a compression may leave, from complexity, domain and length."""
    n, k = F.length(col(x)), reading_complexity(x)
    base = F.lit(0.7) + F.when(k > 0.8, 0.1).when(k < 0.3, -0.1).otherwise(0.0)
    base = base * F.when(domain == "finance", 0.95).when(domain == "support", 0.9).when(domain == "logistics", 0.85).otherwise(1.0)
    return clamp(base + F.when(n > 2000, -0.05).when(n < 200, 0.1).otherwise(0.0), 0.5, 0.95)


def potential_with_advice(x) -> Column:
    k, d, r, q = reading_complexity(x), technical_density(x), phrase_redundancy(x), formality(x)
    p = clamp(0.3 + 0.4 * r + 0.2 * d + 0.15 * k - 0.1 * q, 0.1, 0.8)
    return F.struct(p.alias("potential"), F.array_compact(F.array(F.when(r > 0.3, "repetitive"), F.when(d > 0.3, "technical"), F.when(p > 0.6, "aggressive"), F.when(q > 0.7, "formal"))).alias("advice"))
