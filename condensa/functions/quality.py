"""Scores of rewritten texts against their originals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx
from .segment import entities
from .text import LEFT, RIGHT, any_sub_token, clamp, col, jaccard, let, ltoks, n_sub, ngrams, rcount, sentences, share, toks, trimmed

WEIGHTS = {"semantic": 0.35, "density": 0.20, "efficiency": 0.15, "interpretability": 0.15, "structure": 0.10, "coherence": 0.03, "entities": 0.02}


def ratio(o, c) -> Column:
    return F.when(F.length(col(o)) == 0, 1.0).otherwise(share(F.length(col(c)), F.length(col(o))))


def final(r: Column, target: float, avg_confidence: Column, time_score: float = 1.0) -> Column:
    """0 to 10; the time term is a parameter, as measured times would make results differ."""
    return 10 * (0.4 * (1 - F.abs(r - target)) + 0.3 * F.coalesce(avg_confidence, F.lit(1.0)) + 0.2 * F.when(r > 0.2, 1.0).otherwise(5 * r) + 0.1 * max(0.5, time_score))


def extreme_estimate(o, c) -> Column:
    a, b = F.array_distinct(ltoks(o)), F.array_distinct(ltoks(c))
    kept = F.when(F.size(a) == 0, 1.0).otherwise(share(F.size(F.array_intersect(a, b)), F.size(a)))
    return F.least(F.lit(1.0), 0.7 * kept + 0.3 * (1 - ratio(o, c)))


# --- what several parts of the composite score read of a text; bind these in columns before use in many places


def word_list(lowered) -> Column:
    """Tokens of a lower-cased text."""
    return toks(lowered)


def concepts_of(words, stop=lx.STOP, stems=lx.STEMS) -> Column:
    """Of lower-case tokens those over three characters that are no stop words, and bigrams with one of the stems; repeats stay."""
    of = lambda w: F.concat(F.filter(w, lambda t: (F.length(t) > 3) & ~t.isin(stop)), F.filter(ngrams(w, 2), lambda b: any_sub_token(b, stems)))
    return let(col(words), of)


def sentence_lengths(x) -> Column:
    """Tokens of each sentence."""
    return F.transform(sentences(x), lambda s: F.size(toks(s)))


def _mean(lengths: Column) -> Column:
    return share(F.aggregate(lengths, F.lit(0), lambda a, n: a + n), F.size(lengths))


def sentence_structure_of(a: Column, b: Column) -> Column:
    lengths = F.when((F.size(b) > 0) & (_mean(a) > 0), share(_mean(b), _mean(a))).otherwise(1.0)
    return F.when(F.size(a) == 0, 1.0).otherwise(clamp((share(F.size(b), F.size(a)) + lengths) / 2, 0.2, 1.0))


def sentence_structure(o, c) -> Column:
    return let(F.struct(sentence_lengths(o).alias("a"), sentence_lengths(c).alias("b")), lambda s: sentence_structure_of(s["a"], s["b"]))


def semantic_of(c, words: Column, sets: tuple[Column, Column], keys: Column, stops: tuple[Column, Column]) -> Column:
    kept = let(F.struct(keys.alias("k"), F.lower(col(c)).alias("low")), lambda s: F.when(F.size(s["k"]) == 0, 1.0).otherwise(share(F.size(F.filter(s["k"], lambda k: F.contains(s["low"], k))), F.size(s["k"]))))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.least(F.lit(1.0), 0.4 * jaccard(*sets) + 0.4 * kept + 0.2 * sentence_structure_of(*stops)))


def semantic(o, c) -> Column:
    """Word overlap, key concepts still contained, and like sentences."""
    return semantic_of(c, ltoks(o), (ltoks(o), ltoks(c)), concepts_of(ltoks(o)), (sentence_lengths(o), sentence_lengths(c)))


def density_of(o, c, keys: tuple[Column, Column]) -> Column:
    info = let(F.struct(F.array_distinct(keys[0]).alias("a"), keys[1].alias("b")), lambda s: F.when(F.size(s["a"]) == 0, 1.0).otherwise(share(F.size(F.array_intersect(s["a"], s["b"])), F.size(s["a"]))))
    r = ratio(o, c)
    return F.when(F.length(col(c)) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.when(r < 1, share(info, r)).otherwise(info)))


def density(o, c) -> Column:
    return density_of(o, c, (concepts_of(ltoks(o)), concepts_of(ltoks(c))))


def efficiency(o, c) -> Column:
    r = ratio(o, c)
    e = F.when((r >= 0.3) & (r <= 0.7), 1 - 2 * F.abs(r - 0.5)).when(r < 0.3, 0.5 - (0.3 - r)).otherwise(1 - 2 * (r - 0.7))
    return F.when(F.length(col(o)) == 0, 1.0).otherwise(clamp(e, 0.0, 1.0))


def interpretability_of(c, words: Column, terms: list[str] | None = None) -> Column:
    x = col(c)
    caps = share(rcount(x, LEFT + "[A-Z]{2,}" + RIGHT), F.size(words))
    score = 0.8 - F.when(caps > 0.3, 0.2).otherwise(0.0) + n_sub(c, lx.CLUES) / len(lx.CLUES) * 0.1
    if terms:
        score = score + n_sub(c, terms) / len(terms) * 0.1
    symbols = share(rcount(x, r"[^\p{L}\p{N}_\s]"), F.length(x))
    return clamp(score - F.when(symbols > 0.2, (symbols - 0.2) * 0.5).otherwise(0.0), 0.0, 1.0)


def interpretability(c, terms: list[str] | None = None) -> Column:
    return interpretability_of(c, toks(c), terms)


def structure_of(o, c, stops: tuple[Column, Column]) -> Column:
    parts = lambda x: F.size(F.filter(F.split(F.coalesce(col(x), F.lit("")), "\n\n"), lambda p: trimmed(p) != ""))
    items = lambda x: rcount(x, r"(?m)^ *[-*•] ")
    part = lambda n, m, least: F.when(m > least, F.least(F.lit(1.0), share(n, m))).otherwise(1.0)
    return 0.5 * part(F.size(stops[1]), F.size(stops[0]), 0) + 0.3 * part(parts(c), parts(o), 1) + 0.2 * part(items(c), items(o), 0)


def structure(o, c) -> Column:
    return structure_of(o, c, (sentence_lengths(o), sentence_lengths(c)))


def coherence_of(c, words: Column) -> Column:
    single = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}$")))
    issues = rcount(c, r"[\p{L}\p{N}_][^\p{L}\p{N}_\s][\p{L}\p{N}_]")
    mean = share(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)), F.size(words))
    score = 0.8 - F.when(single > F.size(words) * 0.3, 0.3).otherwise(0.0) - F.least(F.lit(0.2), issues * 0.05) - F.when(mean < 2, 0.2).when(mean > 12, 0.1).otherwise(0.0)
    return F.when(F.size(words) == 0, 0.0).when(F.size(words) < 2, 0.5).otherwise(clamp(score, 0.0, 1.0))


def coherence(c) -> Column:
    return coherence_of(c, toks(c))


def entity_preservation_of(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, 1.0).otherwise(share(F.size(F.array_intersect(a, b)), F.size(a)))


def entity_preservation(o, c) -> Column:
    return entity_preservation_of(entities(o), entities(c))


def components(o, c, terms: list[str] | None = None) -> dict[str, Column]:
    return {"semantic": semantic(o, c), "density": density(o, c), "efficiency": efficiency(o, c), "interpretability": interpretability(c, terms), "structure": structure(o, c), "coherence": coherence(c), "entities": entity_preservation(o, c)}


def components_of(o, c, of_o: str, of_c: str, terms: list[str] | None = None) -> dict[str, Column]:
    """The same from bound columns: the patterns give the names of words, set, keys, stops and names for each side."""
    a, b = ({k: F.col(p.format(k)) for k in ("words", "set", "keys", "stops", "names")} for p in (of_o, of_c))
    stops = (a["stops"], b["stops"])
    return {
        "semantic": semantic_of(c, a["words"], (a["set"], b["set"]), a["keys"], stops),
        "density": density_of(o, c, (a["keys"], b["keys"])),
        "efficiency": efficiency(o, c),
        "interpretability": interpretability_of(c, b["words"], terms),
        "structure": structure_of(o, c, stops),
        "coherence": coherence_of(c, b["words"]),
        "entities": entity_preservation_of(a["names"], b["names"]),
    }


def composite(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + parts[name] * weight
    return out * 10


def critical_terms(o, c, terms=lx.CRITICAL) -> Column:
    a, b = F.lower(col(o)), F.lower(col(c))
    own = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(a, t))
    kept = F.filter(own, lambda t: F.contains(b, t))
    return F.struct(F.size(own).cast("long").alias("original"), F.size(kept).cast("long").alias("preserved"), F.when(F.size(own) == 0, 1.0).otherwise(share(F.size(kept), F.size(own))).alias("rate"))


def simple(o, c, avg_confidence: Column | None = None) -> Column:
    r, a = ratio(o, c), F.array_distinct(ltoks(o))
    kept = F.when(F.size(a) == 0, 1.0).otherwise(share(F.size(F.array_intersect(a, F.array_distinct(ltoks(c)))), F.size(a)))
    score = F.lit(8.0) - F.when(r < 0.3, 2.0).when(r < 0.5, 1.0).when(r > 0.9, 1.5).otherwise(0.0) - F.when(kept < 0.3, 2.0).when(kept < 0.5, 1.0).otherwise(0.0)
    if avg_confidence is not None:
        score = score + F.coalesce(avg_confidence * 1.5, F.lit(0.0))
    return F.when((F.length(col(o)) == 0) | (F.length(col(c)) == 0), 0.0).otherwise(clamp(score, 0.0, 10.0))


def fallback(level: Column, r: Column) -> Column:
    base = 6.0 + level + F.when(r < 0.9, 0.5).otherwise(0.0) + F.when(r < 0.8, 0.5).otherwise(0.0) - F.when((level <= 2) & (r < 0.5), 1.0).otherwise(0.0)
    return clamp(base, 1.0, 10.0)


def minimum(level: Column, high: bool = False) -> Column:
    return clamp(F.lit(7.5 if high else 6.0) + F.when(level == "light", 1.0).when(level == "aggressive", -1.0).otherwise(0.0), 4.0, 9.0)


def validate(o, c) -> Column:
    """A score from 10 down, and the issues that lowered it."""
    r, w = ratio(o, c), share(F.size(toks(c)), F.size(toks(o)))
    x = col(c)
    open_ = rcount(x, r"[(\[{]") != rcount(x, r"[)\]}]")
    checks = [(r < 0.3, 3.0, "over-compressed"), (w < 0.5, 2.0, "many words lost"), (F.size(toks(c)) < 3, 1.0, "too short"), (open_, 1.0, "unbalanced brackets")]
    score = F.lit(10.0)
    for when, less, _ in checks:
        score = score - F.when(when, less).otherwise(0.0)
    return F.struct(F.greatest(F.lit(0.0), score).alias("score"), F.array_compact(F.array(*[F.when(when, F.lit(text)) for when, _, text in checks])).alias("issues"))


def warnings(r: Column, quality: Column) -> Column:
    return F.array_compact(F.array(F.when(r < 0.3, "very strong compression"), F.when(r > 0.95, "little compression"), F.when(quality < 0.75, "low quality estimate")))
