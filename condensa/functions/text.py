"""Building blocks over text columns: tokens, counts, n-grams, set similarity. All JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a whole word, for letters of all scripts, whatever the Java version's \b means
LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quoted(literal: str) -> str:
    """A literal as a Java regular expression."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def replacement(literal: str) -> str:
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def toks(x) -> Column:
    """Blank-separated tokens, without empty ones; of a null text none."""
    return F.filter(F.split(F.coalesce(col(x), F.lit("")), r"\s+"), lambda t: t != "")


def ltoks(x) -> Column:
    return toks(F.lower(col(x)))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where f uses it inside lambdas (these compute expressions anew for every element)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def share(a, b) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def nocc(x, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    c = col(x)
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal)))) / len(literal)).cast("long")


def total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def nocc_all(x, literals: Sequence[str]) -> Column:
    return total([nocc(x, s) for s in literals])


def any_sub(x, literals: Sequence[str]) -> Column:
    low = F.lower(col(x))
    out = F.lit(False)
    for s in literals:
        out = out | F.contains(low, F.lit(s))
    return out


def n_sub(x, literals: Sequence[str]) -> Column:
    """How many of the literals occur in the lower-cased text."""
    low = F.lower(col(x))
    return total([F.contains(low, F.lit(s)).cast("long") for s in literals])


def any_sub_token(t: Column, literals: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in literals:
        out = out | F.contains(t, F.lit(s))
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; both empty 1, one empty 0."""
    of = lambda u, v: F.when((F.size(u) == 0) & (F.size(v) == 0), F.lit(1.0)).when((F.size(u) == 0) | (F.size(v) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v)))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: of(s["a"], s["b"]))


def word_jaccard(x, y) -> Column:
    return jaccard(ltoks(x), ltoks(y))


def ngrams(tokens: Column, n: int) -> Column:
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))
    return let(tokens, lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(grams(t)))


def ngram_hashes(tokens: Column, n: int) -> Column:
    """A 64-bit hash of each n-gram: for counting, where its words aren't needed."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.xxhash64(F.slice(t, i, F.lit(n))))
    return let(tokens, lambda t: F.when(F.size(t) < n, F.array().cast("array<bigint>")).otherwise(grams(t)))


def sentences(x) -> Column:
    """Trimmed parts between full stops that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), r"\."), lambda s: trimmed(s)), lambda s: s != "")


def trimmed(x) -> Column:
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def rcount(x, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(col(x), F.lit(pattern)), F.lit(0)).cast("long")


def avg_words(parts: Column) -> Column:
    """Mean number of tokens of an array of texts, 0 if it has none."""
    return share(F.aggregate(parts, F.lit(0), lambda a, s: a + F.size(toks(s))), F.size(parts))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
