"""Rewrites of text: every function takes a column and gives a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx
from .text import LEFT, RIGHT, col, let, quoted, replacement, toks


def _words(alternatives: list[str]) -> str:
    return f"(?iu){LEFT}(?:" + "|".join(map(quoted, alternatives)) + f"){RIGHT}"


def _fold(x, rules, pattern=lambda s: f"(?iu){LEFT}{quoted(s)}{RIGHT}") -> Column:
    out = col(x)
    for original, short in rules:
        out = F.regexp_replace(out, pattern(original), replacement(short))
    return out


def drop_function_words(x, droppable=lx.DROPPABLE, kept_before=lx.KEPT_BEFORE) -> Column:
    """Tokens but those in the list; the first stays, as does one before certain words."""
    essential = lambda t, w, i: F.exists(
        F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v)).alias("v")) for k, v in kept_before.items()]),
        lambda e: (e["k"] == F.lower(w)) & F.coalesce(F.array_contains(e["v"], F.lower(F.get(t, i + 1))), F.lit(False)),
    )
    kept = let(toks(x), lambda t: F.filter(t, lambda w, i: (i == 0) | ~F.lower(w).isin(droppable) | essential(t, w, i)))
    return F.array_join(kept, " ")


def shorten_phrases(x, phrases=lx.PHRASES) -> Column:
    return _fold(x, phrases)


def squeeze_vowels(w: Column) -> Column:
    """First, last, second and last-but-one characters stay, vowels between go, unless too little is left."""
    short = F.concat(F.left(w, F.lit(2)), F.regexp_replace(w.substr(F.lit(3), F.length(w) - 4), "(?i)[aeiou]", ""), F.right(w, F.lit(2)))
    return F.when((F.length(w) <= 6) | (F.length(short) < F.greatest(F.lit(4.0), F.length(w) * 0.6)), w).otherwise(short)


def squeeze_long_words(x, clusters=lx.CLUSTERS) -> Column:
    """Vowel squeeze of alphabetic words of over six characters with two kinds of consonant clusters."""

    def word(w):
        low = F.lower(w)
        kinds = F.size(F.filter(F.array(*map(F.lit, clusters)), lambda c: F.contains(low, c)))
        return F.when((F.length(w) > 6) & w.rlike(r"^\p{L}+$") & (kinds >= 2), squeeze_vowels(w)).otherwise(w)

    return F.array_join(F.transform(toks(x), word), " ")


def drop_adjacent_repeats(x) -> Column:
    """A token equal (in lower case) to the one before it in the text goes."""
    kept = let(toks(x), lambda t: F.filter(t, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(t, i - 1)))))
    return F.array_join(kept, " ")


def reduce_passive(x, rules=lx.PASSIVE) -> Column:
    out = col(x)
    for pattern, short in rules:
        out = F.regexp_replace(out, f"(?iu){LEFT}{pattern}{RIGHT}", short)
    return out


def drop_fillers(x, fillers=lx.FILLERS) -> Column:
    return F.regexp_replace(col(x), _words(fillers) + r"\s*", "")


def drop_modifiers(x, modifiers=lx.MODIFIERS) -> Column:
    return F.regexp_replace(col(x), _words(modifiers) + r"\s+", "")


def one_line(x) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+", " "))


def tidy_lines(x) -> Column:
    """At most one empty line, one blank, no blanks at line ends."""
    out = F.regexp_replace(col(x), r"\n\s*\n\s*\n+", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, " +", " "), r"(?m) +$", "")


def basic(x) -> Column:
    out = one_line(x)
    for pattern, short in ((r"\.{2,}", "..."), ("!{2,}", "!"), (r"\?{2,}", "?")):
        out = F.regexp_replace(out, pattern, short)
    return out


def plain_quotes(x) -> Column:
    return F.translate(col(x), "“”‘’", "\"\"''")


def clean(x) -> Column:
    return plain_quotes(basic(x))


def abbreviate(x, words=lx.ABBREVIATIONS, symbols=lx.SYMBOLS) -> Column:
    return _fold(_fold(x, words), symbols)


def abbreviations_applied(x, words=lx.ABBREVIATIONS, symbols=lx.SYMBOLS) -> Column:
    """Which of the words a first-level fallback would replace."""
    c = col(x)
    return F.array_compact(F.array(*[F.when(c.rlike(f"(?iu){LEFT}{quoted(w)}{RIGHT}"), F.lit(w)) for w, _ in [*words, *symbols]]))


def domain_literals(x, domain: str | None, literals=lx.DOMAIN_LITERALS) -> Column:
    out = col(x)
    for original, short in literals.get(domain or "", []):
        out = F.replace(out, F.lit(original), F.lit(short))
    return out


def normalise_punctuation(x) -> Column:
    out = plain_quotes(F.regexp_replace(col(x), r"[ \t]+", " "))
    for pattern, short in ((r"\s+([,.;:!?])", "$1"), (r"([,;:])\1+", "$1"), (r"\.{4,}", "..."), (r"([!?])\1+", "$1")):
        out = F.regexp_replace(out, pattern, short)
    return out


def normalise_whitespace(x) -> Column:
    out = F.regexp_replace(F.regexp_replace(col(x), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"(?m)^ +| +$", ""), r"^\s+|\s+$", "")


def normalise_text(x) -> Column:
    """CRLF to LF, tab to two blanks, no-break space to blank, trimmed."""
    out = F.replace(F.replace(F.replace(col(x), F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit("  ")), F.lit(" "), F.lit(" "))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def structural(x, phrases=lx.VARIANT_PHRASES, openers=lx.OPENERS) -> Column:
    """Articles out, phrases short, and sentence openers with a comma replaced."""
    out = _fold(F.regexp_replace(col(x), f"(?iu){LEFT}(?:the|a|an){RIGHT}\\s+", ""), phrases)
    for opener, short in openers:
        out = F.regexp_replace(out, f"(?iu){LEFT}{quoted(opener)},\\s*", replacement(short))
    return out


def variant_words(x, words=lx.VARIANT_WORDS) -> Column:
    return _fold(x, words)


def symbols(x, rules=lx.VARIANT_SYMBOLS) -> Column:
    return _fold(x, rules)


def tight_punctuation(x) -> Column:
    out = F.regexp_replace(col(x), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*([.!?])\s*", "$1 "), r"\s*,\s*", ","))


def selective(x, level: Column | str) -> Column:
    """A few abbreviations and phrases and one line, on the two stronger levels."""
    lvl = F.lit(level) if isinstance(level, str) else level
    return F.when(lvl.isin("balanced", "aggressive"), one_line(_fold(_fold(x, lx.SELECTIVE), lx.SELECTIVE_PHRASES))).otherwise(col(x))


def expand(x, rules: list[tuple[str, str]]) -> Column:
    """Reversible rules backwards, in order; later ones see what earlier ones made."""
    out = col(x)
    for original, short in rules:
        out = F.replace(out, F.lit(short), F.lit(original))
    return out


def replace_first(x: Column, a: Column, b: Column) -> Column:
    """The first occurrence of a replaced by b."""
    at = F.instr(x, a)
    return F.when((a == "") | (at == 0), x).otherwise(F.concat(x.substr(F.lit(1), at - 1), b, x.substr(at + F.length(a), F.length(x))))


def context(x: Column, position: Column, size: Column, radius: int = 20) -> Column:
    """The text around a 0-based position."""
    begin = F.greatest(F.lit(0), position - radius)
    return x.substr(begin + 1, position + size + radius - begin)


def quality_rating(score: Column) -> Column:
    out = F.lit("poor")
    for least, label in ((5, "acceptable"), (6, "fair"), (7, "good"), (8, "very good"), (9, "excellent")):
        out = F.when(score >= least, label).otherwise(out)
    return out
