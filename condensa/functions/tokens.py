"""Token estimates, exact counts, costs and formatting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx
from .text import any_sub, col, ltoks, n_sub, rcount, share, toks, total, trimmed  # noqa: F401


def estimate(x, empty: int = 1) -> Column:
    """A quarter of the characters, at least 1 (``empty`` for an empty text)."""
    n = F.length(F.coalesce(col(x), F.lit("")))
    return F.when(n == 0, F.lit(empty)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def adjusted_estimate(x, tech=lx.TECH) -> Column:
    """A quarter of the characters, more for long words and technical texts, less for short words."""
    n, words = F.length(col(x)).cast("double"), F.size(toks(x))
    mean = F.try_divide(n, words.cast("double"))
    base = n / 4 * F.when(mean > 8, 1.2).when(mean < 4, 0.9).otherwise(1.0)
    return F.greatest(F.lit(1), F.floor(base * F.when(n_sub(x, tech) >= 2, 1.1).otherwise(1.0))).cast("long")


def word_estimate(x) -> Column:
    words = F.size(toks(x))
    return F.when(words == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(words * 1.3))).cast("long")


def pattern_estimate(x) -> Column:
    """The smaller of a character and a pattern-based estimate."""
    c = col(x)
    parts = F.size(toks(x)) * 1.3 + rcount(c, r"[.,!?;:]") * 0.5 + rcount(c, "[0-9]+") * 0.3 + rcount(c, "[a-z][A-Z]") * 0.2 + rcount(c, "[A-Z]{2,}") * 0.1
    return F.least(F.ceil(F.length(c) / 4), F.floor(parts + 0.5)).cast("long")


def model_estimate(x, per_char: float = 0.25) -> Column:
    return F.ceil(F.length(col(x)) * F.lit(per_char).cast("decimal(6,4)")).cast("long")


def compare_models(x) -> Column:
    return F.create_map(F.lit("chars"), estimate(x), F.lit("words"), word_estimate(x), F.lit("adjusted"), adjusted_estimate(x), F.lit("patterns"), pattern_estimate(x))


def efficiency(original, compressed) -> Column:
    """Savings in tokens and characters of a rewritten text."""
    o, c = word_estimate(original), word_estimate(compressed)
    lo, lc = F.length(col(original)), F.length(col(compressed))
    return F.struct(
        o.alias("original_tokens"),
        c.alias("compressed_tokens"),
        (o - c).alias("token_savings"),
        F.when(o == 0, 1.0).otherwise(share(c, o)).alias("compression_ratio"),
        F.when(o == 0, 0.0).otherwise((1 - share(c, o)) * 100).alias("savings_percentage"),
        share(lo - lc, lo).alias("character_ratio"),
        F.when((o > 0) & (lo > lc), share(o - c, lo - lc)).otherwise(0.0).alias("efficiency_ratio"),
    )


def pseudo_ids(x) -> Column:
    """Of each token the sum of its code points plus its index, modulo 50,000."""
    return F.transform(toks(x), lambda w, i: ((F.aggregate(F.split(w, ""), F.lit(0).cast("long"), lambda a, ch: a + F.ascii(ch)) + i) % 50_000).cast("int"))


def pseudo_decode(ids: Column, vocabulary: Column) -> Column:
    """Text of pseudo ids by a map from id to token; ids that it lacks are spelled as numbers."""
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(vocabulary, i), F.concat(F.lit("<"), i.cast("string"), F.lit(">")))), " ")


#: estimates that need no vocabulary, by name
ESTIMATORS = ("chars", "words", "adjusted", "patterns")


def supported_models(vocabularies: Column) -> Column:
    """The names of loaded vocabularies and of the estimators, sorted, each once."""
    return F.sort_array(F.array_union(vocabularies, F.array(*map(F.lit, ESTIMATORS))))


def model_savings(x, patterns=lx.VERBOSE, stop=lx.STOP) -> Column:
    """What share of tokens a rewrite may save: known phrases, verbose ones and stop words, 0.7 at most."""
    words = ltoks(x)
    hits = n_sub(x, patterns) * 3 + F.size(F.filter(words, lambda w: w.isin(stop))) * 0.5
    return F.least(F.lit(0.7), share(hits, F.size(words)))


def strategy(model: Column) -> Column:
    return F.when(model.contains("large"), "keep structure, shorten phrases").when(model.contains("small"), "abbreviate").otherwise("balanced")


def cost(tokens: Column, price_per_1k: float = 0.03) -> Column:
    return tokens / 1000 * price_per_1k


def costs(tokens: Column, prices=lx.PRICES) -> Column:
    return F.create_map(*[c for name, price in prices.items() for c in (F.lit(name), cost(tokens, price))])


def processing_ms(x) -> Column:
    return (100 + 50 * F.ceil(F.length(col(x)) / 1000)).cast("long")


def bytes_text(n: Column) -> Column:
    out = F.format_string("%.1f GB", n / 1024.0**3)
    for k, unit in ((3, "MB"), (2, "KB")):
        out = F.when(n < 1024.0**k, F.format_string(f"%.1f {unit}", n / 1024.0 ** (k - 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.format_string("%.1fm", ms / 60_000.0))


def percentage_text(part: Column) -> Column:
    return F.format_string("%.1f%%", part * 100.0)


def number_text(n: Column) -> Column:
    """With thousands as K, M and B."""
    out = F.format_string("%.1fB", n / 1e9)
    for most, scale, unit in ((1e9, 1e6, "M"), (1e6, 1e3, "K")):
        out = F.when(n < most, F.format_string(f"%.1f{unit}", n / scale)).otherwise(out)
    return F.when(n < 1000, F.format_string("%d", n.cast("long"))).otherwise(out)


def string_hash(x) -> Column:
    """h * 31 + code point over a text, in 32 bits with sign."""
    wrap = lambda v: F.when(v >= 2**31, v - 2**32).otherwise(v)
    return F.aggregate(F.filter(F.split(F.coalesce(col(x), F.lit("")), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: wrap(F.pmod(h * 31 + F.ascii(c), F.lit(2**32))))


def exact_count(vocabulary: str, kind: str = "tokenizers"):
    """A pandas function that counts tokens with a vocabulary file of one of the installed tokenizer libraries.

    The file is read here and its bytes go with the function, so executors need no
    file; a worker builds the tokenizer once for all its batches.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            for b in batches:
                yield pd.Series([len(ids) for ids in model.encode(b.fillna("").tolist(), num_threads=1)])
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(data.decode("utf-8"))
        model.encode_special_tokens = True
        for b in batches:
            yield pd.Series([len(e.ids) for e in model.encode_batch(b.fillna("").tolist(), add_special_tokens=False)])

    return count
