"""Frequent words and phrases, and new rules learnt from a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.profile import seen_again
from ..functions.text import let, ltoks, ngram_hashes, ngrams


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(ltoks(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top_words(docs: DataFrame, k: int = 10) -> DataFrame:
    return word_counts(docs).orderBy(F.desc("n"), "word").limit(k)


def repeated(docs: DataFrame, n: int = 3) -> DataFrame:
    """Per document (of n words or more) the extra occurrences of its n-grams, and how many come again; nothing is shuffled."""
    grams = docs.select("doc_id", ngram_hashes(ltoks("text"), n).alias("g")).where(F.size("g") > 0)
    return grams.select("doc_id", (F.size("g") - F.size(F.array_distinct("g"))).cast("long").alias("repeats"), seen_again(F.col("g")).cast("long").alias("repeated_grams"))


def boilerplate(docs: DataFrame) -> DataFrame:
    """Per document the repeats of words of over three characters, from its own tokens."""
    long_words = F.filter(ltoks("text"), lambda w: F.length(w) > 3)
    return docs.select("doc_id", (F.size(long_words) - F.size(F.array_distinct(long_words))).cast("long").alias("repeats"))


def key_phrases(docs: DataFrame, k: int = 10, group: str = "lang") -> DataFrame:
    """Of each group the k most frequent long words and bigrams."""
    from pyspark.sql import Window

    terms = F.concat(F.filter(ltoks("text"), lambda w: (F.length(w) > 3) & ~w.isin(lx.STOP)), ngrams(ltoks("text"), 2))
    counted = docs.select(group, F.explode(terms).alias("term")).groupBy(group, "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def learn_rules(docs: DataFrame, least: int = 3, sizes=(2, 3)) -> DataFrame:
    """Phrases worth a rule: occurrences, documents, a short form of initials, and characters saved."""
    grams = F.sort_array(F.concat(*[ngrams(F.col("words"), n) for n in sizes]))
    # in sorted order a document's first occurrence of a phrase differs from the one before it: one grouping counts both
    marked = let(grams, lambda g: F.transform(g, lambda x, i: F.struct(x.alias("original"), ((i == 0) | (x != F.get(g, i - 1))).alias("first"))))
    rows = docs.select(ltoks("text").alias("words")).select(F.inline(marked))
    found = rows.groupBy("original").agg(F.count("*").alias("frequency"), F.count_if("first").alias("documents")).where(F.col("frequency") >= least)
    initials = F.array_join(F.transform(F.split("original", " "), lambda w: F.left(w, F.lit(1))), "")
    return found.withColumn("compressed", initials).withColumn("chars_saved", F.col("frequency") * (F.length("original") - F.length("compressed"))).where("chars_saved > 0")
