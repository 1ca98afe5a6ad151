"""Quality: supervised subword embeddings.

Words, unordered pairs of neighbouring words (hashed by the exclusive or of the
two, so every pair of equal words is one bucket) and character n-grams are hashed
into buckets, each with a learnt vector; a text is the average of its features'
vectors, and a softmax over a linear map of it gives the two classes. All is trained by stochastic gradient descent in numpy on at
most ``LEARN`` labelled texts of each class; a step weighs as its class does in
all labels.

The softmax over two classes needs only the difference of the two rows of the
linear map, so scoring projects every bucket's vector once and averages scalars.
Every text is scored whole; null is empty, an empty text has the bias alone.
Without labels of both classes the score is their share. The added column gets
a name that no column of the table has.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import charvec, labelled
from .exact_dedup import fresh
from .textvec import U

SIZES = range(2, 5)
BITS = 18
DIMENSIONS = 12
LEARN = {1: 2000, 0: 2000}
#: steps of one text each: every text comes at least LEAST_EPOCHS times, a small sample as often as fills STEPS
STEPS, LEAST_EPOCHS, RATE, DECAY = 24_000, 6, 4.0, 1e-5
SEED = 7


def features(chars: charvec.Chars) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each feature, each text's first, each text's end) for words, word pairs and each n-gram size."""
    _, value, at = chars.words()
    bucket = lambda h: (h >> U(64 - BITS)).astype(np.int64)
    out = [(bucket(value), at[:-1], at[1:])]
    # the pair at k is of words k and k + 1; a text's last word has none of its own
    pair_end = np.maximum(at[1:] - 1, at[:-1])
    out.append((bucket(charvec.pairs(value)), at[:-1], pair_end))
    grams = chars.ngrams(SIZES, BITS)
    begin = chars.start - 1
    for n in SIZES:
        size = np.maximum(chars.end - chars.start + 2 - n + 1, 0)
        out.append((grams[n], begin, begin + np.where(chars.end > chars.start, size, 0)))
    return out


def counted(texts: list) -> list[labelled.Features]:
    """Each text's buckets and how often it has them."""
    out = []
    for _, chars in charvec.batches(texts):
        found = features(chars)
        for i in range(len(chars.start)):
            out.append(np.unique(np.concatenate([g[b[i] : e[i]] for g, b, e in found]), return_counts=True))
    return out


def train(rows: Iterable[tuple[labelled.Features, int]], counts: dict[int, int]) -> tuple[np.ndarray, float]:
    """The projected vector (logit for class 1 over class 0) of every bucket, and the bias."""
    docs = [(ids, (times / max(times.sum(), 1)).astype(np.float32), y) for (ids, times), y in rows]
    labels = [y for _, _, y in docs]
    learnt = {k: labels.count(k) for k in (0, 1)}
    if not all(learnt.values()):
        share = min(max(counts.get(1, 0) / max(sum(counts.values()), 1), 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    of_class = {k: counts[k] / sum(counts.values()) * len(labels) / learnt[k] for k in (0, 1)}
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (1 << BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out_w, out_b = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2)
    epochs = max(LEAST_EPOCHS, -(-STEPS // len(docs)))
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share, y = docs[k]
            rate = RATE * (1 - step / steps) * of_class[y]
            step += 1
            mean = share @ vectors[ids]
            z = out_w @ mean + out_b
            p = np.exp(z - z.max())
            gap = p / p.sum()
            gap[y] -= 1
            back = gap.astype(np.float32) @ out_w
            out_w -= rate * 0.1 * (np.outer(gap, mean) + DECAY * out_w)
            out_b -= rate * 0.1 * gap
            vectors[ids] -= (rate * share)[:, None] * back
    side = out_w[1] - out_w[0]
    return vectors @ side, float(out_b[1] - out_b[0])


def scores(texts: list, logit: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for _, chars in charvec.batches(texts):
        total, count = np.zeros(len(chars.start)), np.zeros(len(chars.start))
        for ids, begin, end in features(chars):
            total += charvec.sums(logit[ids], begin, end)
            count += end - begin
        out.append(total / np.maximum(count, 1))
    z = (np.concatenate(out) if out else np.zeros(0)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    return labelled.learn(docs, labels, "quality", LEARN, counted, train)


def add_score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], name: str, text_col: str = "text") -> DataFrame:
    """docs with the score column; the model is 1 MiB."""
    shared = spark.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)
    name = fresh(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        logit, bias = shared.value
        for b in batches:
            s = scores(b.column(where).to_pylist(), logit, bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
