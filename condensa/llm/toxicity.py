"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each lower-cased text is the set of its character n-grams (blanks included, so
word beginnings count), hashed into buckets. The ratio of a bucket is the log of
its smoothed share among toxic texts over that among the others; a logistic
regression is trained on the ratios of the buckets present, so a text's score
is a sum over its distinct n-grams. Every text is scored whole; null is empty,
and an empty text gets the score of the intercept. Equal texts score alike.

Learning takes at most ``LEARN`` labelled texts per class, of any length. Without
labels of both classes the score is their share (0 without any label). The added
column gets a name that no column of the table has.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import charvec, labelled
from .exact_dedup import fresh

SIZES = range(3, 6)
BITS = 20
LEARN = {1: 1500, 0: 2500}
SMOOTHING = 1.0
#: a bucket must be in so many learnt texts, and its log ratio so far from 0
LEAST_TEXTS, LEAST_RATIO = 4, 1.0
RIDGE, ROUNDS = 1e-3, 300


def buckets(chars: charvec.Chars) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each size the bucket at each position, and how many positions each text has."""
    grams = chars.ngrams(SIZES, BITS)
    # a text's n-grams begin at the blank before it and end with the blank after it
    return [grams[n] for n in SIZES], [np.maximum(chars.end - chars.start + 2 - n + 1, 0) for n in SIZES]


def presence(texts: list) -> list[labelled.Features]:
    """Each text's buckets, once each."""
    out = []
    for _, chars in charvec.batches(texts, lower=True):
        ids, sizes = buckets(chars)
        for i, begin in enumerate(chars.start - 1):
            found = np.unique(np.concatenate([g[begin : begin + s[i]] for g, s in zip(ids, sizes)]))
            out.append((found, np.ones(len(found), np.int32)))
    return out


def train(rows: Iterable[tuple[labelled.Features, int]], counts: dict[int, int]) -> tuple[np.ndarray, float]:
    """The weight of every bucket (ratio times coefficient), and the intercept. The rows are gone through twice."""
    weight, total = np.zeros(1 << BITS, np.float32), sum(counts.values())
    seen, labels = {k: np.zeros(1 << BITS, np.int32) for k in (0, 1)}, []
    for (ids, _), label in rows:
        seen[label][ids] += 1
        labels.append(label)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = min(max(counts.get(1, 0) / total if total else 0.0, 1e-6), 1 - 1e-6)
        return weight, float(np.log(share / (1 - share)))
    p, q = seen[1] + SMOOTHING, seen[0] + SMOOTHING
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    used = (seen[0] + seen[1] >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO)
    number = np.cumsum(used) - 1
    kept = [number[ids[used[ids]]].astype(np.int32) for (ids, _), _ in rows]
    row = np.repeat(np.arange(len(kept), dtype=np.int32), [len(k) for k in kept])
    col = np.concatenate(kept)
    r = ratio[used]
    scale = r[col]
    n, m = len(kept), len(r)
    # logistic regression by accelerated gradient steps; the rows of each class weigh as in the whole
    share = {k: counts[k] / total / max((y == k).sum(), 1) for k in (0, 1)}
    rows_weight = np.where(y == 1, share[1], share[0])
    w, b = np.zeros(m), float(np.log(counts[1] / counts[0]))
    norm = np.bincount(row, scale**2, n)
    step = 1.0 / (0.25 * np.quantile(norm, 0.9) * 0.5 + RIDGE + 1.0)
    look, look_b, old, old_b = w.copy(), b, w.copy(), b
    for k in range(ROUNDS):
        z = np.bincount(row, scale * look[col], n) + look_b
        gap = rows_weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(col, scale * gap[row], m) + RIDGE * look
        w, b = look - step * grad, look_b - step * gap.sum()
        move = k / (k + 3)
        look, look_b, old, old_b = w + move * (w - old), b + move * (b - old_b), w, b
    weight[used] = w * r
    return weight, b


def scores(texts: list, weight: np.ndarray, intercept: float) -> np.ndarray:
    out = np.full(len(texts), intercept)
    at = 0
    for _, chars in charvec.batches(texts, lower=True):
        ids, sizes = buckets(chars)
        hits = []
        for g, s in zip(ids, sizes):
            found = np.flatnonzero(weight[g])
            text = np.searchsorted(chars.start - 1, found, side="right") - 1
            inside = found < chars.start[text] - 1 + s[text]
            hits.append(np.column_stack([text[inside], g[found[inside]]]))
        each = np.concatenate(hits)
        key = np.unique(each[:, 0] << BITS | each[:, 1])
        out[at : at + len(chars.start)] += np.bincount(key >> BITS, weight[key & ((1 << BITS) - 1)].astype(float), len(chars.start))
        at += len(chars.start)
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    return labelled.learn(docs, labels, "toxic", LEARN, presence, train)


def add_score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], name: str, text_col: str = "text") -> DataFrame:
    """docs with the score column; the model is 4 MiB."""
    shared = spark.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)
    name = fresh(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        weight, intercept = shared.value
        for b in batches:
            s = scores(b.column(where).to_pylist(), weight, intercept)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)
