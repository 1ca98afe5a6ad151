"""Batches of texts as one buffer of code points, with rolling hashes over characters and words."""

from __future__ import annotations

import numpy as np

from .textvec import U, chunks, mix

_STEP = U(0xD1342543DE82EF95)
_BACK = U(pow(0xD1342543DE82EF95, -1, 1 << 64))
BLANK = 0x20
BATCH_CHARS = 400_000


class Chars:
    """Texts with one blank before and after each; the blanks 0x09-0x0D count as a blank."""

    def __init__(self, texts: list, lower: bool = False):
        texts = [t or "" for t in texts]
        joined = " " + " ".join(t.lower() for t in texts) + " " if lower else " " + " ".join(texts) + " "
        if lower:
            texts = [t.lower() for t in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        self.code[(self.code >= 0x09) & (self.code <= 0x0D)] = BLANK
        self.start = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        self.end = self.start + lengths
        with np.errstate(over="ignore"):
            self.char = mix(self.code.astype(U) * _STEP + U(1))

    def ngrams(self, sizes: range, bits: int) -> dict[int, np.ndarray]:
        """For each size, the bucket of the n-gram that begins at each position."""
        out, h = {}, self.char
        with np.errstate(over="ignore"):
            for n in range(2, max(sizes) + 1):
                h = self.char[: max(len(h) - 1, 0)] + _STEP * h[1:]
                if n in sizes:
                    out[n] = ((h ^ U(n)) * _STEP >> U(64 - bits)).astype(np.int64)
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character and hash of every word, and each text's first word's index (n + 1 values)."""
        edge = np.diff((self.code == BLANK).astype(np.int8))
        first, last = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(self.code), _STEP, U))
            upto = np.concatenate([np.zeros(1, U), np.cumsum(self.char * power)])
            back = np.cumprod(np.full(len(self.code), _BACK, U))
            value = mix((upto[last] - upto[first]) * back[first])
        return first, value, np.concatenate([np.searchsorted(first, self.start), [len(first)]])


def pairs(words: np.ndarray) -> np.ndarray:
    """A hash for each word with the one after it, whatever their order (the last stands with nothing)."""
    with np.errstate(over="ignore"):
        return mix((words ^ np.append(words[1:], U(0))) + _STEP)


def batches(texts: list, lower: bool = False):
    """(first text's index, Chars) for runs of texts of about BATCH_CHARS characters."""
    for a, b in chunks(texts, [len(t or "") + 1 for t in texts], BATCH_CHARS):
        yield a, Chars(texts[a:b], lower)


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values[begin:end] for each pair, in double precision; each sum depends on its own values only."""
    out = np.zeros(len(begin))
    full = np.flatnonzero(end > begin)
    if len(full):
        cuts = np.column_stack([begin[full], end[full]]).ravel()
        padded = np.append(values, 0).astype(np.float64)
        out[full] = np.add.reduceat(padded, cuts)[::2]
    return out
