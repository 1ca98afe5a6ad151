"""Vectorised text features: whole batches of texts as one byte buffer in numpy.

Words are runs of bytes other than space and 0x09-0x0D. All hashes are 64-bit
and depend only on the bytes, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _table() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=U) + U(1)) * U(_ODD))


BYTE_HASH = _table()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Batch:
    """Texts joined with one blank before and after each."""

    def __init__(self, texts: list, lower: bool = False):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buf = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        #: first byte of each text, and the byte after it
        self.start = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(parts) else np.zeros(0, np.int64)
        self.end = self.start + lengths
        self.blank = IS_SPACE[self.buf]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every word, and for each text its first word's index (n + 1 values)."""
        edge = np.diff(self.blank.astype(np.int8))
        first, last = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        return first, last, np.concatenate([np.searchsorted(first, self.start), [len(first)]])

    def word_hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash for each word: a polynomial over mixed bytes, by length-sorted columns."""
        with np.errstate(over="ignore"):
            width = last - first
            out = width.astype(U) * U(_ODD)
            order = np.argsort(width, kind="stable")[::-1]
            begin, sizes = first[order], width[order]
            acc = out[order]
            longest, j = int(sizes[0]) if len(sizes) else 0, 0
            live = len(sizes)
            while j < longest and j < 64:
                live = int(np.searchsorted(-sizes[:live], -j, side="left"))
                acc[:live] = (acc[:live] ^ BYTE_HASH[self.buf[begin[:live] + j]]) * U(_ODD)
                acc[:live] ^= acc[:live] >> U(29)
                j += 1
            for k in range(int(np.searchsorted(-sizes, -64, side="left")) if longest > 64 else 0):
                acc[k] = _long_hash(self.buf[begin[k] : begin[k] + sizes[k]])
            out[order] = acc
            return mix(out)

    def ngram_hashes(self, n: int) -> np.ndarray:
        """The hash of the n bytes that begin at each position of the buffer."""
        with np.errstate(over="ignore"):
            b = BYTE_HASH[self.buf]
            size = len(b) - n + 1
            h = np.full(max(size, 0), U(n), U)
            for k in range(n):
                h = (h ^ b[k : k + max(size, 0)]) * U(_ODD)
                h ^= h >> U(29)
            return h


def _long_hash(data: np.ndarray) -> np.uint64:
    import hashlib

    return U(int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), "little"))


def shingle_sets(texts: list, n: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes; with fewer words, all as one; without, none."""
    batch = Batch(texts, lower)
    first, last, at = batch.words()
    w = batch.word_hashes(first, last)
    with np.errstate(over="ignore"):
        size = max(len(w) - n + 1, 0)
        h = np.zeros(size, U)
        for k in range(n):
            h = (h ^ w[k : k + size]) * U(_ODD)
            h ^= h >> U(31)
        h = mix(h)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= n:
                got = h[a : b - n + 1]
                got = np.sort(got)
                out.append(got[np.concatenate([[True], got[1:] != got[:-1]])])
            elif b > a:
                x = U(b - a)
                for v in w[a:b]:
                    x = (x ^ v) * U(_ODD)
                    x ^= x >> U(31)
                out.append(mix(np.array([x], U)))
            else:
                out.append(np.zeros(0, U))
    return out


def chunks(rows: list, weights: list[int], most: int):
    """Slices (from, to) of rows whose weights sum to at most ``most``, or one row."""
    begin = total = 0
    for i, w in enumerate(weights):
        if i > begin and total + w > most:
            yield begin, i
            begin, total = i, 0
        total += w
    if begin < len(rows):
        yield begin, len(rows)
