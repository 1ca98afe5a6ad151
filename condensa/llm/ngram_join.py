"""N-gram Jaccard join by vertical partitioning, and the near-duplicate groups it links.

A document is the set of its distinct word shingles. All n-grams get one global
order, rarest first: by the magnitude of their count in a sketch of the whole
corpus, then by hash (any fixed order gives exact results; this one keeps
frequent n-grams out of prefixes). The order is cut into fragments of about equal
mass, every set into segments, overlaps of a candidate pair are counted fragment
by fragment, and the partial counts are summed per pair.

Documents with equal sets form one node. Candidates share an n-gram in their
prefixes and pass the length and position bounds, so no link is lost. Groups of
near copies are not expanded into pairs: a round verifies every row of an
n-gram's bucket with the purest one, another neighbours by size that are still
apart, and what links is joined; then only rows of still separate groups are
candidates, of which the bucket's largest group is never paired with itself. A
candidate of any round must also pass a bound on its overlap: parity bitmaps of
both sets differ in no more bits than the sets do in elements. Only documents of
candidates that pass are cut into segments, round by round, as sets take several
times the space of their texts.

Buckets are balanced by their measured number of rows, not by the sketch, which
may be coarse where a corpus is much larger than it: what a bucket's rows need of
the bucket comes by broadcast for the largest buckets (at most MAX_HOT of them),
its neighbours are looked for in parts, and in the last round the rows of one side
are dealt into parts and those of the other side meet each part.

Nodes are 64-bit digests of sets and n-grams 58-bit hashes of their words.
Null and empty texts have no shingles and link with nothing; a text with fewer
words is one shingle; repeated rows link as copies do. Null ids are allowed.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exact_dedup, textvec
from .components import components
from .scratch import Scratch

WORDS, PERCENT = 5, 80
#: the sketch has 2 ** SKETCH_BITS counters, and as many for each MORE_BYTES that a corpus has more, up to 2 ** MAX_BITS
SKETCH_BITS, MAX_BITS, MORE_BYTES = 22, 24, 64 << 30
SKETCH_SEGMENT = 1 << 15
FRAGMENTS = 4
ROUNDS = 2
#: an n-gram is hot if the sketch has so many times the mean count, and at least HOT_LEAST
HOT_TIMES, HOT_LEAST = 16, 4096
#: a bucket of over so many rows is dealt into parts of so many; at most MAX_HOT buckets are (MAX_SUMMED where each brings
#: a summary of up to 6 KB), so the limit rises with the corpus
PART_ROWS, MAX_HOT, MAX_SUMMED = 512, 100_000, 10_000
#: pairs of one node that one task verifies for each fragment
PAIR_ROWS = 256
#: bits of a set's parity bitmap; a set of more elements has a wide one too, of a power of two with a bit for each element
SIGN_BITS = 512
HASH_BITS = 58
BATCH_CHARS = 500_000
RESULT_ROWS = 1 << 17
MAX_BROADCAST_PAIRS = 200_000


def _sets(batch: pa.RecordBatch, column: int = 1):
    """(row number, sorted set) of the batch's texts."""
    texts = batch.column(column)
    lengths = [n or 0 for n in pc.utf8_length(texts).to_pylist()]
    rows = list(range(len(texts)))
    for a, b in textvec.chunks(rows, lengths, BATCH_CHARS):
        for i, s in enumerate(textvec.shingle_sets(texts[a : b].to_pylist(), WORDS)):
            yield a + i, s


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch_bits(docs: DataFrame) -> int:
    """By the size that the planner expects of the input: it changes the order of n-grams, not the result."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 62:
        return SKETCH_BITS  # the planner doesn't know
    return SKETCH_BITS + min(MAX_BITS - SKETCH_BITS, max(0, size // MORE_BYTES).bit_length())


def first_pass(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of two kinds: a document's id, digest, set size, node and parity bitmaps; and a segment of the task's counts of n-grams."""

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        names = ["id", "digest", "n", "node", "sign", "wide", "segment", "counts"]
        kind = pa.int64()
        for b in batches:
            kind = b.schema.types[0]
            size, nodes, signs, wide = [0] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            held, total = [], 0
            for i, s in _sets(b):
                size[i] = len(s)
                if len(s):
                    nodes[i], signs[i] = _node(s), sign(s)
                    if len(s) > SIGN_BITS:
                        wide[i] = sign(s, 1 << (len(s) - 1).bit_length()).tobytes()
                    held.append(s >> np.uint64(64 - bits))
                    total += len(s)
                if total > 1 << 19:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                    held, total = [], 0
            if held:
                counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.array(wide, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        parts = [(k, counts[k * SKETCH_SEGMENT : (k + 1) * SKETCH_SEGMENT]) for k in range(len(counts) // SKETCH_SEGMENT)]
        parts = [(k, zlib.compress(x.tobytes(), 1)) for k, x in parts if x.any()]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary()), pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=names)

    return docs.select("id", "text", "digest").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, digest binary, n long, node long, sign array<long>, wide binary, segment int, counts binary")


def sketch(parts: DataFrame, bits: int) -> tuple[bytes, list[int], int]:
    """The magnitude of every counter (a byte each, 2 ** bits in all), the fragments' first keys, and the least hot magnitude."""

    def merge(key, pdf):
        import pandas as pd

        total = np.zeros(SKETCH_SEGMENT, np.uint64)
        for x in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        level = np.minimum(np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8), 31)
        mass = np.bincount(level, total.astype(float), 32)
        return pd.DataFrame({"segment": [key[0]], "level": [level.tobytes()], "mass": [mass.tolist()]})

    level, mass = np.zeros(1 << bits, np.uint8), np.zeros(32)
    for r in parts.select("segment", "counts").groupBy("segment").applyInPandas(merge, "segment int, level binary, mass array<double>").collect():
        level[r["segment"] * SKETCH_SEGMENT : (r["segment"] + 1) * SKETCH_SEGMENT] = np.frombuffer(r["level"], np.uint8)
        mass += np.array(r["mass"])
    pivots, upto = [0], np.concatenate([[0.0], np.cumsum(mass)])
    for k in range(1, FRAGMENTS):
        goal = upto[-1] * k / FRAGMENTS
        c = min(int(np.searchsorted(upto, goal, side="right")) - 1, 31)
        part = (goal - upto[c]) / mass[c] if mass[c] else 0.0
        pivots.append((c << HASH_BITS) + int(part * (1 << HASH_BITS)))
    hot = int(np.ceil(np.log2(max(HOT_LEAST, HOT_TIMES * upto[-1] / len(level)))))
    return level.tobytes(), pivots, hot


def ordered(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set as sorted positions in the global order."""
    at = (s >> np.uint64(65 - len(level).bit_length())).astype(np.int64)
    return np.sort(level[at].astype(np.uint64) << np.uint64(HASH_BITS) | s >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def index_rows(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(token, node, n, pos) of every document's prefix; shared has the magnitudes."""

    def run(batches):
        magnitude = np.frombuffer(shared.value, np.uint8)

        def out(rows):
            token = np.concatenate([t for t, _, _ in rows])
            sizes = [len(t) for t, _, _ in rows]
            cols = [token, np.repeat(np.array([x for _, x, _ in rows], np.int64), sizes), np.repeat(np.array([n for _, _, n in rows], np.int64), sizes), np.concatenate([np.arange(k) for k in sizes])]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["token", "node", "n", "pos"])

        for b in batches:
            rows, size = [], 0
            for _, s in _sets(b):
                if len(s):
                    rows.append((ordered(s, magnitude)[: prefix_size(len(s))], _node(s), len(s)))
                    size += len(rows[-1][0])
                if size >= RESULT_ROWS:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    packed = docs.select("id", "text").mapInArrow(run, "token long, node long, n long, pos long")
    return packed


def shared_tokens(index: DataFrame, hot: int) -> DataFrame:
    """Index rows of tokens that several nodes have, each once; of hot tokens, whose buckets are salted, all.

    Rows come by token and size, so a row whose neighbours in size are too far from it has no partner in its bucket.
    """
    names = ["token", "node", "n", "pos"]

    def run(batches):
        kept, before = None, False  # the last row, and whether it stays whatever comes next
        for b in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:4]])
            if kept is not None:
                rows = np.vstack([kept, rows])
            if not len(rows):
                continue
            rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
            same = (rows[1:, 0] == rows[:-1, 0]) & (rows[:-1, 2] * 100 >= rows[1:, 2] * PERCENT)
            keep = np.concatenate([[before], same]) | np.concatenate([same, [False]]) | (rows[:, 0] >> HASH_BITS >= hot)
            before, kept = bool(keep[-1]), rows[-1:]
            out = rows[:-1][keep[:-1]]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(4)], names=names)
        if kept is not None and before:
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, k]) for k in range(4)], names=names)

    magnitude = F.shiftright("token", HASH_BITS)
    parts = F.when(magnitude >= hot, F.pmod(F.xxhash64("node"), F.pow(F.lit(2.0), magnitude - hot + 4).cast("long"))).otherwise(0)
    dealt = index.withColumn("salt", parts).repartition("token", "salt").sortWithinPartitions("token", "n", "node")
    return dealt.mapInArrow(run, "token long, node long, n long, pos long")


def plausible(scratch: Scratch, index: DataFrame) -> DataFrame:
    """Index rows that may link with some other row of their token, by the sizes and positions in its bucket.

    Buckets are summed up by classes of sizes a factor of 1.25 wide; a partner is in
    the same class or next to it.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT))).cast("int")
    rows = index.withColumn("class", size_class)
    classes = rows.groupBy("token", "class").agg(F.max(F.col("n") - F.col("pos")).alias("room"), F.min("n").alias("least"), F.count("*").alias("rows"))
    # sizes up to 2 ** 63 make under 200 classes
    summed = classes.groupBy("token").agg(F.collect_list(F.struct("class", "room", "least", "rows")).alias("classes"))
    hot = hot_tokens(scratch, index.groupBy("token").agg(F.count("*").alias("rows")), "hot-shared", MAX_SUMMED)

    def ok(c: Column) -> Column:
        least = needed(F.col("n"), F.greatest(c["least"], F.ceil(F.col("n") * PERCENT / 100)))
        near = (F.abs(c["class"] - F.col("class")) <= 1) & ((c["class"] != F.col("class")) | (c["rows"] > 1))
        return near & (F.col("n") - F.col("pos") >= least) & (c["room"] >= least)

    return with_bucket(rows, summed, hot).where(F.exists("classes", ok)).select("token", "node", "n", "pos")


def hot_tokens(scratch: Scratch, sizes: DataFrame, name: str, buckets: int) -> DataFrame | None:
    """Of (token, rows) the buckets that are dealt into parts, with their number of parts; None if there are none."""
    total, largest = sizes.agg(F.sum("rows"), F.max("rows")).first()
    most = max(PART_ROWS, (total or 0) // buckets)  # no more than so many buckets have more rows
    if (largest or 0) <= most:
        return None
    return scratch.table(sizes.where(F.col("rows") > most).select("token", F.ceil(F.col("rows") / most).cast("int").alias("parts")), name)


def with_bucket(rows: DataFrame, per_token: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with what per_token has of their token (inner): for hot tokens by broadcast, for the others by a shuffle."""
    if hot is None:
        return rows.join(per_token, "token")
    listed = F.broadcast(hot.select("token"))
    big = per_token.join(listed, "token", "left_semi")
    small = rows.join(listed, "token", "left_anti").join(per_token.join(listed, "token", "left_anti"), "token")
    return rows.join(F.broadcast(big), "token").unionByName(small)


def segments(docs: DataFrame, shared: Broadcast, pivots: list[int], bits: int, wanted: Broadcast) -> DataFrame:
    """(id, node, fragment, tokens) of the documents whose id may be wanted."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        magnitude = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            b = b.filter(pa.array(exact_dedup.member(b.column(2).to_pylist(), bits, wanted.value)))
            ids, nodes, fragments, tokens, size = [], [], [], [], 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array(ids, b.schema.types[0]), pa.array(nodes, pa.int64()), pa.array(fragments, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["id", "node", "fragment", "tokens"])

            for i, s in _sets(b):
                if not len(s):
                    continue
                own = ordered(s, magnitude)
                cuts = np.searchsorted(own, pivots[1:])
                for k, x in enumerate(np.split(own, cuts)):
                    if len(x):
                        ids.append(b.column(0)[i].as_py())
                        nodes.append(_node(s))
                        fragments.append(k)
                        tokens.append(x)
                        size += len(x)
                if size >= RESULT_ROWS:
                    yield out()
                    ids, nodes, fragments, tokens, size = [], [], [], [], 0
            if ids:
                yield out()

    return docs.select("id", "text", _id_digest(F.col("id")).alias("digest")).mapInArrow(run, f"id {kind}, node long, fragment int, tokens array<long>")


def sign(s: np.ndarray, bits: int = SIGN_BITS) -> np.ndarray:
    """For each bit whether an odd number of elements fall on it: two sets' bits differ only where elements of one alone fall."""
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _id_digest(col: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(col.cast("string"), F.lit("")).cast("binary"), 256))


def needed(n1: Column, n2: Column) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil((n1 + n2) * PERCENT / (100 + PERCENT))


def may_link(a: str, b: str) -> Column:
    """Length bound, and the position bound at the first common n-gram."""
    na, nb, pa_, pb = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT) & (F.least(na - pa_, nb - pb) >= needed(na, nb))


def verified(pairs: DataFrame, parts: DataFrame, heads: DataFrame) -> DataFrame:
    """Of pairs (a, b, na, nb) those that link: overlaps counted per fragment, then summed per pair."""
    # b becomes the node with more pairs: a's segments move once per pair, b's once per node
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("pairs")).join(heads, "node")
    ends = [degree.select(F.col("node").alias(k), F.struct("pairs", F.col("node").alias("node"), "id").alias(f"end_{k}")) for k in ("a", "b")]
    turn = F.col("end_a.pairs") > F.col("end_b.pairs")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    known = pairs.join(ends[0], "a").join(ends[1], "b").select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb"), pick("end_a.id", "end_b.id").alias("id_a"), pick("end_b.id", "end_a.id").alias("id_b"), F.ceil(F.greatest("end_a.pairs", "end_b.pairs") / PAIR_ROWS).cast("int").alias("parts"))
    # pairs go to the segments while their list is small enough to broadcast, so that only segments that they name move
    near = F.broadcast if pairs.count() <= MAX_BROADCAST_PAIRS else lambda df: df
    left = parts.join(near(known), (F.col("node") == F.col("a")) & F.col("id").eqNullSafe(F.col("id_a"))).select("a", "b", "na", "nb", "fragment", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.col("tokens").alias("a_tokens"))
    # a node of many pairs meets them in parts, its segments copied to each
    right = parts.join(near(known.select("b", "id_b", "parts").distinct()), (F.col("node") == F.col("b")) & F.col("id").eqNullSafe(F.col("id_b")))
    right = right.select(F.col("node").alias("b"), "fragment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.col("tokens").alias("b_tokens"))
    both = left.join(right, ["b", "fragment", "part"])
    # a repeated row of a document brings its segments again, with the same count
    counted = both.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("common")).groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return summed.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * PERCENT)


def _chain(scratch: Scratch, index: DataFrame, labels: DataFrame, hot: DataFrame | None, signs: DataFrame) -> DataFrame:
    """Neighbours by size inside each part of a token's bucket that are in separate groups and may link."""
    w = Window.partitionBy("token", "part").orderBy("n", "node")
    here, last = F.struct("node", "n", "pos", "label"), "last"
    rows = _labelled(index, labels).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select(here.alias("x"), F.lag(here).over(w).alias(last))
    return _pairs(rows.where((F.col("x.label") != F.col("last.label")) & may_link("x", last)), "x", last)


def _star(scratch: Scratch, index: DataFrame, labels: DataFrame | None, hot: DataFrame | None, signs: DataFrame) -> DataFrame:
    """Each row of a token's bucket with the bucket's purest row, if that is in another group: the one with the most
    n-grams after the token, that is the fewest rare ones of its own. Near copies link with it if with any.
    """
    rows = _labelled(index, labels)
    pure = F.max_by(F.struct("node", "n", "pos", "label"), F.struct(F.col("n") - F.col("pos"), F.col("node"))).alias("center")
    met = with_bucket(rows, rows.groupBy("token").agg(pure), hot).select(F.struct("node", "n", "pos", "label").alias("x"), "center")
    return _pairs(met.where((F.col("x.label") != F.col("center.label")) & may_link("x", "center")), "x", "center")


def _labelled(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return index.withColumn("label", F.col("node"))
    return index.join(labels, "node", "left").select(*index.columns, F.coalesce("component", "node").alias("label"))


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    swap = F.col(f"{x}.node") > F.col(f"{y}.node")
    side = lambda c, flip: F.when(swap if flip else ~swap, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    return rows.select(side("node", False).alias("a"), side("node", True).alias("b"), side("n", False).alias("na"), side("n", True).alias("nb")).distinct()


def _rest(scratch: Scratch, index: DataFrame, labels: DataFrame, hot: DataFrame | None, signs: DataFrame) -> DataFrame:
    """Pairs of separate groups that share a token and may link, by sizes, positions and bitmaps.

    A bucket's rows outside of its largest group are dealt into the bucket's parts,
    all of its rows go to each part, and a pair is given out only if it may link.
    """
    rows = _labelled(index, labels)
    groups = rows.groupBy("token", "label").agg(F.count("*").alias("rows"))
    largest = groups.groupBy("token").agg(F.max_by("label", F.struct("rows", "label")).alias("largest"), F.count("*").alias("groups")).where("groups > 1").select("token", "largest")
    met = scratch.table(with_bucket(rows, largest, hot), "met")
    apart_rows = met.join(signs.select("node", "sign").join(met.select("node").distinct(), "node", "left_semi"), "node")
    small = apart_rows.where(F.col("label") != F.col("largest")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    every = apart_rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    x, y = small.alias("x"), every.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part"))
    apart = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("x.largest")) | (F.col("x.node") < F.col("y.node")))
    return _pairs(x.join(y, same & apart & may_link("x", "y") & signs_allow("x", "y")), "x", "y")


def signs_allow(a: str, b: str) -> Column:
    """Linked sets differ in at most na + nb - 2 * needed elements, so their bitmaps in no more bits."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.sign")[k].bitwiseXOR(F.col(f"{b}.sign")[k])) for k in range(1, SIGN_BITS // 64)), F.bit_count(F.col(f"{a}.sign")[0].bitwiseXOR(F.col(f"{b}.sign")[0])))
    return differ <= na + nb - 2 * needed(na, nb)


def differ(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ; a longer one is folded to the length of the other, which keeps its parities."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def bounded(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Of pairs (a, b, na, nb) those whose bitmaps allow a link; signs: (node, sign, wide)."""

    def run(batches):
        for b in batches:
            x, y, most = (b.column(k).to_pylist() for k in (4, 5, 6))
            keep = [u is None or v is None or differ(u, v) <= m for u, v, m in zip(x, y, most)]
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))

    for k in ("a", "b"):
        pairs = pairs.join(signs.select(F.col("node").alias(k), F.struct(F.col("sign"), F.col("wide")).alias(f"known_{k}")), k)
    ends = [F.struct(F.col(f"n{k}").alias("n"), F.col(f"known_{k}.sign").alias("sign")).alias(f"end_{k}") for k in ("a", "b")]
    near = pairs.select("a", "b", "na", "nb", "known_a.wide", F.col("known_b.wide").alias("wide_b"), *ends).where(signs_allow("end_a", "end_b"))
    near = near.select("a", "b", "na", "nb", "wide", "wide_b", (F.col("na") + F.col("nb") - 2 * needed(F.col("na"), F.col("nb"))).alias("most"))
    return near.mapInArrow(run, "a long, b long, na long, nb long")


def _ends(scratch: Scratch, slim: DataFrame, pairs: DataFrame, heads: DataFrame, shared: Broadcast, pivots: list[int], k: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of pairs with the one document (node, id) that stands for each, and these documents' segments."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.table(heads.join(nodes, "node", "left_semi").select("node", F.col("head").alias("id")), f"wanted-{k}")
    bits, table = exact_dedup.bloom_filter(wanted.select(_id_digest(F.col("id"))), wanted.count(), 1)
    given = slim.sparkSession.sparkContext.broadcast(table)
    parts = scratch.table(segments(slim, shared, pivots, bits, given), f"segments-{k}")
    given.destroy()
    if wanted.where("id is null").limit(1).count():
        # no id tells rows without one apart: of those of a node one stays
        one = parts.where("id is null").join(wanted.where("id is null").select("node"), "node", "left_semi").select("id", "node", "fragment", "tokens").dropDuplicates(["node", "fragment"])
        parts = parts.where("id is not null").unionByName(scratch.table(one, f"segments-null-{k}"))
    return wanted, parts


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _grouped(scratch: Scratch, slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of slim (id, text, digest): its rows (id, digest, n, node), and each node's label of its group and component_id."""
    spark = slim.sparkSession
    bits_ = sketch_bits(slim)
    first = scratch.table(first_pass(slim, bits_), "first")
    rows = first.where("segment is null")
    sized = scratch.table(rows.select("id", "digest", "n", "node"), "sized")
    # one document and its bitmaps stand for a node, as equal sets have equal bitmaps
    heads = scratch.table(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("head"), F.first("sign").alias("sign"), F.first("wide").alias("wide")), "heads")
    signs = heads.select("node", "sign", "wide")
    level, pivots, most = sketch(first.where("segment is not null"), bits_)
    scratch.drop("first")
    given = spark.sparkContext.broadcast(level)
    shared = scratch.table(shared_tokens(index_rows(slim, given), most), "shared")
    scratch.release()
    index = scratch.table(plausible(scratch, shared), "index")
    scratch.drop("shared")
    hot = hot_tokens(scratch, index.groupBy("token").agg(F.count("*").alias("rows")), "hot", MAX_HOT)
    scratch.release()
    index = index.withColumn("parts", F.lit(1)) if hot is None else index.join(F.broadcast(hot), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    labels = links = tried = None
    for k in range(ROUNDS + 1):
        pairs = (_star, _chain, _rest)[k](scratch, index, labels, hot, signs)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.table(bounded(pairs, signs), f"pairs-{k}")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        wanted, parts = _ends(scratch, slim, pairs, heads, given, pivots, k)
        found = scratch.table(verified(pairs, parts, wanted).select(F.col("a").alias("u"), F.col("b").alias("v")), f"links-{k}")
        for name in (f"wanted-{k}", f"segments-{k}", f"segments-null-{k}"):
            scratch.drop(name)
        scratch.release()
        links = found if links is None else links.unionByName(found)
        last = {} if k == ROUNDS else {"rounds": 3}
        labels = scratch.table(components(scratch, links, f"components-{k}", **last), f"labels-{k}")
    grouped = heads.join(labels, "node", "left").select("node", "head", F.coalesce("component", "node").alias("label"))
    least = grouped.groupBy("label").agg(F.min("head").alias("component_id"))
    named = scratch.table(grouped.join(least, "label").select("node", "label", "component_id"), "named")
    scratch.keep("sized", "named")
    return sized, named


def near_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_shingles and component_id (the smallest id reachable by links)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.lit(None).cast("binary").alias("digest"))
    sized, named = _grouped(Scratch(spark, "ngram-join"), slim)
    out = sized.where("node is not null").join(named, "node").select("id", "n", "component_id")
    alone = sized.where("node is null").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that with the smallest id (null last; of rows that repeat it, one). Rows without shingles stay.

    Rows are told apart by id and text digest, so null and repeated ids lose no row of another group.
    """
    group, name, digest = (exact_dedup.fresh(docs, x) for x in ("group", "name", "digest"))
    scratch = Scratch(spark, "near-copies")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), text_digest(F.col(f"`{text_col}`")).alias("digest"))
    sized, named = _grouped(scratch, slim)
    rows = sized.where("node is not null").join(named.select("node", "label"), "node")
    firsts = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("row")).select("row.id", "row.digest", "label")
    alone = sized.where("node is null").select("id", "digest", F.lit(None).cast("long").alias("label")).distinct()
    stays = scratch.table(firsts.unionByName(alone).select(F.col("id").alias(name), F.col("digest").alias(digest), F.col("label").alias(group)), "stays")
    d, s = docs.alias("d"), stays.alias("s")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col(f"s.{name}")) & text_digest(F.col(f"d.`{text_col}`")).eqNullSafe(F.col(f"s.{digest}"))
    kept = d.join(s, same)
    filled = kept.where(F.col(f"s.{group}").isNotNull()).dropDuplicates([group])
    return kept.where(F.col(f"s.{group}").isNull()).unionByName(filled).select(*[F.col(f"`{c}`") for c in docs.columns])
