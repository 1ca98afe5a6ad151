"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled to machines over the tropical semiring:

* the normaliser: a transducer whose arcs are the model's character map (read
  from its double-array trie) and a meta blank for a blank; the longest arc that
  fits is taken. A second machine squeezes blanks and puts one before the text,
  as the model says;
* the pieces: a transducer from characters to piece ids, a trie whose closing
  arcs weigh minus the piece's score;
* byte fallback: from the trie's root an arc for any other character, which
  writes the byte pieces of its UTF-8 form (compiled from a table of 256 arcs)
  and weighs more than any path of pieces;
* for merge-trained (BPE) models, an acceptor over piece ids: its state is the
  last piece, and it has an arc for a next piece only where merging the two
  pieces' characters from scratch gives these two pieces again (weight 0; the
  weight of all other arcs is infinite). Its arcs are built when first met.

An input is composed with them place by place, as far as a path reaches, and
the shortest path gives its pieces. For unigram models the acceptor is trivial
and the path is the best segmentation. For merge-trained models the acceptor
leaves exactly one path of finite weight: a sequence whose neighbours are all
stable is the one that merging produces (a merge over a border would happen in
the two neighbours alone as well), so the ids equal those of the merge
procedure, and the search can stop at the first path that reaches the end.

Arcs never leave a stretch between two cut points (places that no piece spans,
found from the pieces), so stretches are composed one by one and their results
kept in a cache of bounded size.

Decoding joins pieces and bytes, writes blanks for meta blanks and drops the
one added first: exact for models without a character map, but that a meta
blank in a text comes back as a blank (as the format defines). Null and empty
texts have no pieces. Added columns get names that no column of the table has.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .exact_dedup import fresh

META = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: kinds of pieces in a model file
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: results kept by a worker, in each of two generations (longer stretches are composed anew each time), and arcs of its acceptor
CACHE_STRETCHES, CACHE_CHARS, CACHE_PAIRS = 250_000, 32, 500_000
BATCH_CHARS = 1_000_000


def _fields(data: bytes):
    """(number, value) of a serialised protocol buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        wire = tag & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, i = data[i : i + size], i + size
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, value


def read_model(data: bytes) -> dict:
    """Pieces (text, score, kind), model type and the normaliser's switches of a model file."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode("utf-8"), struct.unpack("<f", f.get(2, b"\0" * 4))[0], f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    return {"pieces": pieces, "type": trainer.get(3, UNIGRAM), "map": character_map(normaliser.get(2) or b""), "dummy_prefix": bool(normaliser.get(3, 1)), "squeeze": bool(normaliser.get(4, 1))}


def character_map(blob: bytes) -> dict[str, str]:
    """The rules (text, what it becomes) of a normaliser: a double-array trie of UTF-8 bytes, then the replacements, each ended by a byte 0."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, ends = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    out, work = {}, [(offset(units[0]), b"")]
    while work:
        at, prefix = work.pop()
        for label in range(1, 256):
            child = at ^ label
            if child < len(units) and units[child] & 0x800000FF == label:
                below = child ^ offset(units[child])
                if units[child] >> 8 & 1:
                    begin = units[below] & 0x7FFFFFFF
                    out[(prefix + bytes([label])).decode("utf-8", "surrogateescape")] = ends[begin : ends.index(b"\0", begin)].decode("utf-8")
                work.append((below, prefix + bytes([label])))
    return out


class Normaliser:
    """A one-state transducer: its arcs rewrite the longest text that a rule begins with; all other characters stay."""

    def __init__(self, rules: dict[str, str]):
        self.arcs = rules
        self.longest = max(map(len, rules), default=0)
        some = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]" if chars else "(?!)"
        more = [r for r in rules if len(r) > 1]
        #: where an arc may begin: at a character with a rule of its own, or at one that a longer rule begins with
        self.first = re.compile(some({r for r in rules if len(r) == 1}) + "|" + some({r[0] for r in more}) + f"(?={some({r[1] for r in more})})") if rules else None

    def run(self, text: str) -> str:
        if self.first is None:
            return text
        out, at, arcs = [], 0, self.arcs
        while m := self.first.search(text, at):
            begin = m.start()
            out.append(text[at:begin])
            for size in range(min(self.longest, len(text) - begin), 0, -1):
                made = arcs.get(text[begin : begin + size])
                if made is not None:
                    break
            else:
                made, size = text[begin], 1
            out.append(made)
            at = begin + size
        return "".join(out) + text[at:]


class Transducer:
    def __init__(self, model: dict):
        self.model = model
        self.texts = [p for p, _, _ in model["pieces"]]
        #: inside the machines a blank stands for the meta blank, so that most texts take a byte for a character
        self.keys = [p.replace(META, " ") for p in self.texts]
        self.merge_trained = model["type"] == BPE
        self.score = {p: s for p, (_, s, kind) in zip(self.keys, model["pieces"]) if kind in (NORMAL, USER)}
        self.id = {p: i for i, (p, (_, _, kind)) in enumerate(zip(self.keys, model["pieces"])) if kind in (NORMAL, USER)}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model["pieces"]) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(model["pieces"]) if kind == UNKNOWN), 0)
        self.longest = max(map(len, self.id), default=1)
        self.normaliser = Normaliser(model["map"])
        #: a path over a character that no piece has costs more than any other way
        self.fallback = 10.0 - min(self.score.values(), default=0.0)
        #: the arcs of byte fallback: the piece of each byte, or the unknown piece for the whole character
        self.bytes = [self.byte[b] for b in range(256)] if len(self.byte) == 256 else None
        self.cut = self._cut_points()
        #: arcs of the acceptor that were built: for each last piece (the end of the list: none) the next pieces
        self.stable: list[dict[int, bool]] = [{} for _ in range(len(self.texts) + 1)]
        self.built = 0
        #: results by stretch; when the younger cache is full it becomes the older one
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.trie = self._trie()
        self._out = self._decode_table()

    def _cut_points(self) -> re.Pattern | None:
        """A pattern whose matches split a normalised text where no piece spans the border."""
        if any(" " in p.lstrip(" ") for p in self.id):
            return None
        apart = set("\n\t.,;:!?\"'()[]{}|#$%&*+=-_/\\@~^<>0123456789")
        while True:
            odd = {c for p in self.id for x, y in zip(p, p[1:]) if (x in apart) != (y in apart) and " " not in (x, y) for c in (x, y) if c in apart}
            if not odd:
                break
            apart -= odd
        if not apart:
            return re.compile(" *[^ ]+| +")
        some = "".join(map(re.escape, sorted(apart)))
        return re.compile(f" *(?:[^ {some}]+|[{some}]+)| +")

    def _trie(self) -> tuple:
        """Nodes (children by character, id of the piece that ends here or -1, weight of its closing arc)."""
        root: list = [{}, -1, 0.0]
        for p, i in self.id.items():
            node = root
            for c in p:
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1], node[2] = i, -self.score[p]
        return root

    def normalise(self, text: str | None) -> str:
        return self._normal(text).replace(" ", META)

    def _normal(self, text: str | None) -> str:
        """The normalised text with blanks for meta blanks."""
        text = self.normaliser.run(text or "")
        if self.model["squeeze"]:
            text = re.sub(" +", " ", text).strip(" ")
        if META in text:
            text = text.replace(META, " ")
        return " " + text if text and self.model["dummy_prefix"] else text

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the pair with the best score first, the leftmost of equals."""
        parts, get, none = list(text), self.score.get, float("-inf")
        values = [get(x + y, none) for x, y in zip(parts, parts[1:])]
        while values and (best := max(values)) != none:
            k = values.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del values[k]
            if k:
                values[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(values):
                values[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def follows(self, last: int, piece: int) -> bool:
        """Builds the acceptor's arc: whether piece may come after last (-1: at the beginning)."""
        self.built += 1
        if self.built > CACHE_PAIRS:
            self.built = 1
            for row in self.stable:
                row.clear()
        b = self.keys[piece]
        known = self.stable[last][piece] = self.merged(b) == [b] if last < 0 else self.merged(self.keys[last] + b) == [self.keys[last], b]
        return known

    def fallback_arc(self, char: str) -> tuple[int, ...]:
        """What the root's arc for any other character writes."""
        return tuple(map(self.bytes.__getitem__, char.encode("utf-8", "surrogatepass"))) if self.bytes else (self.unknown,)

    def arcs(self, text: str, i: int) -> list[tuple[int, int, float]]:
        """The composition's arcs at a place of the text: (end, piece, weight), short ones first; a piece of -1 is the fallback arc."""
        node, out, j, n = self.trie, [], i, len(text)
        while j < n and (node := node[0].get(text[j])) is not None:
            j += 1
            if node[1] >= 0:
                out.append((j, node[1], node[2]))
        if not out or out[0][0] > i + 1:
            out.insert(0, (i + 1, -1, self.fallback))
        return out

    def shortest_path(self, text: str) -> list[int]:
        """Ids on the least-weight path of text composed with pieces, fallback and acceptor."""
        return self._only_path(text) if self.merge_trained else self._best_path(text)

    def _best_path(self, text: str) -> list[int]:
        n = len(text)
        weight, way = [0.0] + [float("inf")] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            here = weight[i]
            for j, piece, w in self.arcs(text, i):
                if here + w < weight[j]:
                    weight[j], way[j] = here + w, (i, piece)
        out, at = [], n
        while at:
            i, piece = way[at]
            out.append((piece,) if piece >= 0 else self.fallback_arc(text[i]))
            at = i
        return [x for some in reversed(out) for x in some]

    def _only_path(self, text: str) -> list[int]:
        """The one path of finite weight: longest arcs first, back where none goes on; a state that leads nowhere is left once."""
        n, stable, follows, root, fallback = len(text), self.stable, self.follows, self.trie, self.fallback_arc
        i, last, out, ways, dead = 0, -1, [], [], None
        choices = None
        while i < n:
            if choices is None:
                # the arcs at this place, as in arcs(), with nothing but ends and pieces
                node, choices, j = root, [], i
                while j < n and (node := node[0].get(text[j])) is not None:
                    j += 1
                    if node[1] >= 0:
                        choices.append((j, node[1]))
                if not choices or choices[0][0] > i + 1:
                    choices.insert(0, (i + 1, -1))
            while choices:
                j, piece = choices.pop()
                if piece < 0:
                    known = True
                else:
                    known = stable[last].get(piece)
                    if known is None:
                        known = follows(last, piece)
                if known and (dead is None or (j, piece) not in dead):
                    ways.append((i, last, choices))
                    out.append(piece)
                    i, last, choices = j, piece, None
                    break
            else:
                if not ways:
                    raise ValueError("no path reaches the end")
                dead = dead if dead is not None else set()
                dead.add((i, last))
                i, last, choices = ways.pop()
                out.pop()
        if -1 in out:
            places = [w[0] for w in ways]
            return [x for k, piece in enumerate(out) for x in ((piece,) if piece >= 0 else fallback(text[places[k]]))]
        return out

    def _stretch(self, text: str) -> bytes:
        """The ids of a stretch that the younger cache lacks."""
        out = self.old.get(text)
        if out is None:
            out = array("i", self.shortest_path(text)).tobytes()
        if len(text) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_STRETCHES:
                self.old, self.cache = self.cache, {}
            self.cache[text] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The text's piece ids."""
        normal = self._normal(text)
        if not normal:
            return np.zeros(0, "<i4")
        if self.cut is None:
            return np.array(self.shortest_path(normal), "<i4")
        get, new = self.cache.get, self._stretch
        return np.frombuffer(b"".join([get(s) or new(s) for s in self.cut.findall(normal)]), "<i4")

    def _decode_table(self) -> list[bytes]:
        out = []
        for p, _, kind in self.model["pieces"]:
            if kind == BYTE:
                out.append(bytes([int(p[3:5], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif kind == UNKNOWN:
                out.append(" ⁇ ".encode())
            else:
                out.append(p.replace(META, " ").encode("utf-8"))
        return out

    def decode(self, ids) -> str:
        """The text of piece ids; bytes that are no UTF-8 become U+FFFD."""
        table = self._out
        raw = b"".join([table[i] for i in ids])
        if self.model["dummy_prefix"] and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(data: bytes) -> Transducer:
    """One machine per worker and model, so that the caches last over tasks."""
    return Transducer(read_model(data))


def add_pieces(spark: SparkSession, docs: DataFrame, text_col: str = "text", ids: str = "piece_ids", decoded: str | None = None, model_file: str = MODEL_FILE) -> DataFrame:
    """docs with the array of piece ids, and on request the text decoded from them."""
    with open(model_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the model file, under 1 MB
    where = docs.columns.index(text_col)
    ids = fresh(docs, ids)
    decoded = decoded and fresh(docs, decoded)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches):
        machine = compiled(shared.value)
        for b in batches:
            texts = b.column(where)
            begin = 0
            while begin < b.num_rows:
                end, size, rows, back = begin, 0, [], []
                while end < b.num_rows and (end == begin or size < BATCH_CHARS):
                    text = texts[end].as_py()
                    rows.append(machine.encode(text))
                    if decoded:
                        back.append(machine.decode(rows[-1].tolist()))
                    size += len(text or "")
                    end += 1
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), pa.int32()))] + ([pa.array(back, pa.string())] if decoded else [])
                part = b.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(f.name for f in added)])
                begin = end

    return docs.mapInArrow(run, schema)
