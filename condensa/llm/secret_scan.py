"""Secret scan with a recursive decoding worklist.

Three kinds of secrets are found in every whole text: assignments, access keys
and long hex strings. Each text is then a layer of a worklist: regions that are
percent-encoded, written with Unicode escapes or character references, base64
or compressed inside base64 are decoded to new layers, which are scanned and
unwrapped in turn until no new layer appears. A layer seen before in the same
place (a cycle) is not opened again. Percent codes and escapes are decoded in
place, so a layer of theirs is the whole text and key, separator and value are
scanned together; the part between blanks around codes is scanned alone as well,
as a short match before it may take its key. Every layer keeps a map from its
characters to the spans of the text they come from, so findings in it are
reported as spans of the text: exact for escapes, of the groups of four
characters for base64, of the whole region for compressed data.

Positions are code points, ends are exclusive. A null text is empty; an empty
text has no spans. Base64 may touch other characters of its alphabet and be
wrapped into lines: a run is decoded from each of its first four characters on.
Decoded bytes that are no UTF-8 text are kept beside the rest, and compressed
data (gzip, zlib or bzip2 streams, of any number of members) may begin at any of
them; data that expand over ``MAX_LAYER_BYTES`` are scanned in overlapping
pieces. A code that is written by a code of its own kind more than eight times
over (``%25`` ten times, then ``41``) is peeled in one step, so deep nesting costs
no layer for each depth. Added columns get names that no column of the table has.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exact_dedup import fresh

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: one code, or one under more than eight codes of its kind
CODE = r"%(?:(?:25){9,}[0-9A-Fa-f]{2}|[0-9A-Fa-f]{2})"
PERCENT, CODES, NESTED = re.compile(f"(?:{CODE})+"), re.compile(CODE), "%25" + "25" * 8
ESCAPE = re.compile(
    r"\\(?:(?:u005[cC]){9,})?u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\(?:(?:x5[cC]){9,})?x([0-9A-Fa-f]{2})"
    r"|&(?:(?:#38;){9,})?#([0-9]{1,7});|&(?:(?:#[xX]26;){9,})?#[xX]([0-9A-Fa-f]{1,6});"
)
#: marks a run of characters that are not decoded
LITERAL = -1
#: an encoded region reaches to the next blank or control character on both sides
BORDER = re.compile(r"[\x00-\x20\x7f]")
#: the shortest secret has 16 characters, so its base64 form has at least 22
LEAST_SECRET, LEAST_BASE64 = 16, 22
#: a run of base64 characters on one line, or on lines that follow each other
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{22,}+|[A-Za-z0-9+/_-]++(?=[ \t]*\r?\n))(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)*+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
STANDARD = str.maketrans("-_", "+/")
#: how a gzip, zlib or bzip2 stream begins, in bytes as _text gives them
MAGIC = re.compile("\x1f\udc8b\x08|x[\x01^\udc9c\udcda]|BZh[1-9]1AY&SY")
READ_CHARS, PIECE_BYTES = 1 << 12, 1 << 20
#: more inflated data than this is scanned in pieces of this size, which overlap
MAX_LAYER_BYTES, OVERLAP_BYTES = 32 << 20, 1 << 20


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Layer:
    """A decoded text in runs of characters: run k starts at at[k] and comes from begin[k] to end[k] of its parent,
    all its characters from all of that, or, where end[k] is LITERAL, each from its own.
    """

    def __init__(self, text: str, parent, at: list[int], begin: list[int], end: list[int]):
        self.text, self.parent, self.at, self.begin, self.end = text, parent, at, begin, end
        # the span of all of it, without a walk through all layers where it is all of its parent
        a, b = self.up(0, len(text)) if text else (0, 0)
        self.whole = parent.whole if (a, b) == (0, len(parent.text)) else parent.span(a, b)
        if type(self) is type(parent) is Layer:
            self._lift()

    def up(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.begin[i] + (start - self.at[i] if self.end[i] == LITERAL else 0)
        return first, self.begin[j] + end - self.at[j] if self.end[j] == LITERAL else self.end[j]

    def _lift(self) -> None:
        """Maps its characters to its parent's parent, so that a span is not looked up layer by layer."""
        p, at, begin, stop = self.parent, [], [], []
        for k, (a, b, e) in enumerate(zip(self.at, self.begin, self.end)):
            if e != LITERAL:
                b, e = p.up(b, e)
                at.append(a)
                begin.append(b)
                stop.append(e)
                continue
            last = b + (self.at[k + 1] if k + 1 < len(self.at) else len(self.text)) - a
            i = bisect_right(p.at, b) - 1
            while i < len(p.at) and p.at[i] < last:
                skip = max(b - p.at[i], 0)
                at.append(a + max(p.at[i] - b, 0))
                begin.append(p.begin[i] + (skip if p.end[i] == LITERAL else 0))
                stop.append(p.end[i])
                i += 1
        self.parent, self.at, self.begin, self.end = p.parent, at, begin, stop

    def span(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer is not None:
            start, end = layer.up(start, end)
            layer = layer.parent
        return start, end


class Root:
    parent = None

    def __init__(self, text: str):
        self.text, self.whole = text, (0, len(text))

    def up(self, start: int, end: int) -> tuple[int, int]:
        return start, end

    span = up


class Bytes(Layer):
    """What the base64 characters of a text decode to: places has, for each piece of them, its offset among them and where it is."""

    def __init__(self, raw: bytes, parent, places: list[tuple[int, int]], first: int, size: int, padded: int):
        self.places, self.first, self.size, self.padded, self.bytes = places, first, size, padded, len(raw)
        super().__init__(_text(raw), parent, [0], [0], [0])

    def up(self, start: int, end: int) -> tuple[int, int]:
        a = start if self.text.isascii() else len(_raw(self.text[:start]))
        b = a + len(_raw(self.text[start:end]))
        return self._place(self.first + 4 * (a // 3)), self._place(min(self.first + 4 * ((b - 1) // 3) + 4, self.size) - 1) + 1

    def _place(self, k: int) -> int:
        at, where = self.places[bisect_right(self.places, k, key=lambda x: x[0]) - 1]
        return where + k - at


def _text(raw: bytes) -> str:
    """UTF-8 text in which each byte that is none stays as a lone surrogate."""
    return raw.decode("utf-8", "surrogateescape")


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _pieces(layer, codes: re.Pattern, decode) -> tuple[Layer | None, list[tuple[int, int]]]:
    """The whole text with each match of codes decoded in place, and where the regions of codes are in it."""
    text, out, at, begin, stop, size, done, regions = layer.text, [], [], [], [], 0, 0, []

    def literal(upto: int):
        nonlocal size, done
        if upto > done:
            out.append(text[done:upto])
            at.append(size)
            begin.append(done)
            stop.append(LITERAL)
            size += upto - done
            done = upto

    for a, b in _regions(text, codes):
        literal(a)
        start, changed = size, False
        for m in codes.finditer(text, a, b):
            made = decode(m)
            if made is None:
                continue
            literal(m.start())
            for s, first, last in made:
                out.append(s)
                at.append(size)
                begin.append(first)
                stop.append(last)
                size += len(s)
            done, changed = m.end(), True
        literal(b)
        if changed:
            regions.append((start, size))
    if not regions:
        return None, []
    literal(len(text))
    return Layer("".join(out), layer, at, begin, stop), regions


def _percent(m: re.Match):
    """Each character of a run of percent codes with its codes' positions."""
    if NESTED not in m[0]:
        ends = range(m.start(), m.end() + 1, 3)
        raw = bytes.fromhex(m[0].replace("%", ""))
    else:
        found = list(CODES.finditer(m.string, m.start(), m.end()))
        ends = [m.start(), *(c.end() for c in found)]
        raw = bytes(int(c[0][-2:], 16) for c in found)
    at, out = 0, []
    for c in _text(raw):
        end = at + len(_raw(c))
        out.append((c, ends[at], ends[end]))
        at = end
    return out


def _escape(m: re.Match):
    digits, base = next((g, 10 if i == 4 else 16) for i, g in enumerate(m.groups()) if g is not None)
    code = int(digits, base)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), m.start(), m.end())]


class _Bzip:
    """bz2's decompressor with the attributes of zlib's; what it holds back comes with the next call."""

    unconsumed_tail = b""

    def __init__(self):
        self.z = bz2.BZ2Decompressor()

    def decompress(self, data: bytes, most: int) -> bytes:
        return self.z.decompress(data, most)

    eof = property(lambda self: self.z.eof)
    unused_data = property(lambda self: self.z.unused_data)
    hungry = property(lambda self: self.z.needs_input)


def _decompressor(begin: bytes):
    return _Bzip() if begin == b"BZh" else zlib.decompressobj(47)


def _inflated(text: str, at: int):
    """What the compressed stream (or members of several) from at on inflates to, in pieces: (bytes, where reading is, whether the stream is whole)."""
    z, left = _decompressor(_raw(text[at : at + 3])[:3]), b""
    while True:
        if not left and not z.eof and getattr(z, "hungry", True):
            left = _raw(text[at : at + READ_CHARS])
            at = min(at + READ_CHARS, len(text))
            if not left:
                return
        try:
            out = z.decompress(left, PIECE_BYTES)
        except (zlib.error, OSError, EOFError):
            return
        left = z.unused_data if z.eof else z.unconsumed_tail
        yield out, at - len(_text(left)), z.eof
        if z.eof:
            if len(left) < 3:
                more = _raw(text[at : at + READ_CHARS])
                at, left = min(at + READ_CHARS, len(text)), left + more
            if left[:3] not in (b"\x1f\x8b\x08", b"BZh"):
                return
            z = _decompressor(left[:3])


def _opened(layer):
    """Layers of the compressed streams in a layer's bytes; a long one in pieces that overlap."""
    text, at = layer.text, 0
    while m := MAGIC.search(text, at):
        size, end, whole, held = 0, m.end(), False, bytearray()
        for out, end, whole in _inflated(text, m.start()):
            size += len(out)
            held = held + out if size <= MAX_LAYER_BYTES else bytearray()
        # a stream that isn't whole may be none: others may begin inside
        at = end if whole else m.start() + 1
        if size < LEAST_SECRET:
            continue
        parent, (a, b) = layer, (m.start(), end)
        if isinstance(layer, Bytes):
            parent, b64_end = layer.parent, layer.padded if end == len(text) else 0
            a, b = layer.up(a, b)
            b = max(b, b64_end)
        if held:
            yield Layer(_text(bytes(held)), parent, [0], [a], [b])
            continue
        for out, _, _ in _inflated(text, m.start()):
            held += out
            if len(held) >= MAX_LAYER_BYTES:
                yield Layer(_text(bytes(held)), parent, [0], [a], [b])
                del held[:-OVERLAP_BYTES]
        yield Layer(_text(bytes(held)), parent, [0], [a], [b])


def _base64(layer, m: re.Match):
    """Layers of a run of base64 characters: all of it, line ends left out, from each of the first four on, and each line by itself."""
    lines = [(x.start(), x[0]) for x in LINE.finditer(layer.text, m.start(), m.end())]
    for part in [lines] + ([[x] for x in lines] if len(lines) > 1 else []):
        body, places, size = "".join(x for _, x in part), [], 0
        for where, x in part:
            places.append((size, where))
            size += len(x)
        if size < LEAST_BASE64:
            continue
        body = body.translate(STANDARD)
        padded = m.end() if part[-1] is lines[-1] else part[-1][0] + len(part[-1][1])
        for first in range(4) if part is lines else (0,):
            last = size - 1 if (size - first) % 4 == 1 else size
            raw = base64.b64decode(body[first:last] + "=" * (-(last - first) % 4))
            yield Bytes(raw, layer, places, first, last, padded if last == size else 0)


def _regions(text: str, codes: re.Pattern):
    """The runs between borders that have a match of codes."""
    at = 0
    for m in codes.finditer(text):
        if m.start() >= at:
            start = m.start()
            while start > at and not BORDER.match(text, start - 1):
                start -= 1
            border = BORDER.search(text, m.end())
            at = border.start() if border else len(text)
            yield start, at


def layers(layer):
    """The layers that a layer's encoded regions decode to, each with the regions in it that are scanned alone as well."""
    text = layer.text
    if "%" in text:
        yield _pieces(layer, PERCENT, _percent)
    if "\\" in text or "&#" in text:
        yield _pieces(layer, ESCAPE, _escape)
    for m in BASE64.finditer(text):
        for made in _base64(layer, m):
            yield made, []
    if layer.parent is not None:
        for made in _opened(layer):
            yield made, []


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans and all spans of a text, each sorted by start, then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    text = text or ""
    base = sorted(base_spans(text), key=order)
    # layers are made as they are taken, so of a long stream one piece is held at a time
    found, work, seen = set(base), [layers(Root(text))], set()
    while work:
        if (made := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, regions = made
        if layer is None or not layer.text:
            continue
        place = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.whole)
        if place in seen:
            continue
        seen.add(place)
        for a, b in [(0, len(layer.text)), *regions]:
            found.update((kind, *layer.span(a + x, a + y)) for kind, x, y in base_spans(layer.text[a:b]))
        work.append(layers(layer))
    return base, sorted(found, key=order)


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FIELDS = T.StructType(
    [T.StructField(f"n_{k}", T.LongType(), False) for k in KINDS]
    + [T.StructField("base_spans", T.StringType(), False), T.StructField("spans", T.StringType(), False)]
)


def add_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns in keep) with n_assign, n_access, n_hex, base_spans and spans (under free names)."""
    carried = docs.columns if keep is None else keep
    src = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").alias(fresh(docs, "text")))
    names = [fresh(docs.select(*[F.col(f"`{c}`") for c in carried]), n) for n in FIELDS.names]
    schema = T.StructType([*[docs.schema[c] for c in carried], *(T.StructField(n, f.dataType, False) for n, f in zip(names, FIELDS.fields))])

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(b.num_columns - 1):
                base, spans = scan(text.as_py())
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), spell(base), spell(spans)))
            made = list(zip(*rows)) or [[]] * len(FIELDS)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(made, kinds))], names=[*b.schema.names[:-1], *names])

    return src.mapInArrow(run, schema)
