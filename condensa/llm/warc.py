"""WARC archives from legacy ARC archives.

An ARC archive starts with a ``filedesc://`` record that tells its version. A
version 1 header line has URL, IP address, date, content type and length; a
version 2 line has result code, checksum, location, offset and file name before
the length. The converter reads header lines by version (URLs and types may have
blanks: the date and the numbers tell the fields apart) and contents by their
declared lengths, and synthesises what WARC asks for: a record id (a name-based
UUID), an ISO date (dates of 4 to 17 digits are filled up or cut to 14), payload
and block digests, and the type: of records with equal payloads (of at least
``least_bytes``) the one with the largest key is the response, the others are
revisits of it without payload; what is no HTTP response (``dns:`` and the like)
becomes a resource, which nothing revisits.

Archives are files below the shared folder, each record a gzip member, or not
compressed at all. Tasks hold one record at a time (and the roles of one
archive's records). Archives are written under new names and count only through
a manifest, so lost and repeated attempts leave nothing but unused files. A
record that can't be read gives a row with an error, and the rest is converted;
``round_trip`` fails if there is one, as every row is to come back.

A null payload is empty, a null URL becomes ``urn:unknown``; null keys are
smallest, and of rows that repeat the largest key one is the response. Keys are
of any type that a string can be cast back to. No pages give no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
import zlib
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, filesystem, read_with_retries

ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 18
DATE = "20200101000000"
KEY_HEADER = "X-Page-Id"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def gzip_member(raw: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + z.compress(raw) + z.flush() + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def members(stream, rest: bytes = b""):
    """(offset, content) of each gzip member of a file, one at a time; rest was read before."""
    offset = 0
    while rest or (rest := stream.read(READ_BYTES)):
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest and not (rest := stream.read(READ_BYTES)):
                raise EOFError(f"the member at {offset} is cut off")
            parts.append(z.decompress(rest))
            used += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield offset, b"".join(parts)
        offset += used


# --- ARC ---------------------------------------------------------------------


def arc_url(url: str | None) -> str:
    """A URL without blanks and control characters, which would end the header field."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:unknown"


def arc_version_record(name: str, version: int, date: str = DATE) -> bytes:
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 condensa\n{names[version]}\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, key: str | None, payload: bytes, name: str, offset: int, date: str = DATE) -> bytes:
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n" + (f"{KEY_HEADER}: {key}\r\n" if key is not None else "") + "\r\n"
    content = http.encode() + payload
    extra = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{arc_url(url)} 0.0.0.0 {date} text/html {extra}{len(content)}\n".encode() + content + b"\n"


HEADERS = {
    1: re.compile(r"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{4,17}) (?P<type>.*) (?P<length>\d+)"),
    2: re.compile(r"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{4,17}) (?P<type>.*) (?P<code>\S+) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\S+) (?P<filename>\S+) (?P<length>\d+)"),
}


def full_date(digits: str) -> str:
    """14 digits of a date; raises if there is no such time."""
    out = (digits + "00000101000000"[len(digits) :])[:14]
    datetime.strptime(out, "%Y%m%d%H%M%S")
    return out


def parse_arc(content: bytes, version: int | None) -> tuple[dict, bytes, int]:
    """Header fields by name, the content of declared length, and the archive's version."""
    line, _, rest = content.lstrip(b"\n").partition(b"\n")
    if version is None:
        if not line.startswith(b"filedesc://"):
            raise ValueError("an archive without its version record")
        version = int(rest.split(b" ", 1)[0])
        if version not in HEADERS:
            raise ValueError(f"an archive of version {version}")
    m = HEADERS[version].fullmatch(line.rstrip(b"\r").decode("utf-8", "surrogateescape"))
    if not m:
        raise ValueError(f"no header line of version {version}")
    header = m.groupdict()
    header["date"] = full_date(header["date"])
    length = int(header["length"])
    if len(rest) < length:
        raise EOFError("a record shorter than declared")
    return header, rest[:length], version


def plain_records(stream, held: bytes):
    """(offset, content) of each record of an archive that isn't compressed, by declared lengths; held was read before."""
    offset, ended = 0, False

    def fill(size: int):
        nonlocal held, ended
        while len(held) < size and not ended:
            more = stream.read(max(READ_BYTES, size - len(held)))
            held, ended = held + more, not more

    while True:
        fill(1)
        blank = len(held) - len(held.lstrip(b"\r\n"))
        held, offset = held[blank:], offset + blank
        if blank and not held:
            continue
        if not held:
            return
        while b"\n" not in held and not ended:
            fill(len(held) + READ_BYTES)
        line = held.partition(b"\n")[0]
        length = line.rstrip(b"\r").rpartition(b" ")[2]
        if not length.isdigit():
            raise ValueError(f"no length in the header line at {offset}")
        size = len(line) + 1 + int(length)
        fill(size)
        yield offset, held[:size]
        held, offset = held[size:], offset + size


def arc_records(stream):
    """(offset, header, HTTP header block, payload) of each record after the version record; where one can't be read, (offset, None, message, None)."""
    begin, version, at = stream.read(2), None, 0
    whole = members(stream, begin) if begin == b"\x1f\x8b" else plain_records(stream, begin)
    while True:
        try:
            at, content = next(whole)
        except StopIteration:
            return
        except (ValueError, EOFError, zlib.error) as e:
            # where the next record begins isn't known
            yield at, None, f"the records after {at} can't be read: {e}", None
            return
        try:
            header, body, now = parse_arc(content, version)
        except (ValueError, EOFError) as e:
            yield at, None, f"{type(e).__name__}: {e}", None
            if version is None:
                return
            continue
        if version is None:
            version = now
            continue
        head, blank, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
        yield at, header, head + blank, payload


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)".encode(), head)
    return m[1].decode() if m else None


def key_of(value: str | None) -> str | None:
    return None if value is None else urllib.parse.unquote(value)


def write_arcs(pages: DataFrame, uri: str) -> DataFrame:
    """pages (key, url, payload text) as ARC archives of both versions in turn: (archive, records, bytes)."""

    def run(batches):
        handle, base = filesystem(uri)
        stream = name = version = None
        done = records = 0

        def close():
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])

        for b in batches:
            for key, url, text in zip(*(b.column(k) for k in range(3))):
                if stream is None:
                    fresh = uuid.uuid4()
                    version = (fresh.int + done) % 2 + 1
                    name, records = f"{fresh.hex}.arc.gz", 0
                    stream = handle.open_output_stream(f"{base}/{name}", compression=None)
                    stream.write(gzip_member(arc_version_record(name, version)))
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                key = None if not key.is_valid else urllib.parse.quote(str(key.as_py()))
                stream.write(gzip_member(arc_record(version, url.as_py(), key, raw, name, stream.tell())))
                records += 1
                if stream.tell() >= ARCHIVE_BYTES:
                    yield close()
                    stream, done = None, done + 1
        if stream is not None:
            yield close()

    return pages.mapInArrow(run, "archive string, records long, bytes long")


def record_id(header: dict, digest: str, archive: str, offset: int) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "\n".join([printable(header["url"]), header["date"], digest, archive, str(offset)])))


def printable(url: str) -> str:
    """A header's URL with blanks, control characters and bytes that are no UTF-8 as percent codes."""
    return re.sub("[\x00-\x20\x7f\ud800-\udfff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogateescape")), url)


def _open(uri: str, name: str):
    handle, base = filesystem(uri)
    return read_with_retries(lambda: handle.open_input_stream(f"{base}/{name}", compression=None))


INDEX = "archive string, offset long, key string, bytes long, digest string, record string, error string"


def arc_index(archives: DataFrame, uri: str) -> DataFrame:
    """(archive, offset, key, bytes, digest, record, error) of every record of the archives in the manifest; bytes is null where nothing may revisit a record."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["archive", "offset", "key", "bytes", "digest", "record", "error"]
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows = []
                with _open(uri, archive) as stream:
                    for offset, header, head, payload in arc_records(stream):
                        if header is None:
                            rows.append((archive, offset, None, None, None, None, head))
                            continue
                        digest = base32_sha1(payload)
                        rows.append((archive, offset, key_of(http_field(head, KEY_HEADER)), len(payload) if head else None, digest, record_id(header, digest, archive, offset), None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return archives.select("archive").mapInArrow(run, INDEX)


def roles(scratch: Scratch, index: DataFrame, least_bytes: int) -> DataFrame:
    """(archive, offset, refers_key, refers_record, revisit): what each record of index (without errors) becomes."""
    place = F.struct("key", "archive", "offset", "record")
    last = index.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(place).alias("last"), F.count("*").alias("copies"))
    last = scratch.table(last.where("copies > 1").select("digest", "last"), "repeated")
    # both sides are read from tables: a digest that many records share is split by the adaptive join
    joined = index.join(last, "digest", "left")
    other = F.col("last").isNotNull() & (F.col("bytes") >= least_bytes) & ((F.col("last.archive") != F.col("archive")) | (F.col("last.offset") != F.col("offset")))
    return joined.select("archive", "offset", F.when(other, F.col("last.key")).alias("refers_key"), F.when(other, F.col("last.record")).alias("refers_record"), other.alias("revisit"))


# --- WARC --------------------------------------------------------------------


def warc_record(header: dict, head: bytes, payload: bytes, digest: str, record: str, revisit: bool, refers: str | None, refers_key: str | None) -> bytes:
    d = header["date"]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    block = head if revisit else head + payload
    kind = "revisit" if revisit else "response" if head else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record}>"), ("WARC-Date", date), ("WARC-Target-URI", printable(header["url"])), ("WARC-IP-Address", header["ip"])]
    fields += [("X-Payload-Length", str(len(payload))), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{refers}>")]
        fields += [("X-Refers-To-Page-Id", urllib.parse.quote(refers_key))] if refers_key is not None else []
    fields += [("Content-Type", "application/http;msgtype=response" if head else header["type"]), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_warc(content: bytes) -> tuple[dict, bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    if rest[length : length + 4] != b"\r\n\r\n":
        raise EOFError("a record shorter than declared")
    return fields, rest[:length]


def convert(role_rows: DataFrame, arc_uri: str, warc_uri: str, archives: int) -> DataFrame:
    """One WARC archive for each ARC archive, each a group's work, dealt over as many partitions: (archive, records, bytes)."""

    def one(table: pa.Table) -> pa.Table:
        archive = table["archive"][0].as_py()
        role = {o: (k, r, v) for o, k, r, v in zip(*(table[c].to_pylist() for c in ("offset", "refers_key", "refers_record", "revisit")))}
        handle, base = filesystem(warc_uri)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with _open(arc_uri, archive) as stream, handle.open_output_stream(f"{base}/{name}", compression=None) as out:
            info = b"software: condensa\r\nformat: WARC File Format 1.1\r\n"
            fields = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            out.write(gzip_member(fields.encode() + info + b"\r\n\r\n"))
            n = 0
            for offset, header, head, payload in arc_records(stream):
                if header is None:
                    continue
                digest = base32_sha1(payload)
                refers_key, refers, revisit = role[offset]
                out.write(gzip_member(warc_record(header, head, payload, digest, record_id(header, digest, archive, offset), revisit, refers, refers_key)))
                n += 1
            size = out.tell()
        return pa.table({"archive": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return role_rows.repartition(max(1, archives), "archive").groupBy("archive").applyInArrow(one, "archive string, records long, bytes long")


def read_warcs(archives: DataFrame, uri: str) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every response, revisit and resource in the archives of the manifest."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows = []
                with _open(uri, archive) as stream:
                    for _, content in members(stream):
                        fields, block = parse_warc(content)
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n") if kind != "resource" else (b"", b"", block)
                        key, refers = http_field(head, KEY_HEADER), fields.get("x-refers-to-page-id")
                        size = len(payload) if kind != "revisit" else int(fields["x-payload-length"])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind != "revisit" and base32_sha1(payload) != digest:
                            raise ValueError(f"{fields['warc-record-id']} is damaged")
                        rows.append((key_of(key), size, digest, kind, key_of(refers)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return archives.select("archive").mapInArrow(run, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def spread(archives: DataFrame) -> DataFrame:
    """A manifest, an archive to a partition: each is a task's work."""
    return archives.repartition(max(1, archives.count()), "archive")


def convert_archives(scratch: Scratch, legacy: DataFrame, arc_uri: str, warc_uri: str, key_type: str = "string", least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """ARC archives of a manifest as WARC archives: the manifest of these, and (archive, offset, error) of records that can't be read."""
    index = scratch.table(arc_index(spread(legacy), arc_uri), "index")
    good = index.where("error is null").drop("error").withColumn("key", F.col("key").cast(key_type))
    made = convert(roles(scratch, good, least_bytes).withColumn("refers_key", F.col("refers_key").cast("string")), arc_uri, warc_uri, legacy.count())
    return scratch.table(made, "warc-manifest"), index.where("error is not null").select("archive", "offset", "error")


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """pages to ARC archives, these to WARC archives, and what these hold."""
    scratch = Scratch(spark, "warc")
    arcs, warcs = scratch.folder("arc"), scratch.folder("warc")
    kind = pages.schema[key].dataType.simpleString()
    legacy = scratch.table(write_arcs(pages.select(*[F.col(f"`{c}`") for c in (key, url, payload)]), arcs), "arc-manifest")
    made, errors = convert_archives(scratch, legacy, arcs, warcs, kind, least_bytes)
    if bad := errors.limit(3).collect():
        raise ValueError(f"records that can't be read back: {bad}")
    return read_warcs(spread(made), warcs).withColumns({c: F.col(c).cast(kind) for c in ("key", "refers_to")})
