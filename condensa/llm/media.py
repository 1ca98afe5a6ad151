"""Media columns: binary members in archive directories, read by a custom Spark data source.

``write_archives`` stores payloads as images in archives below a directory: an
archive is a run of members (magic, sizes, key, image) and ends with an index of
their offsets. The source ``media_archive`` plans partitions over byte ranges of
the archives (a member belongs to the range it begins in), streams members
through Arrow in batches of bounded size, and reads each member on its own by
its offset: a failing read is tried again on a newly opened file, and one that
keeps failing, or whose image is damaged, gives a row with an error instead of
failing the task; ``whole`` raises on such rows where none may be lost.

An image is an 8-bit greyscale PNG, 64 samples wide, unfiltered. Payloads are
padded with bytes 0 to a positive multiple of 64, so every payload is an image.
Null texts are empty, a null key is read back as an empty one. Equal payloads
give equal images. No rows give no archives, and these no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import filesystem, read_with_retries

WIDTH = 64
LEVEL = 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MAGIC = b"MEDIAMBR"
#: magic, length of the key, length of the image
MEMBER, MEMBER_BYTES = "<8sIQ", 20
#: number of members, magic
FOOTER, FOOTER_BYTES = "<Q8s", 16
ARCHIVE_BYTES = 64 << 20
#: a partition has at least so many bytes, and more where a source would have over MAX_RANGES of them
RANGE_BYTES, MAX_RANGES = 8 << 20, 100_000
BATCH_BYTES = 4 << 20


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (WIDTH if not raw else 0))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> np.ndarray:
    """The samples of a PNG made by to_image, its checksums verified."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head = 8, [], b""
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, *rest = struct.unpack(">IIBBBBB", head)
    if width != WIDTH or rest[:2] != [8, 0]:
        raise ValueError("not an 8-bit greyscale image of this width")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a bit for each of 64 columns whose mean exceeds the median column's."""
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    level = np.arange(256)
    mean = float(counts @ level / samples.size)
    deviation = float(np.sqrt(max(counts @ (level**2) / samples.size - mean**2, 0.0)))
    columns = samples.sum(axis=0, dtype=np.int64)
    bits = np.packbits(columns > np.median(columns)).tobytes().hex()
    return f"mean={mean:.4f};std={deviation:.4f};entropy={abs(float(share @ np.log2(share))):.4f};hash={bits}"


def write_archives(docs: DataFrame, key: str, text: str, uri: str) -> DataFrame:
    """Writes each row's text as a member (its key as decimal text); gives (archive, members, bytes) of finished archives.

    An archive is written under a name of its own and counts only if it is in the
    result, so attempts that were lost or repeated leave nothing but unused files.
    """

    def run(batches):
        handle, base = filesystem(uri)
        stream = offsets = name = None

        def close():
            for o in offsets:
                stream.write(struct.pack("<Q", o))
            stream.write(struct.pack(FOOTER, len(offsets), MAGIC))
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(offsets)], pa.int64()), pa.array([size], pa.int64())], names=["archive", "members", "bytes"])

        for b in batches:
            for k, value in zip(b.column(0), b.column(1)):
                if stream is None:
                    name = f"{uuid.uuid4().hex}.media"
                    stream, offsets = handle.open_output_stream(f"{base}/{name}"), []
                k = b"" if not k.is_valid else str(k.as_py()).encode()
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                image = to_image(padded(raw))
                offsets.append(stream.tell())
                stream.write(struct.pack(MEMBER, MAGIC, len(k), len(image)) + struct.pack("<Q", len(raw)) + k + image)
                if stream.tell() >= ARCHIVE_BYTES:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    return docs.select(key, text).mapInArrow(run, "archive string, members long, bytes long")


class Range(InputPartition):
    def __init__(self, archive: str, begin: int, end: int):
        self.archive, self.begin, self.end = archive, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, manifest: str | None, range_bytes: int, attempts: int):
        self.uri, self.manifest, self.range_bytes, self.attempts = uri, manifest, range_bytes, attempts

    def partitions(self):
        """Byte ranges of the archives that the manifest table names (their sizes are in it), or of those in the directory."""
        handle, base = filesystem(self.uri)
        if self.manifest:
            import pyarrow.dataset as ds

            mhandle, mbase = filesystem(self.manifest)
            rows = ds.dataset(mbase, filesystem=mhandle, format="parquet").to_table(columns=["archive", "bytes"])
            files = sorted((f"{base}/{name}", size) for name, size in zip(rows["archive"].to_pylist(), rows["bytes"].to_pylist()))
        else:
            from pyarrow import fs

            files = sorted((f.path, f.size) for f in handle.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".media"))
        step = max(self.range_bytes, -(-sum(size for _, size in files) // MAX_RANGES))
        return [Range(path, a, min(a + step, size)) for path, size in files for a in range(0, size, step)]

    @staticmethod
    def _member(f, offset: int):
        f.seek(offset)
        magic, klen, size = struct.unpack(MEMBER, f.read(MEMBER_BYTES))
        if magic != MAGIC:
            raise OSError(f"no member at {offset}")
        n_bytes = struct.unpack("<Q", f.read(8))[0]
        body = f.read(klen + size)
        if len(body) != klen + size:
            raise EOFError(f"member at {offset} is cut off")
        return body[:klen].decode(), n_bytes, body[klen:]

    @staticmethod
    def _index(f) -> np.ndarray:
        end = f.size() - FOOTER_BYTES
        f.seek(end)
        count, magic = struct.unpack(FOOTER, f.read(FOOTER_BYTES))
        if magic != MAGIC:
            raise OSError("an archive without its index")
        f.seek(end - 8 * count)
        return np.frombuffer(f.read(8 * count), "<u8").astype(np.int64)

    def read(self, partition: Range | None):
        if partition is None:
            return  # a source without ranges gets one partition all the same
        handle, _ = filesystem(self.uri)
        opened = None

        def on_file(action):
            """The action on the open archive; after a failure the next attempt opens it anew."""
            nonlocal opened
            try:
                if opened is None:
                    opened = handle.open_input_file(partition.archive)
                return action(opened)
            except (OSError, EOFError, struct.error):
                if opened is not None:
                    opened.close()
                opened = None
                raise

        rows, held, name = [], 0, partition.archive.rpartition("/")[2]
        offsets = read_with_retries(lambda: on_file(self._index), self.attempts)
        for offset in offsets[(offsets >= partition.begin) & (offsets < partition.end)].tolist():
            try:
                key, n_bytes, image = read_with_retries(lambda: on_file(lambda f: self._member(f, offset)), self.attempts)
                rows.append((name, offset, key, n_bytes, image, None))
                held += len(image)
            except (OSError, EOFError, struct.error, UnicodeDecodeError) as e:
                rows.append((name, offset, None, None, None, f"{name} at {offset}: {type(e).__name__}: {e}"))
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)
        if opened is not None:
            opened.close()

    @staticmethod
    def _batch(rows):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["archive", "offset", "key", "n_bytes", "image", "error"])


class MediaArchive(DataSource):
    """spark.read.format("media_archive").option("uri", ...): options manifest, range_bytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, key string, n_bytes long, image binary, error string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return ArchiveReader(o["uri"], o.get("manifest"), int(o.get("range_bytes", RANGE_BYTES)), int(o.get("attempts", 3)))


def read_archives(spark: SparkSession, uri: str, manifest: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    reader = spark.read.format("media_archive").option("uri", uri)
    for k, v in ({"manifest": manifest} if manifest else {}).items() | options.items():
        reader = reader.option(k, str(v))
    return reader.load()


FEATURES = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType())]
    + [T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())]
)


def features(members: DataFrame) -> DataFrame:
    """Sizes, digests and the feature of each member, computed from its stored bytes."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for key, n, image, error in zip(*(c.to_pylist() for c in b.columns)):
                if image is None:
                    rows.append((key, n, None, None, None, None, None, None, error))
                    continue
                try:
                    samples = from_image(image)
                except (ValueError, struct.error, zlib.error) as e:
                    rows.append((key, n, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                raw = samples.tobytes()
                rows.append((key, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples), None))
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=FEATURES.names)

    return members.select("key", "n_bytes", "image", "error").mapInArrow(run, FEATURES)


def whole(rows: DataFrame) -> DataFrame:
    """rows without their error column; a row with an error fails the query, so that no result lacks a member unseen."""
    failed = F.raise_error(F.concat(F.lit("a member can't be read: "), F.coalesce("error", F.lit("")))).cast("boolean")
    return rows.where(F.when(F.col("error").isNull(), True).otherwise(failed)).drop("error")
