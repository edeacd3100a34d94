"""Operator 4: media columns whose payloads lie in content-addressed tar shards.

Texts are stored losslessly as 8-bit grey PNG pictures of 64 samples a row (zero bytes fill the last
row; an empty text is one row of zeros). Each task appends to tar shards of its own; a payload is
named by its SHA-256 and written once a shard, and rows carry digest, shard, offset and length. The
rows are written as a table, so later reads name only shards of tasks that were committed; what a
lost task left behind is named by no row.

Metadata columns come from reads of the first 33 bytes of a payload; features from reads of the
whole. Both open shards through pyarrow's file systems, so any shared store will do. Within an Arrow
batch, reads go through the shards in the order of places, and rows of one payload share a read.

Null counts as empty; texts of any length are stored whole; equal texts give equal values; repeated rows
refer to one payload in a shard. An empty table gives empty tables. Other columns of any name don't
matter.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shared import new_path, ship, written

WIDTH = 64
#: A shard is closed beyond so many bytes; header bytes that a range read takes.
SHARD_BYTES, HEAD_BYTES = 256 << 20, 33
_PNG = b"\x89PNG\r\n\x1a\n"
_LEVEL = 6


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def encode_png(samples: bytes) -> bytes:
    """An 8-bit grey picture of WIDTH columns, rows unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    plain = np.zeros((len(rows), WIDTH + 1), np.uint8)
    plain[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(plain.tobytes(), _LEVEL)) + chunk(b"IEND", b"")


def read_head(head: bytes) -> dict:
    """Width, height, bit depth and colour type from the first bytes of a picture."""
    if head[:8] != _PNG or head[12:16] != b"IHDR":
        raise ValueError("not a picture")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def decode_png(data: bytes) -> bytes:
    """The samples of a picture that encode_png wrote, every checksum tested."""
    head, at, body = read_head(data), 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + content) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a part of the picture is damaged")
        body += [content] * (kind == b"IDAT")
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(head["height"], head["width"] + 1)[:, 1:].tobytes()


def _tar_head(name: str, size: int) -> bytes:
    """A POSIX ustar header."""
    field = lambda v, n: f"{v:0{n - 1}o}".encode() + b"\0"
    if size >= 8**11:
        raise ValueError("a payload is too large for a tar header")
    raw = bytearray(name.encode().ljust(100, b"\0") + field(0o644, 8) + field(0, 8) + field(0, 8) + field(size, 12) + field(0, 12) + b" " * 8 + b"0" + bytes(100) + b"ustar\x0000" + bytes(247))
    raw[148:156] = f"{sum(raw):06o}".encode() + b"\0 "
    return bytes(raw)


class _Shard:
    """A tar file that is being written."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/shard-{uuid.uuid4().hex}.tar"
        fs, path = FileSystem.from_uri(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.held = fs.open_output_stream(path), 0, {}

    def put(self, digest: str, data: bytes) -> int:
        """Where the payload lies."""
        if digest not in self.held:
            self.out.write(_tar_head(f"{digest}.png", len(data)) + data + bytes(-len(data) % 512))
            self.held[digest] = self.at + 512
            self.at += 512 + -(-len(data) // 512) * 512
        return self.held[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def _schema(docs: DataFrame, keep: list[str], more: str) -> str:
    return "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep) + more


def store(docs: DataFrame, keep: list[str], text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes payloads to shards, and a table of the columns `keep`, n_bytes, digest, shard,
    offset and length, which it returns. Runs at once."""
    spark = docs.sparkSession
    ship(spark)
    folder = new_path(spark, "media")

    def run(batches):
        shard, known = None, {}
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1):
                raw = (text.as_py() or "").encode()
                key = hashlib.sha256(raw).digest()
                if key not in known:
                    if shard is None or shard.at >= shard_bytes:
                        if shard:
                            shard.close()
                        shard, known = _Shard(folder), {}
                    data = encode_png(pad(raw))
                    digest = hashlib.sha256(data).hexdigest()
                    known[key] = (digest, shard.uri, shard.put(digest, data), len(data))
                rows.append((len(raw), *known[key]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns, kinds)], names=[*batch.schema.names[:-1], "n_bytes", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    source = docs.select(*keep, F.col(text_column).cast("string").alias("_text"))
    return written(source.mapInArrow(run, _schema(docs, keep, "n_bytes long, digest string, shard string, offset long, length long")), "media-rows")


class _Reader:
    """Ranges of shards; one open file at a time."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, size: int) -> bytes:
        if uri != self.uri:
            fs, path = FileSystem.from_uri(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        return self.file.read_at(size, offset)


def _over_ranges(rows: DataFrame, more: str, names: list[str], what) -> DataFrame:
    """Appends columns computed from each row's range; equal neighbours are read once."""

    def run(batches):
        reader = _Reader()
        for batch in batches:
            refs = list(zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "length")], strict=True))
            got = {}
            out = [None] * len(refs)
            for k in sorted(range(len(refs)), key=refs.__getitem__):
                if refs[k] not in got:
                    got = {refs[k]: what(reader, *refs[k])}
                out[k] = got[refs[k]]
            columns = [pa.array(x) for x in zip(*out, strict=True)] if out else [pa.array([])] * len(names)
            schema = pa.schema([*batch.schema, *[pa.field(n, pa.string() if n in _TEXT else pa.int64()) for n in names]])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[c.cast(schema.field(n).type) for c, n in zip(columns, names, strict=True)]], schema=schema)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + more)


_TEXT = {"payload_sha256", "media_sha256", "feature"}


def with_metadata(rows: DataFrame) -> DataFrame:
    """Adds width, height, bit_depth and colour_type, reading only the heads of payloads."""

    def what(reader, uri, offset, length):
        return tuple(read_head(reader.read(uri, offset, min(length, HEAD_BYTES))).values())

    return _over_ranges(rows, "width long, height long, bit_depth long, colour_type long", ["width", "height", "bit_depth", "colour_type"], what)


def feature_of(samples: bytes) -> str:
    """Shares of 8 equal ranges of sample values and the mean step between neighbours, in
    thousandths, as text."""
    x = np.frombuffer(samples, np.uint8)
    shares = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum()) * 1000 // max(1, len(x) - 1)
    return ",".join(map(str, [*shares.tolist(), step]))


def with_features(rows: DataFrame) -> DataFrame:
    """Adds what the stored payloads hold: payload_bytes, payload_sha256, tail_crc32 (of the last
    64 samples), media_bytes, media_sha256 and feature. A payload whose digest isn't its name is
    an error."""

    def what(reader, uri, offset, length):
        data = reader.read(uri, offset, length)
        samples = decode_png(data)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)

    more = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = _over_ranges(rows, more, ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], what)
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), "digest"))
    return out.withColumn("media_sha256", F.when(F.col("media_sha256") == F.col("digest"), F.col("media_sha256")).otherwise(damaged))
