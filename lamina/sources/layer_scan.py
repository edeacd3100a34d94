"""A data source for layers: one partition for each layer, one row for each tar record.

    spark.dataSource.register(LayerSource)
    spark.read.format("image_layers").option("layers", json.dumps(layer_rows(images))).load()

Each layer is read once, as a stream; bodies are hashed as they pass and are not kept.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamina.errors import MalformedInputError
from lamina.schema import ENTRIES
from lamina.sources.layouts import Image

SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRIES.fields) + ", body_offset long"

#: Type flags of tar records.
_KINDS = {b"0": "Regular", b"\0": "Regular", b"7": "Regular", b"1": "Hardlink", b"2": "Symlink", b"3": "CharDevice", b"4": "BlockDevice", b"5": "Directory", b"6": "Fifo"}
_PREFIXES = ("SCHILY.xattr.", "LIBARCHIVE.xattr.")
_CHUNK = 1 << 20


class _Range(io.RawIOBase):
    """A part of a file."""

    def __init__(self, file: str, offset: int, length: int):
        self._f = open(file, "rb")  # noqa: SIM115
        self._f.seek(offset)
        self._left = length

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self._f.read(min(len(b), self._left))
        b[: len(data)] = data
        self._left -= len(data)
        return len(data)

    def close(self) -> None:
        self._f.close()
        super().close()


def open_raw(layer: dict):
    return io.BufferedReader(_Range(layer["file"], layer["offset"], layer["length"]), _CHUNK)


def open_plain(layer: dict):
    """The uncompressed bytes of a layer."""
    raw = open_raw(layer)
    if layer["compression"] == "gzip":
        return gzip.GzipFile(fileobj=raw)
    if layer["compression"] == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return raw


def _bytes_as_text(value: str, from_record: bool) -> str:
    """Characters that stand for the bytes of a name."""
    return value.encode("utf-8", "surrogateescape").decode("latin-1") if from_record else value


def scan(layer: dict):
    """Rows of SCHEMA, in the order of the records."""
    stream = open_plain(layer)
    try:
        with tarfile.open(fileobj=stream, mode="r|", encoding="latin-1", errors="strict") as t:
            for k, m in enumerate(t):
                if m.issparse():
                    raise MalformedInputError(f"{m.name} is a sparse file, which is not handled")
                kind = _KINDS.get(m.type, "Meta")
                digest = None
                if kind == "Regular":
                    h, body = hashlib.sha256(), t.extractfile(m)
                    while chunk := body.read(_CHUNK):
                        h.update(chunk)
                    digest = h.hexdigest()
                xattrs = sorted((key[len(p) :].encode("utf-8", "surrogateescape"), v.encode("utf-8", "surrogateescape")) for key, v in m.pax_headers.items() for p in _PREFIXES if key.startswith(p))
                device = kind in ("CharDevice", "BlockDevice")
                link = _bytes_as_text(m.linkname, "linkpath" in m.pax_headers) if kind in ("Symlink", "Hardlink") else None
                yield (
                    layer["image_id"], layer["layer_idx"], k, _bytes_as_text(m.name, "path" in m.pax_headers), kind, m.mode & 0o7777, m.uid, m.gid, m.size, digest, link,
                    m.devmajor if device else None, m.devminor if device else None, [{"k": a, "v": b} for a, b in xattrs], m.offset_data if kind == "Regular" else None,
                )
    except (tarfile.TarError, EOFError, gzip.BadGzipFile) as e:
        raise MalformedInputError(f"layer {layer['layer_idx']} of image {layer['image_id']}: {e}") from e


class _LayerPartition(InputPartition):
    def __init__(self, layer: dict):
        super().__init__(None)
        self.layer = layer


class _Reader(DataSourceReader):
    def __init__(self, layers: list[dict]):
        self.layers = layers

    def partitions(self):
        return [_LayerPartition(x) for x in self.layers] or [_LayerPartition({})]

    def read(self, partition):
        from decimal import Decimal

        if partition.layer:
            for row in scan(partition.layer):
                yield (*row[:6], Decimal(row[6]), Decimal(row[7]), *row[8:])


class LayerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_layers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["layers"]))


def layer_rows(images: list[Image]) -> list[dict]:
    """Pointers to all layers."""
    return [
        {"image_id": i, "layer_idx": k, "file": x.blob.file, "offset": x.blob.offset, "length": x.blob.length, "compression": x.compression, "digest": x.digest, "diff_id": x.diff_id, "size": x.size}
        for i, image in enumerate(images)
        for k, x in enumerate(image.layers)
    ]


def read_layers(spark: SparkSession, layers: list[dict]) -> DataFrame:
    """The entries of all layers, with body_offset in the uncompressed layer."""
    spark.dataSource.register(LayerSource)
    return spark.read.format("image_layers").option("layers", json.dumps(layers)).load()


_POINTER = "image_id int, layer_idx int, file string, offset long, length long, compression string, digest string, diff_id string, size long"


def layer_table(spark: SparkSession, layers: list[dict]) -> DataFrame:
    """Pointers as a table, each in a partition of its own."""
    names = [c.split()[0] for c in _POINTER.split(", ")]
    return spark.createDataFrame([tuple(x[n] for n in names) for x in layers], _POINTER).repartition(max(1, len(layers)))


def observed_digests(spark: SparkSession, layers: list[dict]) -> DataFrame:
    """(image_id, layer_idx, digest, observed): SHA-256 of the layers as they are stored."""
    import pandas as pd

    for x in layers:
        if not x["digest"].startswith("sha256:"):
            raise MalformedInputError(f"digest {x['digest']} is not SHA-256")

    def run(parts):
        for part in parts:
            out = []
            for x in part.to_dict("records"):
                h, raw = hashlib.sha256(), open_raw(x)
                while chunk := raw.read(_CHUNK):
                    h.update(chunk)
                out.append("sha256:" + h.hexdigest())
            yield pd.DataFrame({"image_id": part["image_id"], "layer_idx": part["layer_idx"], "digest": part["digest"], "observed": out})

    return layer_table(spark, layers).mapInPandas(run, "image_id int, layer_idx int, digest string, observed string")
