"""Writing layers: one archive for each image set, content-addressed, in a fixed order.

Rows are dealt to tasks by set and sorted: other entries by path, then hardlinks by path. A task
writes the archives of its sets one after another, as streams, and renames each to its digest when
it is whole; equal archives become one blob. Bodies never move between tasks: they are read from the
uncompressed input layers by place. A layer's archive is one stream, so it is written by one task.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.errors import ValidationError
from lamina.functions import paths
from lamina.sinks.tar_encode import TRAILER, entry_head, padding
from lamina.sources.layer_scan import layer_table, open_plain

_CHUNK = 1 << 20


class HashingFile:
    """A file that is hashed as it is written, and takes its digest as its name."""

    def __init__(self, folder: str):
        self.folder, self._temp = folder, os.path.join(folder, f".{uuid.uuid4().hex}.partial")
        os.makedirs(folder, exist_ok=True)
        self._f, self._h, self.size = open(self._temp, "wb"), hashlib.sha256(), 0  # noqa: SIM115

    def write(self, data: bytes) -> None:
        self._f.write(data)
        self._h.update(data)
        self.size += len(data)

    def publish(self) -> str:
        """The digest; the file is on disk before it has its name."""
        self._f.flush()
        os.fsync(self._f.fileno())
        self._f.close()
        digest = self._h.hexdigest()
        os.replace(self._temp, os.path.join(self.folder, digest))
        return digest


def write_blob(folder: str, data: bytes) -> str:
    f = HashingFile(folder)
    f.write(data)
    return f.publish()


def uncompressed(spark, layers: list[dict], scratch: str) -> list[dict]:
    """Pointers to uncompressed layers: those that are compressed are unpacked once each into
    `scratch`, which all executors must see."""
    import pandas as pd

    packed = [x for x in layers if x["compression"] != "none"]
    folder = os.path.join(scratch, "uncompressed")

    def run(parts):
        for part in parts:
            files, sizes = [], []
            for x in part.to_dict("records"):
                os.makedirs(folder, exist_ok=True)
                target = os.path.join(folder, x["digest"].partition(":")[2] + ".tar")
                if not os.path.exists(target):
                    temp = f"{target}.{uuid.uuid4().hex}"
                    with open(temp, "wb") as out, open_plain(x) as plain:
                        while chunk := plain.read(_CHUNK):
                            out.write(chunk)
                    os.replace(temp, target)
                files.append(target)
                sizes.append(os.path.getsize(target))
            yield pd.DataFrame({"image_id": part["image_id"], "layer_idx": part["layer_idx"], "file": files, "length": sizes})

    done = {}
    if packed:
        rows = layer_table(spark, packed).mapInPandas(run, "image_id int, layer_idx int, file string, length long").collect()  # a row for each layer
        done = {(r["image_id"], r["layer_idx"]): r for r in rows}
    out = []
    for x in layers:
        r = done.get((x["image_id"], x["layer_idx"]))
        out.append(x | {"file": r["file"], "offset": 0, "length": r["length"], "compression": "none"} if r else x)
    return out


def emit_layers(layers: DataFrame, bodies: DataFrame, sources: list[dict], blob_folder: str, t0: int) -> DataFrame:
    """(m, digest, size): layers are (m, path, entry); bodies (image_id, layer_idx, entry_idx,
    body_offset) say where in the uncompressed sources the bodies lie. Runs once it is read."""
    import pandas as pd

    place = {(x["image_id"], x["layer_idx"]): (x["file"], x["offset"]) for x in sources}
    placed = layers.join(bodies, ["image_id", "layer_idx", "entry_idx"], "left")
    columns = [c for c in placed.columns if c not in ("m", "path")]
    dealt = placed.select(F.array_join(F.col("m").cast("array<string>"), ",").alias("m"), "path", *columns)
    parts = dealt.repartition("m").sortWithinPartitions("m", F.col("kind") == "Hardlink", paths.components(F.col("path")))

    def run(batches):
        out, current, opened = None, None, {}
        raw = lambda text: None if text is None else text.encode("latin-1")
        for batch in batches:
            done = []
            for r in batch.to_dict("records"):
                if r["m"] != current:
                    if out:
                        out.write(TRAILER)
                        done.append((current, out.publish(), out.size))
                    current, out = r["m"], HashingFile(blob_folder)
                size = int(r["size"])
                xattrs = [(bytes(x["k"]), bytes(x["v"])) for x in (r["xattrs"] if r["xattrs"] is not None else ())]
                rdev = None if pd.isna(r["rdev_major"]) else (int(r["rdev_major"]), int(r["rdev_minor"]))
                link = r["link_target"] if isinstance(r["link_target"], str) else None
                out.write(entry_head(raw(r["path"]), r["kind"], mode=int(r["mode"]), uid=int(r["uid"]), gid=int(r["gid"]), size=size, mtime=t0, link=raw(link), rdev=rdev, xattrs=xattrs))
                if r["kind"] == "Regular" and size:
                    file, offset = place[r["image_id"], r["layer_idx"]]
                    if file not in opened:
                        for f in opened.values():
                            f.close()
                        opened = {file: open(file, "rb")}  # noqa: SIM115
                    source, left = opened[file], size
                    source.seek(offset + int(r["body_offset"]))
                    while left:
                        chunk = source.read(min(left, _CHUNK))
                        if not chunk:
                            raise ValidationError(f"the body of {r['path']} is {left} bytes short")
                        out.write(chunk)
                        left -= len(chunk)
                    out.write(padding(size))
            if done:
                yield pd.DataFrame(done, columns=["m", "digest", "size"])
        if out:
            out.write(TRAILER)
            yield pd.DataFrame([(current, out.publish(), out.size)], columns=["m", "digest", "size"])

    written = parts.mapInPandas(run, "m string, digest string, size long")
    return written.select(F.split("m", ",").cast("array<int>").alias("m"), "digest", "size")
