"""The entry table that all operators share.

Paths are strings whose characters stand for bytes (ISO-8859-1), so that any byte survives and order
is byte order within a component. Owners are decimal because they are unsigned 64-bit numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("Regular", "Directory", "Symlink", "Hardlink", "CharDevice", "BlockDevice", "Fifo", "Meta")
DEVICES = ("CharDevice", "BlockDevice")

XATTRS = T.ArrayType(T.StructType([T.StructField("k", T.BinaryType()), T.StructField("v", T.BinaryType())]))
ENTRIES = T.StructType(
    [
        T.StructField("image_id", T.IntegerType(), False),
        T.StructField("layer_idx", T.IntegerType(), False),
        T.StructField("entry_idx", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("mode", T.IntegerType()),
        T.StructField("uid", T.DecimalType(20, 0)),
        T.StructField("gid", T.DecimalType(20, 0)),
        T.StructField("size", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("link_target", T.StringType()),
        T.StructField("rdev_major", T.LongType()),
        T.StructField("rdev_minor", T.LongType()),
        T.StructField("xattrs", XATTRS),
    ]
)
#: What a hardlink takes over from the file at the end of its chain.
PAYLOAD = ["kind", "mode", "uid", "gid", "size", "content_hash", "link_target", "rdev_major", "rdev_minor", "xattrs"]
COLUMNS = [f.name for f in ENTRIES.fields]


def entries(df: DataFrame, **columns: Column) -> DataFrame:
    """An entry table from a few columns; the rest get usual values."""
    usual = {"mode": F.lit(0o644), "uid": F.lit(0), "gid": F.lit(0), "size": F.lit(0), "content_hash": F.lit(None), "link_target": F.lit(None), "rdev_major": F.lit(None), "rdev_minor": F.lit(None), "xattrs": F.array()}
    return df.select(*[(columns | {k: v for k, v in usual.items() if k not in columns})[f.name].cast(f.dataType).alias(f.name) for f in ENTRIES.fields])
