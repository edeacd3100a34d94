"""What makes two entries the same: path and contents, not where they were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.schema import DEVICES

FIELDS = ["path", "kind", "mode", "uid", "gid", "size", "content_hash", "link_target", "rdev_major", "rdev_minor", "xattrs"]


def _sized(value: Column) -> Column:
    """Text with its length before it, so that joined fields can't be confused; null is "-"."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _xattrs(column: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(column), lambda x: F.concat(F.hex(x["k"]), F.lit("="), F.hex(x["v"]))), ",")


def fields() -> dict[str, Column]:
    """A hardlink counts as a regular file; a link target counts for symlinks only, device numbers
    for devices only. Times, names of owners and provenance don't count."""
    kind = F.col("kind")
    device = kind.isin(*DEVICES)
    return {
        **{c: F.col(c) for c in ("path", "mode", "uid", "gid", "size", "content_hash")},
        "kind": F.when(kind == "Hardlink", "Regular").otherwise(kind),
        "link_target": F.when(kind == "Symlink", F.col("link_target")),
        "rdev_major": F.when(device, F.col("rdev_major")),
        "rdev_minor": F.when(device, F.col("rdev_minor")),
        "xattrs": _xattrs(F.col("xattrs")),
    }


def identity() -> Column:
    """SHA-256 of all fields; equal for null and null, different for null and anything else."""
    f = fields()
    return F.sha2(F.concat(*[_sized(f[c]) for c in FIELDS]), 256)


def with_identity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ident", identity())
