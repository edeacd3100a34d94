"""Sizes of layers, and dissolving those that are too small.

A dissolved layer's entries go to strictly smaller sets only, so layers of one set size never feed
each other: all of a size are judged and dissolved together, from the largest to two, and what has
grown meanwhile counts when its turn comes. The number of rounds is the number of images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalars import ceil_block, record_length
from lamina.lineage import cut
from lamina.operators.partition import backfill, canonical

#: Bytes below which a shared layer is dissolved, and bytes at the end of an archive.
MIN_LAYER_SIZE, TRAILER, HEADER = 16 * 1024, 1024, 512
_XATTR_PREFIX = len("SCHILY.xattr.")


def xattr_bytes(xattrs: Column) -> Column:
    """Bytes of the extended-header records of attributes."""
    one = lambda x: record_length(_XATTR_PREFIX + F.octet_length(x["k"]) + 1 + F.octet_length(x["v"]))
    return F.aggregate(F.coalesce(xattrs, F.array().cast("array<struct<k:binary,v:binary>>")), F.lit(0).cast("long"), lambda acc, x: acc + one(x).cast("long"))


def entry_bytes() -> Column:
    """Bytes of an entry in an archive, about: header, attributes and body, in whole blocks."""
    body = F.when(F.col("kind") == "Regular", ceil_block(F.col("size"))).otherwise(F.lit(0).cast("long"))
    return F.lit(HEADER) + ceil_block(xattr_bytes(F.col("xattrs"))) + body


def estimated_sizes(layers: DataFrame) -> DataFrame:
    """(m, n_entries, bytes)"""
    return layers.groupBy("m").agg(F.count("*").alias("n_entries"), (F.lit(TRAILER) + F.sum(entry_bytes())).cast("long").alias("bytes"))


def destinations(small: DataFrame, keys: DataFrame) -> DataFrame:
    """(m, image_id, dest) for each image of each dissolved set: the largest existing set that is
    strictly within it and has the image, of equals the first; else the image alone. The tables
    have one row for each layer, so their number is bounded by the sets of images."""
    images = small.select("m", F.explode("m").alias("image_id"))
    held = keys.select(F.col("m").alias("c"), F.explode("m").alias("image_id"))
    fits = images.join(held, "image_id").filter((F.size("c") < F.size("m")) & (F.size(F.array_except("c", "m")) == 0))
    best = fits.groupBy("m", "image_id").agg(F.min(F.struct((-F.size("c")).alias("s"), "c"))["c"].alias("_best"))
    return images.join(best, ["m", "image_id"], "left").select("m", "image_id", F.coalesce("_best", F.array("image_id")).alias("dest"))


def dissolve(layers: DataFrame, live: DataFrame, threshold: int = MIN_LAYER_SIZE) -> DataFrame:
    """Layers of two or more images, none estimated under `threshold` bytes; 0 changes nothing."""
    if threshold <= 0:
        return layers
    out = cut(layers)
    for n in range(out.agg(F.max(F.size("m"))).first()[0] or 0, 1, -1):
        sizes = cut(estimated_sizes(out))
        small = sizes.filter((F.size("m") == n) & (F.col("bytes") < threshold)).select("m")
        if small.isEmpty():
            continue
        dest = destinations(small, sizes.filter(F.size("m") < n).select("m")).select("m", "dest").distinct()
        moved = out.join(F.broadcast(dest) if _few(dest) else dest, "m").withColumn("m", F.col("dest")).drop("dest").select(*out.columns)
        stay = out.join(small, "m", "left_anti")
        touched = moved.select("m").distinct()
        merged = canonical(stay.join(touched, "m", "left_semi").unionByName(moved))
        out = cut(stay.join(touched, "m", "left_anti").unionByName(backfill(merged, live)))
    return out


def _few(rows: DataFrame, most: int = 10_000) -> bool:
    """Whether a table has few rows, counted no further than that."""
    return rows.limit(most + 1).count() <= most
