"""Which images share which entries.

Image sets are sorted arrays of image ids; they order by their ids in turn. A set holds at most all
images, so it is small whatever the number of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import paths

#: Stands for an ancestor that an image lacks; no digest equals it.
ABSENT = "-"


def image_set(ids: Column) -> Column:
    return F.array_sort(F.collect_set(ids))


def from_ids(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def insert(ids: Column, one: Column) -> Column:
    return F.array_sort(F.array_union(ids, F.array(one)))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def naive(rows: DataFrame) -> DataFrame:
    """(ident, m): the images that hold an entry."""
    return rows.groupBy("ident").agg(image_set(F.col("image_id")).alias("m"))


def folder_signatures(rows: DataFrame) -> DataFrame:
    """(image_id, folder, anc_sig): for every directory that has entries, a digest of the
    identities of it and all above it. Chains are found once a directory, not once an entry."""
    folders = rows.select("image_id", paths.parent(F.col("path")).alias("folder")).distinct().filter("folder <> ''")
    steps = folders.select("image_id", "folder", F.posexplode(paths.self_and_ancestors(F.col("folder"))).alias("_up", "path"))
    known = rows.select("image_id", "path", "ident")
    chain = F.array_sort(F.collect_list(F.struct("_up", F.coalesce("ident", F.lit(ABSENT)).alias("ident"))))
    found = steps.join(known, ["image_id", "path"], "left").groupBy("image_id", "folder").agg(chain.alias("_c"))
    return found.select("image_id", "folder", F.sha2(F.array_join(F.col("_c.ident"), ","), 256).alias("anc_sig"))


def with_signature(rows: DataFrame) -> DataFrame:
    """Adds anc_sig; entries at the top have the same for all images."""
    sig = folder_signatures(rows)
    placed = rows.withColumn("folder", paths.parent(F.col("path")))
    return placed.join(sig, ["image_id", "folder"], "left").withColumn("anc_sig", F.coalesce("anc_sig", F.lit(""))).drop("folder")


def effective(signed: DataFrame) -> DataFrame:
    """(ident, anc_sig, m): the images that hold an entry and agree on all that is above it. The
    classes of an entry share no image and cover its naive set."""
    return signed.groupBy("ident", "anc_sig").agg(image_set(F.col("image_id")).alias("m"))
