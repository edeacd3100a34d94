"""Placing entries into layers, one layer for each image set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import paths
from lamina.operators import membership


def placed(signed: DataFrame) -> DataFrame:
    """Each row with the set m of its class; a hardlink stays in its image's own layer."""
    joined = signed.join(membership.effective(signed), ["ident", "anc_sig"])
    return joined.withColumn("m", F.when(F.col("kind") == "Hardlink", F.array("image_id")).otherwise(F.col("m"))).drop("ident", "anc_sig")


def canonical(rows: DataFrame) -> DataFrame:
    """One row for each m and path: that of the least image id."""
    rest = [c for c in rows.columns if c not in ("m", "path")]
    return rows.groupBy("m", "path").agg(F.min_by(F.struct(*rest), "image_id").alias("_row")).select("m", "path", "_row.*").select(*rows.columns)


def backfill(layers: DataFrame, live: DataFrame) -> DataFrame:
    """Layers with every strict ancestor of their entries; a missing one comes from the least image
    of the layer's set, and is left out if that image lacks it too."""
    present = layers.select("m", "path")
    folders = present.select("m", paths.parent(F.col("path")).alias("path")).distinct().filter("path <> ''")
    needed = folders.select("m", F.explode(paths.self_and_ancestors(F.col("path"))).alias("path")).distinct()
    missing = needed.join(present, ["m", "path"], "left_anti").withColumn("image_id", F.col("m")[0])
    added = missing.join(live, ["image_id", "path"]).select(*layers.columns)
    return layers.unionByName(added)


def subset_layers(signed: DataFrame) -> DataFrame:
    """(m, path, entry): the layers before back-fill."""
    return canonical(placed(signed))


def missing_ancestors(layers: DataFrame) -> DataFrame:
    """(m, path): ancestors that a layer should hold and doesn't; empty if all is well."""
    present = layers.select("m", "path")
    needed = present.select("m", F.explode(paths.strict_ancestors(F.col("path"))).alias("path")).distinct()
    return needed.join(present, ["m", "path"], "left_anti")
