"""Accounting: what was read, what is written, what is saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.scalars import permille, render_set, saturating
from lamina.operators.compact import estimated_sizes

PLACEHOLDER = "(dry run)"


def layer_rows(layers: DataFrame) -> DataFrame:
    """Layers with estimated bytes and a placeholder for the digest, as a dry run shows them."""
    return estimated_sizes(layers).select("m", "bytes", F.lit(PLACEHOLDER).alias("digest"))


def totals(layer_sizes: DataFrame) -> DataFrame:
    """One row: bytes of all images (a layer counts once an image), of all layers, of different
    digests, saved, and saved in thousandths. Numbers stop at 2**64 - 1."""
    size = F.col("bytes").cast("decimal(20,0)")
    sums = layer_sizes.agg(F.coalesce(F.sum(size * F.size("m")), F.lit(0)).alias("i"), F.coalesce(F.sum(size), F.lit(0)).alias("o"))
    i, o = saturating(F.col("i")), saturating(F.col("o"))
    saved = F.greatest(i - o, F.lit(0).cast("decimal(38,0)"))
    return sums.select(i.cast("decimal(20,0)").alias("inputs_total"), o.cast("decimal(20,0)").alias("outputs_total"), saved.cast("decimal(20,0)").alias("saved"), permille(saved, i).alias("saved_permille"))


def layer_labels(layer_sizes: DataFrame) -> DataFrame:
    """(m, label, bytes, vs_naive): sets by name, and what sharing a layer saves."""
    n = F.size("m")
    label = F.concat(F.when(n == 0, "empty ").when(n == 1, "per-image ").otherwise("shared "), render_set(F.col("m")))
    more = F.when(n < 2, F.lit("—")).otherwise(F.concat(F.lit("+"), ((n - 1) * F.col("bytes")).cast("string")))
    return layer_sizes.select("m", label.alias("label"), "bytes", more.alias("vs_naive"))


def input_rows(images: DataFrame, layers: DataFrame) -> DataFrame:
    """(image_id, label, layer_count, total_bytes): images (image_id, repo_tags) and their layers
    (image_id, size)."""
    sums = layers.groupBy("image_id").agg(F.count("*").alias("layer_count"), F.sum("size").alias("total_bytes"))
    label = F.coalesce(F.try_element_at("repo_tags", F.lit(1)), F.lit("<untagged>"))
    return images.join(sums, "image_id", "left").select("image_id", label.alias("label"), F.coalesce("layer_count", F.lit(0)).alias("layer_count"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"))


def platform_divergence(images: DataFrame, fields: list[str] = ("architecture", "os", "variant")) -> DataFrame:
    """(field): the fields in which some image differs from the first; a missing value differs from
    any other. One image differs from none."""
    seen = images.agg(*[F.size(F.collect_set(F.coalesce(F.concat(F.lit("="), F.col(f)), F.lit("-")))).alias(f) for f in fields])
    return seen.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) > 1).alias("differs")) for f in fields])).alias("r")).select("r.*").filter("differs").select("field")


def needed_sources(layers: DataFrame) -> DataFrame:
    """(image_id, layer_idx): the input layers whose bodies an output needs."""
    return layers.filter("kind = 'Regular' and size > 0").select("image_id", "layer_idx").distinct()
