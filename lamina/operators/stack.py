"""The order of layers in each image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stacks(layer_keys: DataFrame) -> DataFrame:
    """(image_id, position, m) from the distinct sets m: more images come first, equals in their
    order, so that an image's own layer is last."""
    rows = layer_keys.select("m").distinct().select(F.explode("m").alias("image_id"), "m")
    order = Window.partitionBy("image_id").orderBy(F.desc(F.size("m")), "m")
    return rows.withColumn("position", (F.row_number().over(order) - 1).cast("long")).select("image_id", "position", "m")
