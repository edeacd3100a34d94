"""Squashing a stream of entries.

The state of an image follows from two tables of maxima, the last write of each path and the latest
markers. Maxima of a batch and of what was before combine to those of both, so each micro-batch is
merged into the tables, in whatever order entries arrive. A version of the tables is written for
each batch and named by its number: a batch that is run again replaces its own version only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import squash


class IncrementalSquash:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version = -1

    def _read(self, version: int) -> tuple[DataFrame, DataFrame]:
        at = f"{self.folder}/{version}"
        return self.spark.read.parquet(f"{at}/last"), self.spark.read.parquet(f"{at}/markers")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: adds the entries of a micro-batch."""
        rows = squash.decoded(batch)
        last, markers = squash.last_writes(rows), squash.marker_times(rows)
        if batch_id > 0:
            old_last, old_markers = self._read(batch_id - 1)
            both = old_last.unionByName(last).withColumn("action", F.lit(None).cast("string"))
            last = squash.last_writes(both)
            markers = old_markers.unionByName(markers).groupBy("image_id", "victim").agg(F.max("removed").alias("removed"), F.max("cleared").alias("cleared"))
        last.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}/last")
        markers.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}/markers")
        self.version = batch_id

    def state(self) -> DataFrame:
        """All paths after the batches so far, as squash() gives them."""
        return squash.apply_markers(*self._read(self.version))


def squash_stream(entries: DataFrame, folder: str, checkpoint: str):
    """(query, state): a running query over a stream of entries, and the state it keeps."""
    state = IncrementalSquash(entries.sparkSession, folder)
    query = entries.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, state
