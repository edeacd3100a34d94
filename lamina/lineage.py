"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; where it is unset, a folder is made on a local master only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, checkpointed: lost executors can't take them away."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
