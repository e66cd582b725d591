"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and all of Spark is
    this one process (as in tests). Spark removes checkpoints that nothing refers to any more where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "framewright-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, from which any executor reads it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
