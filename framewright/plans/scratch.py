"""A folder for tables that a query writes on its way."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which driver and executors share; one of this machine only
    where that is unset and all of Spark is this one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "framewright-tables")
    return f"{named}/framewright-{uuid.uuid4().hex}"
