"""The folder that the driver and the executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below spark.checkpoint.dir; where that is unset, below a temporary one, in local mode alone."""
    shared = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and the executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="cellgauge-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
