"""A place for files that the driver and all executors can reach."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder's name below spark.checkpoint.dir; where that is unset, a local one for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/tesselite/{tag}-{uuid.uuid4().hex}"
