"""Folders on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder, then set as such, only where it is unset and all of Spark is one process."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandlake-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name below :func:`shared_dir` that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
