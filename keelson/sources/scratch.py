"""Folders for results that outlive a job: in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):  # a folder of each machine's own would lose rows
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="keelson-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/keelson-{name}-{uuid.uuid4().hex}"
