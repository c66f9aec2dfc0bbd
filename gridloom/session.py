"""Where jobs keep what driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, a temporary one if everything runs in one process,
    else an error: executors on other machines would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
