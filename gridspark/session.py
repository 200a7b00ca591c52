"""Folders that a session's executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (a local session) a temporary one is made."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("gridspark.local.checkpoint", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="gridspark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("gridspark.local.checkpoint", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
