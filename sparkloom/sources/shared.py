"""The folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import UnsupportedError


def _top(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir; below the machine's own temporary folder only where that is unset and all runs in one process, as in tests."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not top:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise UnsupportedError("set spark.checkpoint.dir to a folder that all executors see")
        top = tempfile.gettempdir() + "/sparkloom-shared"
    return f"{top.rstrip('/')}/{context.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder, shared by all executors, that stays until remove_shared."""
    return f"{_top(spark)}/{uuid.uuid4().hex}"


def remove_shared(spark: SparkSession) -> None:
    """Removes all that this application has put into the shared folder; results not read by then can no longer be."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_top(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
