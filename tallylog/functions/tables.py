"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing has used, in the folder that ``spark.checkpoint.dir`` names.

    Where that is unset a local session has a temporary folder, which ends with the process; a cluster session gets an error, as
    executors would not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="tallylog-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        shared = "file://" + _local[app]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later steps share one evaluation, and an executor lost costs a read."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
