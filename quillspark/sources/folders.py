"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder shared by driver and executors (``spark.checkpoint.dir``).  A
    local session that names none gets a temporary one, which goes when Python
    ends; on a cluster a folder has to be named, as one of this machine would
    be out of reach of the executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        path = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[key] = "file://" + path
    return _own[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows does not
    depend on the executors that made it."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
