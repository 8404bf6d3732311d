"""Intermediate tables on shared storage.

A table that several later steps read is written once as parquet under ``spark.checkpoint.dir`` and read back:
lineage ends there (a lost executor re-reads files instead of recomputing), each reader prunes columns, and the
optimizer sees real sizes. The folder's owner expires old runs.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


@cache
def _local_folder() -> str:
    """One folder per process for runs on a single machine, such as tests."""
    return tempfile.mkdtemp(prefix="ebbline-")


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(_KEY, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_KEY} must name a folder all executors share")
    return _local_folder()


def staged(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_LIMIT = 64 << 20


def broadcast_if_small(table: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint for a stored table whose files are at most ``limit`` bytes; beyond it an ordinary join."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(table) if size <= limit else table
