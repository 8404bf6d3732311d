"""Helpers that the operators of this package share."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.staging import broadcast_if_small, staged

#: Keys that hold over one part in HOT of the rows are joined by broadcast, see ``looked_up``.
HOT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(stored: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if its files have at most 8 MB, otherwise without one."""
    return broadcast_if_small(stored, 8 << 20)


def is_small(stored: DataFrame) -> bool:
    """The files of a stored table have at most 8 MB."""
    return 0 < input_bytes(stored) <= 8 << 20


class Sent:
    """An object of this package on its way to all tasks: a broadcast of its pickled bytes."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self.sent.value)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size of a table's files; 0 where it has no usable figure."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text makes a part of its own."""
    text = batch.column(column)
    if pa.types.is_string(text.type) or pa.types.is_binary(text.type):
        text = text.cast(pa.large_binary())
    n = len(text)
    if not n:
        return
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def ragged(values: list[np.ndarray], dtype) -> pa.Array:
    """A list column from one numpy array per row."""
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(dtype, copy=False)))


def looked_up(rows: DataFrame, facts: DataFrame, key: str, count: str = "rows") -> DataFrame:
    """rows with the columns of their key's row in the stored table ``facts``; rows without one go.

    ``facts`` has one row per key and tells in ``count``, which is dropped, how many rows hold it. A table of at most
    8 MB is broadcast. Beyond it, the keys that hold over one part in HOT of all rows (so fewer than HOT keys) are
    broadcast, and the exchange of the others has no large key.
    """
    if is_small(facts):
        return rows.join(F.broadcast(facts.drop(count)), key)
    total = facts.agg(F.sum(count)).first()[0] or 0
    common = staged(facts.where(F.col(count) * HOT > total))
    often = rows.join(F.broadcast(common.drop(count)), key)
    rest = rows.join(F.broadcast(common.select(key)), key, "left_anti")
    return often.unionByName(rest.join(facts.where(F.col(count) * HOT <= total).drop(count), key))
