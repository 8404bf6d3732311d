"""Session settings and partition helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tuned(spark: SparkSession) -> SparkSession:
    """Settings the jobs rely on. Values the cluster was started with win; only unset ones are filled in."""
    given = spark.sparkContext.getConf()
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into the session's shuffle partition count.

    For steps whose cost is computation rather than bytes: a fixed count is not merged back by adaptive
    coalescing, and the windows and aggregations on these keys that follow need no further exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
