"""As-of join: to each row the newest row of another table that is not later, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, take: dict[str, str], salts: int = 1) -> DataFrame:
    """``left`` with columns of the newest ``right`` row of its keys whose ``since`` is not later than ``at``.

    ``take`` maps new names to columns of ``right``; they are NULL where there is no such row, and where ``at`` or a key
    is NULL. Of several right rows at one instant the greatest (in the order of ``take``) counts.

    Both tables are stacked and read in one sorted pass per key, with one exchange and no range join; right rows come
    before left rows of the same instant. Right rows are first reduced to one per (key, instant). Where a key may hold a
    large part of the left rows and few right rows, ``salts`` deals its left rows out and repeats its right rows.
    """
    salt = [F.pmod(F.xxhash64(*left.columns), F.lit(salts)).alias("_salt")] if salts > 1 else []
    every = [F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("_salt")] if salts > 1 else []
    value = F.struct(*[F.col(c).alias(n) for n, c in take.items()])
    facts = right.filter(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("_at")).agg(F.max(value).alias("_fact")).select("*", *every)
    rows = left.select(*keys, F.col(at).alias("_at"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), *salt)
    kind_of_fact, kind_of_row = facts.schema["_fact"].dataType, rows.schema["_row"].dataType
    both = rows.withColumn("_fact", F.lit(None).cast(kind_of_fact)).unionByName(
        facts.withColumn("_row", F.lit(None).cast(kind_of_row)).select(*rows.columns, "_fact")
    )
    order = Window.partitionBy(*keys, *["_salt"][: len(salt)]).orderBy(F.asc_nulls_first("_at"), F.col("_row").isNotNull())
    newest = F.last("_fact", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    known = both.withColumn("_fact", newest).filter(F.col("_row").isNotNull())
    usable = F.col("_at").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    return known.select("_row.*", *[F.when(usable, F.col(f"_fact.{n}")).alias(n) for n in take])
