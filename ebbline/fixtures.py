"""Domain tables derived from the driver's order-line tables (deterministic; every row of every table is used)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _standardise(x: str, *keys: str):
    w = Window.partitionBy(*keys)
    return (F.col(x) - F.avg(x).over(w)) / F.stddev_pop(x).over(w)


def bars(spark: SparkSession, sf_dir: str, grain: str = "nation", unit: str = "week") -> DataFrame:
    """bars(ticker, sector, d, o, c, v): one row per nation (or region) and week (or day)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name" if grain == "nation" else "r_name").alias("ticker"), F.col("r_name").alias("sector")
    )
    # orders find their nation first, so that lines move once and carry a number; what follows is as long as the calendar
    origin = orders.join(cust, F.col("o_custkey") == cust.c_custkey).select("o_orderkey", "c_nationkey")
    daily = (
        li.join(origin, li.l_orderkey == F.col("o_orderkey"))
        .groupBy("c_nationkey", "l_shipdate")
        .agg(F.sum("l_extendedprice").alias("p"), F.sum("l_quantity").alias("q"))
    )
    cell = (
        daily.join(place, F.col("c_nationkey") == place.n_nationkey)
        .groupBy("ticker", "sector", F.date_trunc(unit, "l_shipdate").cast("date").alias("d"))
        .agg(F.ln(F.sum("p") / F.sum("q")).alias("lp"), F.sum("q").alias("v"))
    )
    m = cell.groupBy("d").agg(F.avg("lp").alias("x")).select("d", _standardise("x").alias("zm"))
    s = cell.groupBy("sector", "d").agg(F.avg("lp").alias("x"))
    s = s.select("sector", "d", _standardise("x", "sector").alias("zs"))
    z = cell.withColumn("zc", _standardise("lp", "ticker"))
    r = z.join(m, "d").join(s, ["sector", "d"])
    r = r.withColumn("r", F.col("zm") * 0.012 + F.col("zs") * 0.008 + F.col("zc") * 0.015)
    w = Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    q = r.withColumn("cr", F.sum("r").over(w))
    overnight = 1.0 - F.dayofyear("d") % 10 / F.lit(10.0)
    return q.select(
        "ticker", "sector", "d",
        F.round(F.exp(F.col("cr") - F.col("r") * overnight) * 100.0, 4).alias("o"),
        F.round(F.exp("cr") * 100.0, 4).alias("c"),
        F.col("v").cast("double").alias("v"),
    )


def market_caps(spark: SparkSession, sf_dir: str, grain: str = "nation") -> DataFrame:
    """(ticker, market_cap_b): positive account balances per nation, in thousands."""
    cust = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    joined = cust.join(nation, cust.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    name = "n_name" if grain == "nation" else "r_name"
    return joined.groupBy(F.col(name).alias("ticker")).agg(
        (F.sum(F.greatest("c_acctbal", F.lit(0.0))) / 1000.0).alias("market_cap_b")
    )


def peer_edges(spark: SparkSession, sf_dir: str, grain: str = "nation") -> DataFrame:
    """(ticker, peer, pos): the other nations of the region, by nation key; the other regions at region grain."""
    if grain == "region":
        r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        names = r.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")))).alias("all"))
        one = names.select(F.explode("all").alias("me"), "all")
    else:
        n = table(spark, sf_dir, "nation")
        names = n.groupBy("n_regionkey").agg(
            F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")))).alias("all")
        )
        one = names.select(F.explode("all").alias("me"), "all")
    others = F.filter("all", lambda x: x["k"] != F.col("me.k"))
    return one.select(F.col("me.n").alias("ticker"), F.posexplode(others).alias("pos", "p")).select(
        "ticker", F.col("p.n").alias("peer"), "pos"
    )


def capped_bars(spark: SparkSession, sf_dir: str, grain: str = "nation", unit: str = "week") -> DataFrame:
    return bars(spark, sf_dir, grain, unit).join(market_caps(spark, sf_dir, grain), "ticker")


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars(ticker, sector, d, o, c, v, market_cap_b): one row per supplier and month, so names grow with the data.

    Every tenth supplier lists late, and every tenth stops trading.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey)
    names = s.select("s_suppkey", F.col("s_name").alias("ticker"), F.col("n_name").alias("sector"), (F.greatest("s_acctbal", F.lit(0.0)) / 1000.0).alias("market_cap_b"))
    cell = li.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("d")).agg(
        F.ln(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("lp"), F.sum("l_quantity").cast("double").alias("v")
    )
    kind = F.col("l_suppkey") % 10
    cell = cell.filter(~((kind == 3) & (F.col("d") < "1993-07-01")) & ~((kind == 7) & (F.col("d") > "1997-06-01")))
    c = F.round(F.exp(F.col("lp") - F.avg("lp").over(Window.partitionBy("l_suppkey"))) * 100.0, 4)
    priced = cell.withColumn("c", c).withColumn("o", F.round(F.col("c") * (F.month("d") % 5 + 198) / 200.0, 4))
    return priced.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("ticker", "sector", "d", "o", "c", "v", "market_cap_b")


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, peer, pos): the next three suppliers by key."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    mine = s.select(F.col("s_name").alias("ticker"), F.posexplode(F.array(*[F.col("s_suppkey") + j for j in (1, 2, 3)])).alias("pos", "k"))
    return mine.join(s, F.col("k") == F.col("s_suppkey")).select("ticker", F.col("s_name").alias("peer"), "pos")
