"""Queries over scored names: filters, rankings, facets, breadth, peers and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import VERDICTS
from ebbline.functions.scalar import half_up, lookup, ratio
from ebbline.operators.scoring import published

SORTS = {
    "score": lambda: F.col("signal_score").desc(),
    "day": lambda: F.col("dip_pct_day").asc(),
    "week": lambda: F.col("dip_pct_week").asc(),
    "cap": lambda: F.col("market_cap_b").desc(),
}


def dips(analyses: DataFrame) -> DataFrame:
    return analyses.filter(F.col("dip_pct_week") < 0)


def screen(analyses: DataFrame, verdict: str = "ALL", sector: str = "ALL", sort: str = "score") -> DataFrame:
    """Falling names with an optional verdict and sector, in one of four orders; ticker breaks ties."""
    df = dips(analyses)
    if verdict != "ALL":
        df = df.filter(F.col("verdict") == verdict)
    if sector != "ALL":
        df = df.filter(F.col("sector") == sector)
    return df.orderBy(SORTS[sort](), "ticker")


def point_lookup(analyses: DataFrame, ticker: str) -> DataFrame:
    return analyses.filter(F.upper("ticker") == ticker.upper())


def top_of(analyses: DataFrame, verdicts: tuple[str, ...], k: int) -> DataFrame:
    """First k names of the given verdicts in rank order (Spark keeps k rows per task)."""
    chosen = dips(analyses).filter(F.col("verdict").isin(*verdicts))
    return chosen.orderBy(F.col("signal_score").desc(), "ticker").limit(k)


def breadth(analyses: DataFrame) -> DataFrame:
    buyable = F.col("verdict").isin("BUY_THE_DIP", "ACCUMULATE")
    return analyses.agg(
        F.count("*").alias("covered"),
        F.count(F.when(buyable, 1)).alias("buyable"),
        F.coalesce(half_up(F.avg("dip_score")), F.lit(0)).alias("avg_score"),
        F.coalesce(F.avg("dip_pct_week"), F.lit(0.0)).alias("avg_dip"),
    )


def verdict_position(c: str = "verdict") -> Column:
    return lookup(c, {v: i for i, v in enumerate(VERDICTS)})


def verdict_facets(analyses: DataFrame) -> DataFrame:
    """Count per verdict in ladder order, zero counts included."""
    counts = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in VERDICTS]
    cells = [F.struct(F.lit(i).alias("pos"), F.lit(v).alias("verdict"), F.col(v).alias("names")) for i, v in enumerate(VERDICTS)]
    return dips(analyses).agg(*counts).select(F.inline(F.array(*cells)))


def sectors(analyses: DataFrame) -> DataFrame:
    return dips(analyses).select("sector").distinct().orderBy("sector")


def covered_peers(analyses: DataFrame, peer_edges: DataFrame) -> DataFrame:
    """Scored peers of each name, in listed order."""
    a = analyses.select(F.col("ticker").alias("peer"), "verdict", "dip_pct_week", "signal_score")
    return peer_edges.join(a, "peer").select("ticker", "pos", "peer", "verdict", "dip_pct_week", "signal_score")


def position_rows(positions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Covered positions with open P&L (NULL until entered) and the published levels."""
    a = analyses.select(
        "ticker", "price", "verdict", "signal_score", "dip_pct_day", "dip_pct_week",
        published("stop").alias("published_stop"), published("target1").alias("published_target1"),
    )
    pnl = F.when(F.col("entry_price").isNotNull(), (ratio(F.col("price"), F.col("entry_price")) - 1.0) * 100.0)
    return positions.join(a, "ticker").withColumn("pnl_pct", pnl)


def uncovered_positions(positions: DataFrame, analyses: DataFrame, overlay: DataFrame) -> DataFrame:
    missing = positions.join(analyses.select("ticker"), "ticker", "left_anti")
    names = overlay.select("ticker", "name")
    return missing.join(names, "ticker", "left").withColumn("name", F.coalesce("name", F.lit("Not in coverage")))


def open_pnl(rows: DataFrame) -> DataFrame:
    """Size-weighted P&L over entered positions; the size total counts as at least 1."""
    size = F.coalesce(F.col("size_pct"), F.lit(0.0))
    entered = F.col("pnl_pct").isNotNull()
    return rows.agg(
        F.count(F.when(entered, 1)).alias("entered"),
        F.coalesce(
            F.sum(F.when(entered, F.col("pnl_pct") * size))
            / F.greatest(F.sum(F.when(entered, size)), F.lit(1.0)),
            F.lit(0.0),
        ).alias("open_pnl_pct"),
    )


def latest_quotes(quotes: DataFrame, proxies: DataFrame) -> DataFrame:
    """Context strip: the newest usable quote of each index proxy; proxies without one are left out."""
    usable = quotes.filter(F.col("price").isNotNull())
    newest = usable.groupBy("symbol").agg(F.max_by(F.struct("price", "change_pct"), "ts").alias("q"))
    return newest.join(proxies, "symbol").select(
        "symbol", "label", F.col("q.price").alias("value"), F.col("q.change_pct").alias("change_pct")
    )
