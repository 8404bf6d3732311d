"""Stored tables: coverage overlay, history cache, position log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.config import SESSION_WINDOW
from ebbline.staging import staged

OVERLAY_SCHEMA = (
    "ticker STRING, name STRING, sector STRING, industry STRING, "
    "catalyst STRUCT<type: STRING, headline: STRING, detail: STRING, date: STRING, severity: DOUBLE, transience: DOUBLE>, "
    "moat DOUBLE, balanceSheet DOUBLE, pe5yAvg DOUBLE, revGrowthFwdPct DOUBLE, epsGrowthFwdPct DOUBLE, "
    "shortInterestPct DOUBLE, bullCase ARRAY<STRING>, bearCase ARRAY<STRING>, deskNote STRING, peers ARRAY<STRING>"
)


def read_overlay(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Coverage overlay with the column names the plans use: one JSON object (or array) per line, or per file."""
    raw = spark.read.schema(OVERLAY_SCHEMA).json(path, multiLine=multi_line)
    return raw.select(
        "ticker", "name", F.col("sector").alias("overlay_sector"), F.col("industry").alias("overlay_industry"),
        F.col("catalyst.type").alias("catalyst_type"), F.col("catalyst.headline").alias("catalyst_headline"),
        F.col("catalyst.severity").alias("catalyst_severity"), F.col("catalyst.transience").alias("catalyst_transience"),
        "moat", F.col("balanceSheet").alias("balance_sheet"), F.col("pe5yAvg").alias("pe_5y_avg"),
        F.col("revGrowthFwdPct").alias("rev_growth_pct"), F.col("epsGrowthFwdPct").alias("eps_growth_pct"),
        F.col("shortInterestPct").alias("short_interest_pct"), F.col("bullCase").alias("bull_case"),
        F.col("bearCase").alias("bear_case"), F.col("deskNote").alias("desk_note"), "peers",
    )


def peer_edges(overlay: DataFrame) -> DataFrame:
    """(ticker, peer, pos) from the overlay's peer lists."""
    return overlay.select("ticker", F.posexplode("peers").alias("pos", "peer"))


def with_enough_history(bars: DataFrame, min_history: int = SESSION_WINDOW) -> DataFrame:
    """Bars of the names that have so many; the input is read once."""
    many = bars.withColumn("_n", F.count("*").over(Window.partitionBy("ticker")))
    return many.filter(F.col("_n") >= min_history).drop("_n")


def cached_history(spark: SparkSession, path: str, build, refresh: bool = False, min_history: int = SESSION_WINDOW) -> DataFrame:
    """Bars written once under ``path`` (by year) and read back; ``build()`` runs only if absent or on refresh."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if refresh or not exists:
        bars = with_enough_history(build(), min_history).withColumn("year", F.year("d"))
        # ranges of (year, ticker): a year is spread over tasks, and a task writes few files
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        bars.repartitionByRange(n, "year", "ticker").write.mode("overwrite").partitionBy("year").parquet(path)
        # the declared schema also holds when no name has enough history and nothing was written
        return spark.read.schema(bars.schema).parquet(path).drop("year")
    return spark.read.parquet(path).drop("year")


def append_history(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Adds bars to a written cache, replacing those of the same (ticker, d). Only the years of ``fresh`` are written anew."""
    fresh = staged(fresh.withColumn("year", F.year("d")))
    years = [r.year for r in fresh.select("year").distinct().collect()]
    stored = spark.read.schema(fresh.schema).parquet(path).filter(F.col("year").isin(years))
    merged = staged(stored.join(fresh.select("ticker", "d"), ["ticker", "d"], "left_anti").unionByName(fresh))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = merged.repartitionByRange(n, "year", "ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("year").parquet(path)


def position_state() -> list:
    """Aggregates that keep a ticker's state whatever the number of its events (partial sums, no event lists)."""
    at = F.struct("ts", "seq")
    toggled = F.when(F.col("action") == "toggle", at)
    changed = F.when(F.col("action").isin("enter", "clear"), at)
    entry = F.struct("action", "entry_price", "size_pct")
    return [
        F.count(toggled).alias("toggles"),
        F.max(toggled).alias("added"),
        F.max_by(entry, changed).alias("entry"),
        F.max(changed).alias("changed"),
    ]


def held_positions(state: DataFrame) -> DataFrame:
    """Tickers toggled on, with the entry logged since; entries on a name that is not held have no effect."""
    active = (F.col("entry.action") == "enter") & (F.col("changed") > F.col("added"))
    return state.filter(F.col("toggles") % 2 == 1).select(
        "ticker", F.col("added.ts").alias("added_at"),
        F.when(active, F.col("entry.entry_price")).alias("entry_price"),
        F.when(active, F.col("entry.size_pct")).alias("size_pct"),
    )


def current_positions(events: DataFrame) -> DataFrame:
    """Current positions from an append-only log ``events(ticker, ts, seq, action, entry_price, size_pct)``.

    Actions are toggle / enter / clear, ordered by (ts, seq).
    """
    return held_positions(events.groupBy("ticker").agg(*position_state()))
