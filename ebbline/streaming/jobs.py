"""Structured Streaming jobs: session bars from ticks, filing dedupe, running positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbline.config import LIVE_RAISE_KINDS
from ebbline.sources.tables import position_state


def session_bars(ticks: DataFrame, session: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Bars from ``ticks(ticker, ts, seq, price, size)``; ticks may arrive late by ``lateness``.

    In append mode (``write_available``) a bar comes once, when it is sealed; in update mode (``upsert_batches``) open
    sessions are published too, and ``newest_by_key`` over (ticker, d) gives every bar as it stands.

    One row of partial state per (session, ticker) and task: a hot ticker is combined before the exchange.
    """
    at = F.struct("ts", "seq")
    return (
        ticks.filter(F.col("price") > 0)
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", session), "ticker")
        .agg(
            F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
            F.max_by("price", at).alias("c"), F.sum("size").alias("v"),
        )
        .select("ticker", F.col("window.start").cast("date").alias("d"), "o", "h", "l", "c", "v")
    )


def distinct_filings(filings: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Live raises, each accession number once; state expires with the watermark on ``filed_at``."""
    live = filings.filter(F.col("kind").isin(*LIVE_RAISE_KINDS))
    return live.withWatermark("filed_at", lateness).dropDuplicatesWithinWatermark(["accession_number"])


def filing_states(filings: DataFrame) -> DataFrame:
    """Live raises by accession number, for ``upsert_batches``: the first filed row, whatever the order of arrival.

    State is one row per accession number; nothing is late, so nothing is lost.
    """
    live = filings.filter(F.col("kind").isin(*LIVE_RAISE_KINDS) & F.col("accession_number").isNotNull())
    return live.groupBy("accession_number").agg(F.min(F.struct("filed_at", "kind")).alias("s")).select("accession_number", "s.*")


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; files are committed exactly once."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def position_states(events: DataFrame) -> DataFrame:
    """Running state per ticker (update mode): aggregates only, never the events themselves."""
    return events.groupBy("ticker").agg(*position_state())


def upsert_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's changed rows with its number; re-running a batch replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return (
        df.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest_by_key(versions: DataFrame, *key: str) -> DataFrame:
    """Current rows of an ``upsert_batches`` table: the row of the highest batch per key (by default the ticker)."""
    key = key or ("ticker",)
    cols = [c for c in versions.columns if c not in (*key, "batch")]
    return versions.groupBy(*key).agg(F.max_by(F.struct(*cols), "batch").alias("s")).select(*key, "s.*")
