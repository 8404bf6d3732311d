"""The market screen: merge coverage, profile, ratios, metrics and history, then score the newest session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import MIN_LIVE_SESSIONS, SESSION_WINDOW, WalkForwardConfig
from ebbline.functions.scalar import finite, finite_or, ratio, text_or
from ebbline.operators import scoring
from ebbline.operators.asof import as_of
from ebbline.plans.walkforward import as_of_decompositions, decomposed_newest, indexed_features
from ebbline.staging import broadcast_if_small, staged


#: A sector may hold a large part of all names; its snapshots are few.
SECTOR_SALTS = 8


def newest_sessions(bars: DataFrame, sessions: int = SESSION_WINDOW) -> DataFrame:
    """The last N bars of each name."""
    newest = Window.partitionBy("ticker").orderBy(F.col("d").desc())
    return bars.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= sessions).drop("_age")


def admitted(bars: DataFrame, min_sessions: int = MIN_LIVE_SESSIONS) -> DataFrame:
    """Only names with enough history; the input is read once, and by the exchange of the windows around it."""
    counted = bars.withColumn("_n", F.count("*").over(Window.partitionBy("ticker")))
    return counted.filter(F.col("_n") >= min_sessions).drop("_n")


def require_names(bars: DataFrame) -> DataFrame:
    """Fail early on an empty universe (runs one small job)."""
    if bars.select("ticker").isEmpty():
        raise ValueError("no name has enough history to be screened")
    return bars


def display_prices(bars: DataFrame) -> DataFrame:
    """Two-decimal series for scoring; the exact moves and the last bar's volume ride along."""
    w = Window.partitionBy("ticker").orderBy("d")
    day, week = (
        F.coalesce((ratio(F.col("c"), F.lag("c", n).over(w)) - 1.0) * 100.0, F.lit(0.0)) for n in (1, 5)
    )
    moved = bars.withColumns({"exact_day": day, "exact_week": week, "exact_close": F.col("c")})
    return moved.withColumns({"c": F.round("c", 2), "o": F.round("o", 2)})


def snapshot(overlay: DataFrame, last_bars: DataFrame, profile: DataFrame, ratios: DataFrame, metrics: DataFrame,
             sector_pe: DataFrame) -> DataFrame:
    """One row per covered name with every field filled from its best source.

    ``last_bars(ticker, last_d, exact_close, exact_day, exact_week, v)`` limits the result to names with history. The
    attribute tables have one row per name; ``sector_pe(sector, date, pe)`` has snapshots, of which the newest with a
    value that is not later than the name's last bar counts.
    """
    df = overlay.join(last_bars, "ticker")
    for side in (profile, ratios, metrics):
        df = df.join(side, "ticker", "left")
    df = df.withColumn("sector", text_or("profile_sector", "overlay_sector"))
    known = sector_pe.filter(finite("pe").isNotNull())
    df = as_of(df, known, ["sector"], "last_d", "date", {"live_sector_pe": "pe"}, salts=SECTOR_SALTS)
    avg = finite_or("average_volume", 0.0)
    today = finite_or("volume", F.col("v"))
    return df.select(
        "ticker", "sector",
        text_or("company_name", "name").alias("name"),
        text_or("profile_industry", "overlay_industry").alias("industry"),
        (finite_or("market_cap", 0.0) / 1e9).alias("market_cap_b"),
        finite_or("quote_price", F.col("exact_close")).alias("price"),
        finite_or("change_pct", F.col("exact_day")).alias("dip_pct_day"),
        F.col("exact_week").alias("dip_pct_week"),
        finite_or("beta", 1.0).alias("beta"),
        (avg / 1e6).alias("avg_volume_m"),
        F.when(avg > 0, today / avg).otherwise(1.0).alias("volume_ratio"),
        "short_interest_pct", "catalyst_type", "catalyst_severity", "catalyst_transience",
        finite_or("pe_ttm", F.col("pe_5y_avg")).alias("pe_forward"),
        "pe_5y_avg",
        F.coalesce(finite("live_sector_pe"), F.col("pe_5y_avg") * 0.9).alias("sector_pe"),
        finite_or("ev_to_ebitda", 12.0).alias("ev_to_ebitda"),
        (finite_or("fcf_yield", 0.0) * 100).alias("fcf_yield_pct"),
        (finite_or("gross_margin", 0.0) * 100).alias("gross_margin_pct"),
        (finite_or("operating_margin", 0.0) * 100).alias("op_margin_pct"),
        "rev_growth_pct", "eps_growth_pct",
        (finite_or("roic", 0.0) * 100).alias("roic_pct"),
        finite_or("net_debt_ebitda", 0.0).alias("net_debt_to_ebitda"),
        "moat", "balance_sheet",
    )


def last_bars(bars: DataFrame) -> DataFrame:
    """Newest bar of each name with its exact moves, in one aggregation."""
    newest = F.max_by(F.struct(F.col("d").alias("last_d"), "exact_close", "exact_day", "exact_week", "v"), "d")
    return bars.groupBy("ticker").agg(newest.alias("b")).select("ticker", "b.*")


CONFIG = WalkForwardConfig(min_history=MIN_LIVE_SESSIONS, min_names=1, last_only=True)
MOVES = ("exact_day", "exact_week")


def market_caps(overlay: DataFrame, profile: DataFrame) -> DataFrame:
    """(ticker, market_cap_b) of the covered names, 0 where it is unknown."""
    sized = overlay.select("ticker").join(profile.select("ticker", "market_cap"), "ticker", "left")
    return sized.select("ticker", (finite_or("market_cap", 0.0) / 1e9).alias("market_cap_b"))


def _scored(snap: DataFrame, rows: DataFrame) -> DataFrame:
    measured = rows.drop("price", "dip_pct_day", "dip_pct_week", "volume_ratio", "avg_volume", "di", "t", "d")
    return scoring.analyze(snap.join(measured, "ticker"))


def analyses(bars: DataFrame, peer_edges: DataFrame, overlay: DataFrame, profile: DataFrame, ratios: DataFrame,
             metrics: DataFrame, sector_pe: DataFrame) -> DataFrame:
    """Every covered name with at least 60 sessions, fully scored on its newest session."""
    series = require_names(staged(display_prices(admitted(newest_sessions(bars)))))
    snap = staged(snapshot(overlay, last_bars(series), profile, ratios, metrics, sector_pe))
    caps = snap.select("ticker", "market_cap_b")
    rows, _ = as_of_decompositions(series.join(caps, "ticker").drop("sector"), peer_edges, CONFIG, moves=MOVES)
    return _scored(snap, rows)


def analyses_of(names: DataFrame, series: DataFrame, axis: DataFrame, levels: DataFrame, peer_edges: DataFrame,
                overlay: DataFrame, profile: DataFrame, ratios: DataFrame, metrics: DataFrame, sector_pe: DataFrame) -> DataFrame:
    """``analyses`` of ``names(ticker)`` alone: ``series`` holds the newest sessions of those names and of their peers,
    ``axis`` and ``levels(d, market_level)`` are those of the whole market."""
    shown = staged(display_prices(series))
    own = shown.join(broadcast_if_small(names), "ticker", "left_semi")
    snap = staged(snapshot(overlay, last_bars(own), profile, ratios, metrics, sector_pe))
    caps = market_caps(overlay, profile)
    axis, indexed = indexed_features(shown.join(caps, "ticker").select("ticker", "d", "o", "c", "v", *MOVES, "market_cap_b"), CONFIG, MOVES, axis)
    return _scored(snap, decomposed_newest(axis, indexed, names, levels, peer_edges))
