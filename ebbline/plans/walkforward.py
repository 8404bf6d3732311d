"""Point-in-time observations: every fall of every name, scored with what was known then, with what came after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import WalkForwardConfig
from ebbline.functions.scalar import ratio
from ebbline.operators import decompose as dec
from ebbline.operators import factors, panel, scoring
from ebbline.operators.technicals import technicals
from ebbline.staging import broadcast_if_small, staged

SNAPSHOT = (
    "price", "dip_pct_day", "dip_pct_week", "volume_ratio", "rsi14", "sma50", "sma200", "high_52w", "low_52w",
    "drawdown_pct", "range_position", "atr_pct", "realized_vol_pct", "dip_z", "support_level", "support_defined",
    "resistance_level", "avg_volume",
)
CARRIED = ("d", "c", "rn", "next_di", "log_ret", "gap_share", "admitted_di", "t_lo", "t_hi", *SNAPSHOT)


def indexed_features(
    bars: DataFrame, cfg: WalkForwardConfig, moves: tuple[str, str] | None = None, axis: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Stage the session axis and the bars with technicals and history positions: one exchange by ticker.

    Bars of some names only come with the ``axis`` of all."""
    axis = axis or staged(panel.date_axis(bars))
    # levels are read on as-of rows only, and of those only on falls when nothing else is scored
    scored = F.col("rn") >= cfg.min_history
    if cfg.last_only:
        scored = F.lead("d").over(Window.partitionBy("ticker").orderBy("d")).isNull()
    elif cfg.require_dip:
        scored = scored & (F.col("dip_pct_week") < 0)
    featured = technicals(bars.join(axis, "d"), moves, scored).withColumns(
        {"price": F.col("c"), "weight": factors.member_weight("market_cap_b")}
    )
    return axis, staged(panel.index_bars(featured.drop("prev_c", "ret"), cfg.min_history))


def as_of_decompositions(
    bars: DataFrame, peer_edges: DataFrame, cfg: WalkForwardConfig, moves: tuple[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """One row per (ticker, as-of session) with snapshot, technicals and decomposition; and the session axis.

    ``bars(ticker, d, o, c, v, market_cap_b)`` with positive closes, one row per (ticker, d);
    ``peer_edges(ticker, peer)``. A name without a bar on the session takes part with its last one.
    """
    axis, indexed = indexed_features(bars, cfg, moves)
    return decomposed(axis, indexed, peer_edges, cfg), axis


def decomposed(axis: DataFrame, indexed: DataFrame, peer_edges: DataFrame, cfg: WalkForwardConfig) -> DataFrame:
    """The as-of rows of an indexed panel."""
    days = staged(panel.calendar(axis, panel.segments(indexed, cfg)))
    epochs = staged(panel.epoch_table(days))
    market = staged(factors.market_levels(indexed, epochs))
    return _measured(indexed, indexed, days, epochs, market, peer_edges)


def decomposed_newest(axis: DataFrame, indexed: DataFrame, names: DataFrame, levels: DataFrame, peer_edges: DataFrame) -> DataFrame:
    """The newest session's rows of ``names(ticker)`` alone, with the market's stored ``levels(d, market_level)``.

    ``indexed`` holds those names and their peers; levels are on the sessions in all members' windows.
    """
    at = axis.join(levels, "d", "left")
    oldest = at.filter(F.col("market_level").isNotNull()).agg(F.min("di")).first()[0] or 0
    newest = axis.filter(F.col("di") == F.col("last_di"))
    segs = newest.select(F.col("di").alias("t"), F.lit(1).alias("seg"), F.lit(0).alias("members"), F.lit(oldest).alias("latest_start"))
    days = staged(panel.calendar(axis, segs))
    carried = Window.orderBy("di").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("market_level").isNotNull(), F.col("di"))
    market = at.select(
        F.lit(1).alias("seg"), "di", F.last("market_level", ignorenulls=True).over(carried).alias("market_level"),
        F.last(known, ignorenulls=True).over(carried).alias("market_di"),
    )
    own = indexed.join(broadcast_if_small(names), "ticker", "left_semi")
    edges = peer_edges.join(broadcast_if_small(names), "ticker", "left_semi")
    return _measured(own, indexed, days, staged(panel.epoch_table(days)), staged(market), edges)


def _measured(own: DataFrame, indexed: DataFrame, days: DataFrame, epochs: DataFrame, market: DataFrame, peer_edges: DataFrame) -> DataFrame:
    """The as-of rows of ``own`` bars: measured by epoch, the late ones in windows of their own."""
    placed = panel.epochs_of_bars(own, days)
    peers = staged(factors.peer_sums(placed, indexed, peer_edges))
    joined = staged(factors.peer_admissions(indexed, peer_edges))
    carried = list(CARRIED)
    rows = factors.own_and_peer_rows(panel.live_panel(placed, epochs), peers, joined, epochs, market, carried)
    rows = panel.at_sessions(dec.measured(dec.with_reach(rows)), days)
    reach = {k: F.col(f"reach.{k}") for k in ("frame", "market", "market_base", "peers", "peers_edge", "peers_first")}
    rows = staged(
        rows.withColumns({"late": panel.is_late(reach), "has_market": F.col("has_market") & ~panel.without_market(reach)}).drop("reach")
    )
    result = rows.filter(~F.col("late")).drop("late", "latest_start")
    late = rows.filter("late").select("ticker", "t", "as_of", "seg", "latest_start", F.col("rn").alias("rn0"))
    if not late.isEmpty():
        late = staged(late.join(epochs.select("seg", "since", "t_lo", "t_hi"), "seg"))
        windows = panel.window_rows(late, own)
        starts = panel.peer_starts(late, indexed, peer_edges)
        again = dec.measured(factors.late_rows(late, windows, starts, peers, joined, market, carried))
        result = result.unionByName(again.filter(F.col("rn") == F.col("rn0")).drop("rn0"))
    return dec.classify(result).drop("t_lo", "t_hi", "next_di", "admitted_di", "seg", "rn", "log_ret", "c")


# fields a past date cannot know, as the constants a run without current fundamentals uses
NEUTRAL = {
    "catalyst_type": "no_news", "catalyst_severity": 5.0, "catalyst_transience": 5.0, "short_interest_pct": 0.0,
    "pe_5y_avg": 20.0, "rev_growth_pct": 0.0, "eps_growth_pct": 0.0, "moat": 3.0, "balance_sheet": 3.0,
    "overlay_sector": "", "overlay_industry": "",
}
UNKNOWN_THEN = {
    "ev_to_ebitda": 12.0, "fcf_yield_pct": 0.0, "gross_margin_pct": 0.0, "op_margin_pct": 0.0, "roic_pct": 0.0,
    "net_debt_to_ebitda": 0.0, "beta": 1.0,
}


def with_overlay(as_of_rows: DataFrame, overlay: DataFrame) -> DataFrame:
    """Complete as-of rows for full scoring: authored overlay where there is one, neutral constants elsewhere.

    Nothing added here feeds the signal score.
    """
    side = overlay.select("ticker", "name", *NEUTRAL)
    df = as_of_rows.join(side, "ticker", "left").withColumns({k: F.coalesce(k, F.lit(v)) for k, v in NEUTRAL.items()})
    return df.withColumns(
        {
            "name": F.coalesce("name", "ticker"), "pe_forward": F.col("pe_5y_avg"),
            "sector_pe": F.col("pe_5y_avg") * 0.9, **{k: F.lit(v) for k, v in UNKNOWN_THEN.items()},
        }
    )


def with_forward_closes(rows: DataFrame, bars: DataFrame, axis: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """``rows(ticker, t, ...)`` with close_h ...: the close exactly ``h`` axis sessions after ``t``, where there is one.

    Bars and rows are stacked on the axis position, and a range frame of one position reads each horizon: one exchange by
    ticker, no copy of a bar and no join.
    """
    packed = rows.select("ticker", F.col("t").alias("_at"), F.struct(*[c for c in rows.columns if c != "ticker"]).alias("_row"))
    closes = bars.join(axis, "d").select(
        "ticker", F.col("di").alias("_at"), F.lit(None).cast(packed.schema["_row"].dataType).alias("_row"), F.col("c").alias("_close")
    )
    stacked = packed.withColumn("_close", F.lit(None).cast("double")).unionByName(closes)
    w = Window.partitionBy("ticker").orderBy("_at")
    ahead = {f"close_{h}": F.max("_close").over(w.rangeBetween(h, h)) for h in horizons}
    return stacked.withColumns(ahead).filter(F.col("_row").isNotNull()).select("ticker", "_row.*", *ahead)


def observe(as_of_rows: DataFrame, bars: DataFrame, axis: DataFrame, cfg: WalkForwardConfig) -> DataFrame:
    """Score as-of rows and attach forward returns (%); rows without any measured horizon are dropped."""
    scored = as_of_rows.filter(F.col("dip_pct_week") < 0) if cfg.require_dip else as_of_rows
    joined = with_forward_closes(scoring.with_signal_pillars(scored), bars, axis, cfg.horizons)
    returns = {}
    for h in cfg.horizons:
        ok = (F.col("price") > 0) & (F.col(f"close_{h}") != 0)
        returns[f"fwd_{h}"] = F.when(ok, (ratio(F.col(f"close_{h}"), F.col("price")) - 1.0) * 100.0)
    joined = joined.withColumns(returns)
    measured = reduce(lambda a, b: a | b, [F.col(f"fwd_{h}").isNotNull() for h in cfg.horizons])
    return joined.filter(measured).drop(*[f"close_{h}" for h in cfg.horizons], "di")


def observations(bars: DataFrame, peer_edges: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    """Scored falls with forward returns, one row per (ticker, as_of)."""
    rows, axis = as_of_decompositions(bars, peer_edges, cfg)
    return observe(rows, bars, axis, cfg)


def long_observations(obs: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """One row per (observation, horizon) with a measured forward return."""
    keep = [k for k in obs.columns if not k.startswith("fwd_")]
    legs = [F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("fwd_ret")) for h in horizons]
    return obs.select(*keep, F.inline(F.array(*legs))).filter(F.col("fwd_ret").isNotNull())
