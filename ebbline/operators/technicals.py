"""Trailing-window technicals, one value per (ticker, session).

Every frame is on ``partitionBy(ticker).orderBy(d)``, so Spark plans a single exchange and a single sort for
all of them. A ticker has at most one bar per session, so a window partition is bounded by the length of the
date axis whatever the number of names. Sums over a trailing frame are differences of running sums (O(1) per
row); only the extremes and the price shelf need the frame's members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import SESSION_WINDOW
from ebbline.functions.scalar import at_least, log_return, ratio
from ebbline.session import spread


def by_ticker(*keys: str):
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("d")


def _running(x: Column, w) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _back(name: str, n: int, w) -> Column:
    return F.coalesce(F.lag(name, n).over(w), F.lit(0.0))


def with_returns(bars: DataFrame) -> DataFrame:
    """Bar number, previous close, simple and log return, gap and drift legs."""
    w = by_ticker()
    df = bars.withColumns({"rn": F.row_number().over(w), "prev_c": F.lag("c").over(w)})
    return df.withColumns(
        {
            "ret": ratio(F.col("c"), F.col("prev_c")) - 1.0,
            "log_ret": log_return(F.col("c"), F.col("prev_c")),
        }
    )


def with_moves(df: DataFrame) -> DataFrame:
    """1- and 5-session percentage moves; 0 when the history is too short or the base is 0."""
    w = by_ticker()
    return df.withColumns(
        {
            name: F.coalesce((ratio(F.col("c"), F.lag("c", n).over(w)) - 1.0) * 100.0, F.lit(0.0))
            for name, n in (("dip_pct_day", 1), ("dip_pct_week", 5))
        }
    )


def with_running_sums(df: DataFrame) -> DataFrame:
    w = by_ticker()
    chg = F.col("c") - F.col("prev_c")
    terms = {
        "s_c": F.col("c"),
        "s_up": F.greatest(F.coalesce(chg, F.lit(0.0)), F.lit(0.0)),
        "s_dn": F.greatest(-F.coalesce(chg, F.lit(0.0)), F.lit(0.0)),
        "s_r": F.coalesce("ret", F.lit(0.0)),
        "s_ra": F.abs(F.coalesce("ret", F.lit(0.0))),
        "s_rr": F.coalesce(F.col("ret") * F.col("ret"), F.lit(0.0)),
    }
    return df.withColumns({k: _running(v, w) for k, v in terms.items()})


RUNNING_SUMS = ("s_c", "s_up", "s_dn", "s_r", "s_ra", "s_rr")


def _n(limit: int, offset: int = 0) -> Column:
    """How many rows a frame of ``limit`` rows holds at bar number rn, after dropping ``offset`` leading bars."""
    return F.greatest(F.least(F.lit(limit), F.col("rn") - offset), F.lit(0))


def with_averages(df: DataFrame) -> DataFrame:
    w = by_ticker()
    return df.withColumns(
        {f"sma{p}": (F.col("s_c") - _back("s_c", p, w)) / _n(p) for p in (50, 200)}
    )


def with_rsi(df: DataFrame, period: int = 14) -> DataFrame:
    """Sum-based RSI: 50 below ``period`` changes, 100 without a falling session."""
    w = by_ticker()
    df = df.withColumns(
        {
            "_gain": F.col("s_up") - _back("s_up", period, w),
            "_loss": F.col("s_dn") - _back("s_dn", period, w),
        }
    )
    # a frame without a fall leaves the running sum unchanged, so "no loss" is an exact zero
    rsi = (
        F.when(F.col("rn") < period + 1, F.lit(50.0))
        .when(F.col("_loss") <= 0, F.lit(100.0))
        .otherwise(100.0 - 100.0 / (1.0 + ratio(F.greatest("_gain", F.lit(0.0)), F.col("_loss"))))
    )
    return df.withColumn("rsi14", rsi).drop("_gain", "_loss")


def _pop_var(s: Column, ss: Column, n: Column) -> Column:
    return at_least(ratio(ss, n) - F.pow(ratio(s, n), F.lit(2.0)), 0.0)


def with_volatility(df: DataFrame) -> DataFrame:
    """Realised volatility, range proxy, and the weekly move in pre-dip sigma units."""
    w = by_ticker()
    n30 = _n(30, 1)
    sum30 = {k: F.col(k) - _back(k, 30, w) for k in ("s_r", "s_ra", "s_rr")}
    # the 85 returns ending five sessions ago: rows -89 .. -5
    n_pre = _n(90, 1) - F.least(F.lit(5), F.greatest(F.col("rn") - 1, F.lit(0)))
    pre = {k: _back(k, 5, w) - _back(k, 90, w) for k in ("s_r", "s_rr")}
    df = df.withColumns(
        {
            "_v30": _pop_var(sum30["s_r"], sum30["s_rr"], n30),
            "_a30": ratio(sum30["s_ra"], n30),
            "_vpre": F.when(n_pre > 0, _pop_var(pre["s_r"], pre["s_rr"], n_pre)),
        }
    )
    sigma = F.sqrt(F.when(F.col("_vpre") > 1e-18, F.col("_vpre")) * 5.0) * 100.0
    return df.withColumns(
        {
            "realized_vol_pct": F.sqrt("_v30") * F.sqrt(F.lit(252.0)) * 100.0,
            "atr_pct": F.col("_a30") * 100.0 * 1.4,
            "dip_z": F.coalesce(F.abs("dip_pct_week") / sigma, F.lit(0.0)),
        }
    ).drop("_v30", "_a30", "_vpre")


def with_range(df: DataFrame, window: int = SESSION_WINDOW) -> DataFrame:
    w = by_ticker().rowsBetween(-(window - 1), 0)
    df = df.withColumns({"high_52w": F.max("c").over(w), "low_52w": F.min("c").over(w)})
    span = F.col("high_52w") - F.col("low_52w")
    return df.withColumns(
        {
            "drawdown_pct": (ratio(F.col("c"), F.col("high_52w")) - 1.0) * 100.0,
            "range_position": F.when(span == 0, F.lit(0.5)).otherwise(ratio(F.col("c") - F.col("low_52w"), span)),
        }
    )


def _mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr)


def with_levels(df: DataFrame, window: int = SESSION_WINDOW, where: Column | None = None) -> DataFrame:
    """Support shelf and resistance from the closes of the window without its last five sessions.

    Each frame holds at most 295 doubles; the arrays are reduced and dropped in the same projection. ``where``
    limits the sorting to rows whose levels are read at all; the other rows get NULL levels.
    """
    w = by_ticker().rowsBetween(-(window - 1), -5)
    df = df.withColumn("_prior", F.collect_list("c").over(w))
    if where is not None:
        df = df.withColumn("_prior", F.when(where, F.col("_prior")))
    df = df.withColumns(
        {
            "_below": F.sort_array(F.filter("_prior", lambda x: x < F.col("c") * 0.995), asc=False),
            "_above": F.filter("_prior", lambda x: x > F.col("c") * 1.02),
        }
    )
    k = F.size("_below")
    shelf = _mean(F.slice("_below", F.lit(1), F.greatest(F.lit(5), F.floor(k * 0.1).cast("int"))))
    newest = F.slice("_above", F.greatest(F.size("_above") - 119, F.lit(1)), F.lit(120))
    return df.withColumns(
        {
            "support_defined": k >= 5,
            "support_level": F.when(k >= 5, F.least(shelf, F.col("c") * 0.985)).when(k >= 0, F.col("c") * 0.9),
            "resistance_level": F.when(F.size("_above") > 0, F.array_min(newest)).when(k >= 0, F.col("high_52w")),
        }
    ).drop("_prior", "_below", "_above")


def with_volume_ratio(df: DataFrame, window: int = SESSION_WINDOW, days: int = 90) -> DataFrame:
    """Session volume over the mean of the last 90 positive volumes inside the window; 1 without any."""
    w = by_ticker()
    positive = F.coalesce(F.col("v") > 0, F.lit(False))
    df = df.withColumn("_pos", positive).withColumns(
        {
            "_sv": _running(F.when(positive, F.col("v").cast("double")).otherwise(0.0), w),
            "_nv": _running(F.when(positive, 1.0).otherwise(0.0), w),
        }
    )
    wp = Window.partitionBy("ticker", "_pos").orderBy("d")
    df = df.withColumn(
        "_s90", F.when(F.col("_pos"), F.col("_sv") - F.coalesce(F.lag("_sv", days).over(wp), F.lit(0.0)))
    )
    df = df.withColumns(
        {
            "_s90": F.last("_s90", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_n300": F.col("_nv") - _back("_nv", window, w),
            "_s300": F.col("_sv") - _back("_sv", window, w),
        }
    )
    avg = F.when(F.col("_n300") >= days, F.col("_s90") / days).otherwise(ratio(F.col("_s300"), F.col("_n300")))
    return (
        df.withColumn("avg_volume", F.coalesce(avg, F.lit(0.0)))
        .withColumn(
            "volume_ratio",
            F.when(F.col("avg_volume") > 0, F.coalesce(F.col("v"), F.lit(0)) / F.col("avg_volume")).otherwise(1.0),
        )
        .drop("_pos", "_sv", "_nv", "_s90", "_n300", "_s300")
    )


def with_gap_share(df: DataFrame, sessions: int = 5) -> DataFrame:
    """Share of the last five sessions' absolute log movement that happened between close and next open."""
    w = by_ticker()
    open_ok = F.coalesce((F.col("o") > 0) & (F.col("o") < F.lit(float("inf"))) & ~F.isnan("o"), F.lit(False))
    both = open_ok & (F.col("prev_c") > 0)
    frame = w.rowsBetween(-(sessions - 1), 0)
    gap = F.sum(F.when(both, F.abs(F.ln(ratio(F.col("o"), F.col("prev_c"))))).otherwise(0.0)).over(frame)
    drift = F.sum(F.when(both, F.abs(F.ln(ratio(F.col("c"), F.col("o"))))).otherwise(0.0)).over(frame)
    opens = F.sum(F.when(open_ok, 1).otherwise(0)).over(frame)
    df = df.withColumns({"_gap": gap, "_drift": drift, "_opens": opens})
    share = F.when(F.col("_opens") == sessions, ratio(F.col("_gap"), F.col("_gap") + F.col("_drift")))
    return df.withColumn("gap_share", share).drop("_gap", "_drift", "_opens")


def technicals(
    bars: DataFrame, moves: tuple[str, str] | None = None, levels_where: Column | None = None
) -> DataFrame:
    """All technicals of every bar in ``bars(ticker, d, o, c, v, ...)``.

    ``moves`` names columns that already hold the 1- and 5-session moves (a rounded series keeps exact ones);
    ``levels_where`` limits the price levels to the rows that need them.
    """
    df = with_returns(spread(bars, "ticker"))
    if moves:
        df = df.withColumns({"dip_pct_day": F.col(moves[0]), "dip_pct_week": F.col(moves[1])}).drop(*moves)
    else:
        df = with_moves(df)
    df = with_running_sums(df)
    for step in (with_averages, with_rsi, with_volatility):
        df = step(df)
    df = df.drop(*RUNNING_SUMS)
    return with_volume_ratio(with_gap_share(with_levels(with_range(df), where=levels_where)))


def tail(df: DataFrame, sessions: int) -> DataFrame:
    """The last N bars of each ticker with their min-max position in the tail and the tail's direction."""
    newest = Window.partitionBy("ticker").orderBy(F.col("d").desc())
    df = df.withColumn("age", F.row_number().over(newest) - 1).filter(F.col("age") < sessions)
    whole = Window.partitionBy("ticker")
    lo, hi = F.min("c").over(whole), F.max("c").over(whole)
    span = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return df.withColumns(
        {
            "y": (F.col("c") - lo) / span,
            "rising": F.max_by("c", "d").over(whole) >= F.min_by("c", "d").over(whole),
        }
    )


def chart_domain(points: DataFrame, plan: DataFrame, pad: float = 0.03) -> DataFrame:
    """Price axis of a chart: the tail's extremes, widened by the published plan levels and 3 %."""
    span = points.groupBy("ticker").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("points"))
    joined = span.join(plan.select("ticker", "published_stop", "published_target2"), "ticker", "left")
    return joined.select(
        "ticker",
        "points",
        (F.least("lo", "published_stop") * (1 - pad)).alias("y_min"),
        (F.greatest("hi", "published_target2") * (1 + pad)).alias("y_max"),
    )
