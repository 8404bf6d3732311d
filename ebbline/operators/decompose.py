"""Split a five-session fall into market, sector and name-specific parts by rolling regression.

All moments are differences of running sums over ``partitionBy(ticker, seg).orderBy(d)``: the cost per row does
not depend on the frame length, and one sort serves every frame. A segment restarts the sums, which keeps them
short enough that the differences lose no relevant digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import (
    DIP_SESSIONS,
    ESTIMATION_SESSIONS,
    GAP_DOMINANT,
    GAP_SHOCK_Z,
    MIN_ESTIMATION_RETURNS,
    SESSION_WINDOW,
    SHOCK_Z,
    SYSTEMATIC_DOMINANT,
)
from ebbline.functions.scalar import at_least, at_most, log_to_pct, ratio, signed_pct

NO_VARIANCE = 1e-18
COLLINEAR = 1e-14


def in_segment():
    return Window.partitionBy("ticker", "seg").orderBy("d")


def up_to_here():
    return in_segment().rowsBetween(Window.unboundedPreceding, 0)


def _frame(name: str, newest: int, oldest: int) -> Column:
    """Sum of a term over the rows -oldest+1 .. -newest, from its running sum ``name``."""
    recent = F.lag(name, newest).over(in_segment()) if newest else F.col(name)
    return F.coalesce(recent, F.lit(0.0)) - F.coalesce(F.lag(name, oldest).over(in_segment()), F.lit(0.0))


def with_reach(rows: DataFrame) -> DataFrame:
    """How far back the levels in a row's frame go: the factor sessions behind its own level and that at the frame's edge.

    A struct ``reach`` of axis positions; ``frame`` is the edge itself, NULL where the history is shorter than a frame.
    """
    w, whole = in_segment(), Window.partitionBy("ticker", "seg")
    df = rows.withColumn("_peers", F.last(F.when(F.col("peer_level").isNotNull(), F.col("di")), ignorenulls=True).over(up_to_here()))
    back = DIP_SESSIONS + ESTIMATION_SESSIONS
    return df.withColumn(
        "reach",
        F.struct(
            F.lag("di", back).over(w).alias("frame"), F.col("market_di").alias("market"),
            F.coalesce(F.lag("market_di", back).over(w), F.min("market_di").over(whole)).alias("market_base"),
            F.col("_peers").alias("peers"), F.lag("_peers", back).over(w).alias("peers_edge"), F.min("_peers").over(whole).alias("peers_first"),
        ),
    ).drop("_peers")


def factor_returns(rows: DataFrame) -> DataFrame:
    """Differences of the levels on the name's own sessions, the peers' carried forward; 0 before the first level."""
    df = rows.withColumn("peer_level", F.last("peer_level", ignorenulls=True).over(up_to_here()))
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "r_t": F.coalesce(F.col("log_ret"), zero),
            "r_m": F.coalesce(F.col("market_level") - F.lag("market_level").over(in_segment()), zero),
            "r_p": F.coalesce(F.col("peer_level") - F.lag("peer_level").over(in_segment()), zero),
        }
    ).drop("market_level", "market_di", "peer_level")


def _products(prefix: str, t: Column, m: Column, p: Column) -> dict[str, Column]:
    return {
        f"{prefix}t": t, f"{prefix}m": m, f"{prefix}p": p,
        f"{prefix}tt": t * t, f"{prefix}mm": m * m, f"{prefix}pp": p * p,
        f"{prefix}tm": t * m, f"{prefix}tp": t * p, f"{prefix}mp": m * p,
    }


def _cov(df_prefix: str, a: str, b: str, n: Column) -> Column:
    pair = "".join(sorted((a, b), key="tmp".index))
    s = F.col(f"{df_prefix}{pair}") / n - F.col(f"{df_prefix}{a}") / n * F.col(f"{df_prefix}{b}") / n
    return at_least(s, 0.0) if a == b else s


def moments(df: DataFrame) -> DataFrame:
    """Sums over the estimation frame (e_), the trailing 120 returns (h_) and the rolling 5-sums (k_)."""
    est, dip = ESTIMATION_SESSIONS, DIP_SESSIONS
    last5 = in_segment().rowsBetween(-(dip - 1), 0)
    df = df.withColumns({f"s5_{x}": F.sum(f"r_{x}").over(last5) for x in "tmp"})
    valid = F.when(F.col("rn") >= dip + 1, F.lit(1.0)).otherwise(0.0)
    terms = _products("e_", F.col("r_t"), F.col("r_m"), F.col("r_p"))
    terms |= _products("k_", *(F.col(f"s5_{x}") * valid for x in "tmp"))
    df = df.withColumns({k: F.sum(v).over(up_to_here()) for k, v in terms.items()})
    frames = {f"h_{x}": _frame(f"e_{x}", 0, est) for x in ("m", "p", "mm", "pp")}
    frames |= {f"e_{x}": _frame(f"e_{x}", dip, dip + est) for x in ("t", "m", "p", "mm", "pp", "tm", "tp", "mp")}
    # a 5-sum that ends at row -120 is the oldest one lying inside the estimation frame
    frames |= {f"k_{x}": _frame(f"k_{x}", dip, est + 1) for x in ("t", "m", "p", "tt", "mm", "pp", "tm", "tp", "mp")}
    return df.withColumns(frames)


def resolve(df: DataFrame) -> DataFrame:
    """Betas, attribution, residual z and guards for every row (meaningful on as-of rows)."""
    n_ret = F.least(F.col("rn"), F.lit(SESSION_WINDOW)) - 1
    n_est = F.least(F.lit(ESTIMATION_SESSIONS), n_ret - DIP_SESSIONS)
    n_hist = F.least(F.lit(ESTIMATION_SESSIONS), n_ret)
    df = df.withColumns({"n_est": n_est, "_ne": F.nullif(n_est.cast("double"), F.lit(0.0))})
    ne, nh = F.col("_ne"), F.nullif(n_hist.cast("double"), F.lit(0.0))
    nk = F.nullif(F.greatest(n_est - (DIP_SESSIONS - 1), F.lit(0)).cast("double"), F.lit(0.0))
    df = df.withColumns(
        {
            "has_market": F.coalesce(_cov("h_", "m", "m", nh) > NO_VARIANCE, F.lit(False)),
            "has_peers": F.coalesce(_cov("h_", "p", "p", nh) > NO_VARIANCE, F.lit(False)),
            **{f"c_{a}{b}": _cov("e_", a, b, ne) for a, b in ("tm", "tp", "mp", "mm", "pp")},
            **{f"q_{a}{b}": _cov("k_", a, b, nk) for a, b in ("tt", "tm", "tp", "mp", "mm", "pp")},
        }
    )
    moving = F.col("c_mm") > NO_VARIANCE
    df = df.withColumns(
        {
            "beta_market": F.coalesce(F.when(moving, ratio(F.col("c_tm"), F.col("c_mm"))), F.lit(0.0)),
            "_b": F.coalesce(F.when(moving, ratio(F.col("c_mp"), F.col("c_mm"))), F.lit(0.0)),
        }
    )
    b = F.col("_b")
    v_excess = F.col("c_pp") - 2.0 * b * F.col("c_mp") + b * b * F.col("c_mm")
    c_excess = F.col("c_tp") - b * F.col("c_tm")
    real = F.col("has_peers") & (v_excess > COLLINEAR * F.col("c_pp")) & (v_excess > NO_VARIANCE)
    df = df.withColumn("beta_sector", F.coalesce(F.when(real, ratio(c_excess, v_excess)), F.lit(0.0)))
    s = F.col("beta_sector")
    a = F.col("beta_market") - s * b
    var_resid = (
        F.col("q_tt") + a * a * F.col("q_mm") + s * s * F.col("q_pp")
        - 2.0 * a * F.col("q_tm") - 2.0 * s * F.col("q_tp") + 2.0 * a * s * F.col("q_mp")
    )
    df = df.withColumns(
        {
            "total_log": F.col("s5_t"),
            "market_log": F.col("beta_market") * F.col("s5_m"),
            "sector_log": s * (F.col("s5_p") - b * F.col("s5_m")),
            "_vr": var_resid,
        }
    )
    df = df.withColumn("idio_log", F.col("total_log") - F.col("market_log") - F.col("sector_log"))
    df = df.withColumn(
        "residual_z", F.coalesce(F.when(F.col("_vr") > NO_VARIANCE, F.col("idio_log") / F.sqrt("_vr")), F.lit(0.0))
    )
    total = F.abs("total_log")
    df = df.withColumn(
        "systematic_share",
        F.coalesce(at_most(ratio(F.abs(F.col("market_log") + F.col("sector_log")), total), 1.0), F.lit(0.0)),
    )
    keep_drop = [c for c in df.columns if c[:2] in ("e_", "k_", "h_", "c_", "q_", "r_") or c in ("_b", "_vr", "_ne")]
    return df.drop(*keep_drop, "s5_t", "s5_m", "s5_p")


def cause(total: Column, market: Column, sector: Column, z: Column, gap_share: Column) -> Column:
    """Cause of the move. The share test is sign-blind: an offsetting market move counts as systematic too."""
    size = F.abs(total)
    systematic = ratio(F.abs(market + sector), size) >= SYSTEMATIC_DOMINANT
    by_gap = F.coalesce((gap_share >= GAP_DOMINANT) & (z <= GAP_SHOCK_Z), F.lit(False))
    return (
        F.when(size <= 0, "UNKNOWN")
        .when(systematic & (F.abs(market) >= F.abs(sector)), "MARKET_BETA")
        .when(systematic, "SECTOR_ROTATION")
        .when((z <= SHOCK_Z) | by_gap, "IDIOSYNCRATIC_SHOCK")
        .otherwise("IDIOSYNCRATIC_NO_NEWS")
    )


def classify(df: DataFrame) -> DataFrame:
    """Publish the decomposition, with the not-enough-history and no-market cases blanked."""
    short = (F.col("n_est") + DIP_SESSIONS + 1 < 35) | (F.col("has_market") & (F.col("n_est") < MIN_ESTIMATION_RETURNS))
    blank = short | ~F.col("has_market")
    known = cause(*(F.col(f"{p}_log") for p in ("total", "market", "sector")), F.col("residual_z"), F.col("gap_share"))
    est = F.col("n_est")
    high = (est >= 90) & F.col("has_peers") & F.col("gap_share").isNotNull()
    return df.withColumns(
        {
            "cause": F.when(blank, "UNKNOWN").otherwise(known),
            "total_pct": F.when(short, 0.0).otherwise(log_to_pct(F.col("total_log"))),
            **{
                f"{p}_pct": F.when(blank, 0.0).otherwise(log_to_pct(F.col(f"{p}_log")))
                for p in ("market", "sector", "idio")
            },
            "systematic_share": F.when(blank, 0.0).otherwise(F.col("systematic_share")),
            "beta_market": F.when(blank, 1.0).otherwise(F.col("beta_market")),
            "beta_sector": F.when(blank, 0.0).otherwise(F.col("beta_sector")),
            "residual_z": F.when(blank, 0.0).otherwise(F.col("residual_z")),
            "gap_share": F.when(~blank, F.col("gap_share")),
            "confidence": F.when(blank, "LOW").when(high, "HIGH").when(est >= 60, "MODERATE").otherwise("LOW"),
        }
    ).drop("total_log", "market_log", "sector_log", "idio_log", "has_market", "has_peers", "n_est")


def cause_label(c: str = "cause") -> Column:
    """The code in words."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def share_of_total(part: str, total: str = "total_pct") -> Column:
    """Length of a part's bar relative to the whole move, 0..100."""
    return F.coalesce(at_most(F.abs(ratio(F.col(part), F.col(total))) * 100.0, 100.0), F.lit(0.0))


def cause_note() -> Column:
    """One sentence per cause, with the measured parts."""
    total, market, sector, idio = (signed_pct(F.col(f"{p}_pct")) for p in ("total", "market", "sector", "idio"))
    z = F.format_string("%.1f", F.col("residual_z"))
    gap = (
        F.when(F.col("gap_share").isNull(), "")
        .when(F.col("gap_share") >= GAP_DOMINANT, " Most of it came between sessions, as news does.")
        .otherwise(" Most of it came during sessions, as order flow does.")
    )
    return (
        F.when(
            F.col("cause") == "MARKET_BETA",
            F.concat(market, F.lit(" of "), total, F.lit(" follows from market exposure; "), idio, F.lit(" is specific to the name.")),
        )
        .when(
            F.col("cause") == "SECTOR_ROTATION",
            F.concat(sector, F.lit(" of "), total, F.lit(" is the peer group moving beyond what the market explains.")),
        )
        .when(
            F.col("cause") == "IDIOSYNCRATIC_SHOCK",
            F.concat(idio, F.lit(" of "), total, F.lit(" is specific to the name, a residual of "), z, F.lit(" sigma."), gap,
                     F.lit(" The pattern points to new information.")),
        )
        .when(
            F.col("cause") == "IDIOSYNCRATIC_NO_NEWS",
            F.concat(idio, F.lit(" of "), total, F.lit(" is specific to the name but ordinary at "), z, F.lit(" sigma."), gap),
        )
        .otherwise("History is too short to separate market, sector and name-specific parts.")
    )


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` from ``own_and_peer_rows``: ticker, seg, d, di, rn, log_ret, gap_share, levels and carried columns."""
    return resolve(moments(factor_returns(rows)))
