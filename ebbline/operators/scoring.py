"""Pillar scores, composites, verdict, trade plan, flags and narrative as column expressions.

Input rows carry the snapshot (price, moves, volume ratio, fundamentals), the technicals and the decomposition.
No step moves data.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.config import PILLAR_WEIGHTS, SIGNAL_PILLARS
from ebbline.functions.scalar import clamp, half_up, lookup, ratio, scale100

c = F.col


def _raw(value: Column) -> Column:
    return half_up(value)


def quality_raw() -> Column:
    return (
        scale100(c("roic_pct"), 4, 30) * 0.22
        + scale100(c("moat"), 1, 5) * 0.22
        + scale100(c("gross_margin_pct"), 20, 70) * 0.12
        + scale100(c("op_margin_pct"), 5, 35) * 0.12
        + scale100(c("rev_growth_pct"), -5, 25) * 0.12
        + scale100(-c("net_debt_to_ebitda"), -4, 1) * 0.10
        + scale100(c("balance_sheet"), 1, 5) * 0.10
    )


def _discount(norm: str) -> Column:
    return F.coalesce(ratio(c(norm) - c("pe_forward"), c(norm)) * 100.0, F.lit(0.0))


def valuation_raw() -> Column:
    growth_priced = scale100(-ratio(c("pe_forward"), c("eps_growth_pct")), -4, -0.8)
    peg = F.when(c("eps_growth_pct") > 0, growth_priced).otherwise(15.0)
    return (
        scale100(_discount("pe_5y_avg"), -25, 40) * 0.35
        + scale100(_discount("sector_pe"), -60, 40) * 0.20
        + scale100(c("fcf_yield_pct"), 0, 7) * 0.25
        + peg * 0.20
    )


def dip_character_raw() -> Column:
    speed = F.abs("dip_pct_day") / F.greatest(F.abs("dip_pct_week"), F.lit(0.1))
    return (
        scale100(c("dip_z"), 0.8, 3.5) * 0.45
        + scale100(c("volume_ratio"), 1, 3.5) * 0.35
        + scale100(speed, 0.25, 1) * 0.20
    )


def catalyst_raw() -> Column:
    size = F.abs("residual_z")
    return clamp(
        F.when(c("cause") == "MARKET_BETA", 82.0)
        .when(c("cause") == "SECTOR_ROTATION", 66.0)
        .when(c("cause") == "IDIOSYNCRATIC_NO_NEWS", 60.0 + clamp((1.5 - size) * 8.0, -10, 12))
        .when(c("cause") == "IDIOSYNCRATIC_SHOCK", 22.0 - clamp((size - 2.5) * 6.0, 0, 15))
        .otherwise(50.0),
        0,
        100,
    )


def technical_raw() -> Column:
    distance = -(c("price") - c("support_level")) / c("price") * 100.0
    shelf = F.when(c("support_defined"), scale100(distance, -12, -0.5)).otherwise(0.0)
    return scale100(-c("rsi14"), -55, -22) * 0.65 + shelf * 0.35


def flow_raw(quality: Column) -> Column:
    short = F.when(quality >= 55, scale100(c("short_interest_pct"), 1, 12)).otherwise(
        scale100(-c("short_interest_pct"), -15, -1)
    )
    return scale100(c("volume_ratio"), 0.9, 3.2) * 0.55 + short * 0.45


def composite(pillars) -> Column:
    """Weighted mean over a subset of pillars, renormalised to it."""
    return half_up(weighted_sum(pillars) / reduce(add, [PILLAR_WEIGHTS[p] for p in pillars], 0.0))


def weighted_sum(pillars) -> Column:
    # plain left-to-right addition: halves are decided by the last bit, and Python's sum() compensates it away
    return reduce(add, [c(f"{p}_score") * PILLAR_WEIGHTS[p] for p in pillars], F.lit(0.0))


def with_signal_pillars(df: DataFrame) -> DataFrame:
    """The three price-derived pillars and their composite: all a walk-forward run needs."""
    df = df.withColumns(
        {
            "catalyst_score": _raw(catalyst_raw()),
            "dip_character_score": _raw(dip_character_raw()),
            "technical_score": _raw(technical_raw()),
        }
    )
    return df.withColumn("signal_score", composite(SIGNAL_PILLARS))


def with_overlay_pillars(df: DataFrame) -> DataFrame:
    df = df.withColumns({"quality_score": _raw(quality_raw()), "valuation_score": _raw(valuation_raw())})
    df = df.withColumn("flow_score", _raw(flow_raw(c("quality_score"))))
    others = [p for p in PILLAR_WEIGHTS if p not in SIGNAL_PILLARS]
    return df.withColumns({"overlay_score": composite(others), "dip_score": half_up(weighted_sum(PILLAR_WEIGHTS))})


def verdict(signal: Column, catalyst: Column, overlay: Column) -> Column:
    floor_ok = overlay >= 45
    return (
        F.when((catalyst < 30) & (signal >= 40), "FALLING_KNIFE")
        .when(catalyst < 30, "AVOID")
        .when((signal >= 62) & (catalyst >= 60) & floor_ok, "BUY_THE_DIP")
        .when((signal >= 50) & (catalyst >= 55) & floor_ok, "ACCUMULATE")
        .when(signal >= 38, "WATCHLIST")
        .when(signal >= 25, "FALLING_KNIFE")
        .otherwise("AVOID")
    )


def with_verdict(df: DataFrame) -> DataFrame:
    scores = [c(f"{p}_score") for p in PILLAR_WEIGHTS]
    spread = F.greatest(*scores) - F.least(*scores)
    decisive = (c("signal_score") >= 62) | (c("signal_score") < 38)
    return df.withColumns(
        {
            "verdict": verdict(c("signal_score"), c("catalyst_score"), c("overlay_score")),
            "conviction": F.when((spread < 35) & decisive, "HIGH").when(spread < 55, "MODERATE").otherwise("LOW"),
            "is_dip": c("dip_pct_week") < 0,
        }
    )


def with_plan(df: DataFrame) -> DataFrame:
    p, support, defined = c("price"), c("support_level"), c("support_defined")
    atr_stop = p * (1.0 - c("atr_pct") * 2.2 / 100.0)
    before = ratio(p, 1.0 + c("dip_pct_week") / 100.0)
    df = df.withColumns(
        {
            "entry_low": F.when(defined, F.least(p * 0.985, support * 1.01)).otherwise(p * 0.985),
            "entry_high": p * 1.008,
            "stop": F.when(defined, F.least(support * 0.97, atr_stop)).otherwise(atr_stop),
            "target1": p + (before - p) * 0.5,
        }
    )
    risk = p - c("stop")
    win = clamp(c("signal_score") * 0.55 + 28.0, 15, 82)
    base = lookup("verdict", {"BUY_THE_DIP": 5.0, "ACCUMULATE": 3.0, "WATCHLIST": 1.0}, 0.0)
    calm = clamp(30.0 / F.greatest(c("realized_vol_pct"), F.lit(15.0)), 0.5, 1.2)
    to_target = (ratio(c("target1"), p) - 1.0) * 100.0
    to_stop = (ratio(c("stop"), p) - 1.0) * 100.0
    guidance = c("catalyst_type").isin("earnings_miss", "guidance_cut")
    reverting = c("catalyst_type").isin("sector_sympathy", "macro", "no_news")
    return df.withColumns(
        {
            "target2": F.greatest(before * 0.99, c("target1")),
            "risk_reward": half_up(F.when(risk > 0, ratio(c("target1") - p, risk)).otherwise(0.0), 2),
            "win_probability_pct": half_up(win),
            "expected_value_pct": half_up(win / 100.0 * to_target + (1.0 - win / 100.0) * to_stop, 1),
            "suggested_size_pct": half_up(base * calm, 1),
            "max_risk_pct": F.lit(1.0),
            "horizon": F.when(guidance, "4–8 weeks").when(reverting, "2–5 weeks").otherwise("6–12 weeks"),
        }
    )


def published(level: str) -> Column:
    """A plan level, or NULL where the desk publishes none (no dip, or a verdict that must not be bought)."""
    return F.when(c("is_dip") & ~c("verdict").isin("FALLING_KNIFE", "AVOID"), c(level))


def risk_flags() -> Column:
    """Triggered rules in rule order; ``none`` stands alone when nothing triggers."""
    rules = {
        "leverage": c("net_debt_to_ebitda") > 2.5,
        "earnings_impairment": c("catalyst_severity") >= 6,
        "below_200_session_mean": c("price") < c("sma200"),
        "no_support": ~c("support_defined"),
        "high_volatility": c("realized_vol_pct") > 45,
        "shorts_on_weak_business": (c("short_interest_pct") > 10) & (c("quality_score") < 50),
        "sector_premium": c("pe_forward") > c("sector_pe") * 1.4,
        "deep_drawdown": F.abs("drawdown_pct") > 40,
    }
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("none")))


def highlights() -> dict[str, Column]:
    """Cells a screen marks."""
    return {
        "oversold": c("rsi14") < 30,
        "volume_climax": c("volume_ratio") >= 2.5,
        "large_dip": c("dip_z") >= 2,
        "cash_generative": c("fcf_yield_pct") >= 4,
        "high_return": c("roic_pct") >= 15,
        "levered": c("net_debt_to_ebitda") > 2.5,
        "moat": c("moat") >= 4,
        "below_own_pe": c("pe_forward") < c("pe_5y_avg"),
        "good_risk_reward": c("risk_reward") >= 1.5,
        "residual_extreme": c("residual_z") <= -2,
    }


def distances() -> dict[str, Column]:
    p = c("price")
    return {
        "vs_sma50_pct": (ratio(p, c("sma50")) - 1.0) * 100.0,
        "vs_sma200_pct": (ratio(p, c("sma200")) - 1.0) * 100.0,
        "stop_from_last_pct": ratio(c("stop") - p, p) * 100.0,
        "target1_from_last_pct": ratio(c("target1") - p, p) * 100.0,
    }


def pillar_notes() -> dict[str, Column]:
    """Short reason per pillar, chosen by the unrounded score's band."""

    def banded(raw: Column, hi: float, mid: float, texts) -> Column:
        return F.when(raw >= hi, texts[0]).when(raw >= mid, texts[1]).otherwise(texts[2])

    fmt = F.format_string
    return {
        "quality_note": banded(
            quality_raw(), 70, 45,
            (
                fmt("Strong economics: %.0f%% return on capital, %.0f%% gross margin.", "roic_pct", "gross_margin_pct"),
                fmt("Sound economics: %.0f%% return on capital, %.0f%% operating margin.", "roic_pct", "op_margin_pct"),
                fmt("Thin economics: %.0f%% return on capital, %.1fx net debt.", "roic_pct", "net_debt_to_ebitda"),
            ),
        ),
        "valuation_note": banded(
            valuation_raw(), 65, 40,
            (
                fmt("Cheap: %.0fx earnings against a norm of %.0fx.", "pe_forward", "pe_5y_avg"),
                fmt("Fair: %.0fx earnings against a norm of %.0fx.", "pe_forward", "pe_5y_avg"),
                fmt("Dear: %.0fx earnings, %.1f%% cash yield.", "pe_forward", "fcf_yield_pct"),
            ),
        ),
        "dip_character_note": banded(
            dip_character_raw(), 65, 40,
            (
                fmt("Flush: %.1f sigma on %.1fx volume.", "dip_z", "volume_ratio"),
                fmt("Orderly: %.1f sigma on %.1fx volume.", "dip_z", "volume_ratio"),
                fmt("Slow bleed: %.0f%% below the high.", F.abs("drawdown_pct")),
            ),
        ),
        "technical_note": F.when(~c("support_defined"), fmt("RSI %.0f, no shelf beneath the price.", "rsi14")).otherwise(
            banded(
                technical_raw(), 65, 40,
                (
                    fmt("Oversold at RSI %.0f near a shelf at %.2f.", "rsi14", "support_level"),
                    fmt("Stretched at RSI %.0f, shelf at %.2f.", "rsi14", "support_level"),
                    fmt("Not stretched at RSI %.0f, shelf at %.2f.", "rsi14", "support_level"),
                ),
            )
        ),
        "flow_note": banded(
            flow_raw(c("quality_score")), 60, 40,
            (
                fmt("%.1f%% short interest can fuel a squeeze at %.1fx volume.", "short_interest_pct", "volume_ratio"),
                fmt("Positioning is ordinary: %.1f%% short, %.1fx volume.", "short_interest_pct", "volume_ratio"),
                fmt("Shorts are crowded (%.1f%%) without a volume climax.", "short_interest_pct"),
            ),
        ),
    }


def thesis() -> Column:
    """One paragraph per verdict; a name that is up on the week gets no dip narrative."""
    fmt = F.format_string
    off_today = F.when(c("dip_pct_day") < 0, fmt("off %.1f%% today but ", F.abs("dip_pct_day"))).otherwise("")
    no_dip = F.concat(
        "ticker", F.lit(" is "), off_today, fmt("up %.1f%% on the week: no dip to underwrite.", "dip_pct_week")
    )
    move = F.concat(
        "ticker",
        fmt(" is off %.1f%% on the week (%.1f%% today) on ", F.abs("dip_pct_week"), F.abs("dip_pct_day")),
        F.coalesce(F.replace("catalyst_type", F.lit("_"), F.lit(" ")), F.lit("unknown cause")),
    )
    endings = {
        "BUY_THE_DIP": fmt(": a %.1f sigma dislocation with the earnings case intact.", "dip_z"),
        "ACCUMULATE": F.lit(". Build the position in steps across the entry zone."),
        "WATCHLIST": F.lit(". No clear bargain yet; wait for confirmation."),
        "FALLING_KNIFE": F.lit(". Selling looks like repricing; stand aside until it settles."),
        "AVOID": F.lit(". The problem is the business rather than the tape."),
    }
    tail = None
    for v, text in endings.items():
        tail = F.when(c("verdict") == v, text) if tail is None else tail.when(c("verdict") == v, text)
    return F.when(c("dip_pct_week") >= 0, no_dip).otherwise(F.concat(move, tail))


def pillar_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per pillar, with its weight and where its inputs come from."""
    source = {"quality": "mixed", "valuation": "mixed", "flow": "mixed"}
    structs = [
        F.struct(
            F.lit(p).alias("pillar"), c(f"{p}_score").alias("score"), F.lit(w).alias("weight"),
            F.lit(source.get(p, "signal")).alias("provenance"),
        )
        for p, w in PILLAR_WEIGHTS.items()
    ]
    return df.select(*keys, F.inline(F.array(*structs)))


def analyze(df: DataFrame) -> DataFrame:
    """Full scoring of snapshot rows that already carry technicals and decomposition."""
    for step in (with_signal_pillars, with_overlay_pillars, with_verdict, with_plan):
        df = step(df)
    return df
