"""Hard and soft vetoes, the disclosure veto, the eligibility verdict and the network rating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbline.config import (
    EXTREME_REVENUE_MULTIPLE,
    INSOLVENCY_PATTERN,
    NETWORK_WEIGHTS,
    NO_RIGHTS_REVENUE_MULTIPLE,
    OPACITY_FLAG,
    OPACITY_VETO,
)
from ebbline.functions.scalar import clamp, half_up, ratio
from ebbline.operators.evidence import revenue_multiple

INSUFFICIENT = "insufficient_disclosure"


def _veto(cond: Column, code: str, hard: bool, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(hard).alias("hard"), reason.alias("reason")))


def vetoes(opacity: Column) -> Column:
    """Array of triggered vetoes in rule order. Undisclosed rights never count as absent ones."""
    t, r = F.col("terms"), F.col("registry")
    unwrapped = t["tax_wrapper"] == "NONE"
    overdue = (r["filing_health"] == "overdue") | r["accounts_overdue"] | r["confirmation_overdue"]
    repeat = F.filter("founders", lambda f: f["insolvency_count"] >= INSOLVENCY_PATTERN)
    multiple = revenue_multiple()
    no_rights = (
        t["share_class"].isin("ordinary_non_voting", "b_shares")
        & (t["has_preemption_rights"] == F.lit(False))
        & (t["has_information_rights"] == F.lit(False))
    )
    times = F.format_string("Priced at %.0fx trailing revenue.", multiple)
    return F.array_compact(
        F.array(
            _veto(unwrapped & (F.col("country") == "UK"), "no_advance_assurance", True,
                  "UK raise without tax-relief assurance; the bar is about twice as high."),
            _veto(unwrapped & (F.col("country") != "UK"), "unwrapped_jurisdiction", False,
                  "No relief in this jurisdiction; measured against the unwrapped bar."),
            _veto(overdue, "accounts_overdue", True, "Mandatory filings are overdue."),
            _veto(r["filing_health"] == "strike_off_proposed", "strike_off_proposed", True,
                  "The registry shows a proposal to strike the company off."),
            _veto(r["outstanding_charges"] > 0, "secured_debt_ahead", False,
                  F.format_string("%d registered charge(s) rank ahead of equity.", r["outstanding_charges"])),
            _veto(F.size(repeat) > 0, "director_insolvency_pattern", True,
                  F.format_string("%s has %d insolvent terminations.", F.get(repeat, 0)["name"],
                                  F.get(repeat, 0)["insolvency_count"])),
            _veto((multiple > EXTREME_REVENUE_MULTIPLE) & ~F.col("sector").isin("deeptech", "biotech"),
                  "extreme_valuation", True, times),
            _veto(no_rights & (multiple > NO_RIGHTS_REVENUE_MULTIPLE), "no_rights_at_high_price", True, times),
            _veto(opacity >= OPACITY_VETO, INSUFFICIENT, True,
                  F.format_string("%.0f%% of scored weight is undisclosed.", opacity * 100.0)),
        )
    )


def verdict(v: Column, opacity: Column) -> Column:
    """A known disqualifying fact outranks missing disclosure."""
    return (
        F.when(F.exists(v, lambda x: x["hard"] & (x["code"] != INSUFFICIENT)), "REJECTED")
        .when(F.exists(v, lambda x: x["code"] == INSUFFICIENT), "INSUFFICIENT_DATA")
        .when((F.size(v) > 0) | (opacity >= OPACITY_FLAG), "ELIGIBLE_WITH_FLAGS")
        .otherwise("ELIGIBLE")
    )


def network_columns() -> dict[str, Column]:
    """Rating over the observed fields only; reported beside the verdict and never part of it."""
    n, w = F.col("network"), NETWORK_WEIGHTS
    named = F.coalesce(F.size(n["named_co_investors"]), F.lit(0))
    crowd = n["investor_count"]
    credits = {
        "professional_lead": n["has_professional_lead"].cast("double"),
        "named_co_investors": F.when(named > 0, F.least(F.lit(1.0), named / 3.0)),
        "syndicate_access": n["syndicate_access"].cast("double"),
        "founder_accessible": n["founder_accessible"].cast("double"),
        "sector_adjacency": clamp(n["sector_adjacency"], 0, 1),
        "investor_scale": F.when(crowd > 2000, 0.15).when(crowd > 500, 0.45).when(crowd.isNotNull(), 0.9),
    }
    earned = sum((F.coalesce(credit * w[k], F.lit(0.0)) for k, credit in credits.items()), F.lit(0.0))
    seen = sum((F.when(credit.isNotNull(), w[k]).otherwise(0.0) for k, credit in credits.items()), F.lit(0.0))
    level = F.coalesce(ratio(earned, seen) * 100.0, F.lit(0.0))
    coverage = seen / sum(w.values())
    band = F.when(coverage < 0.3, "NONE").when(level >= 65, "HIGH").when(level >= 40, "MODERATE").otherwise("LOW")
    adjacent = clamp(n["sector_adjacency"], 0, 1) >= 0.6
    reasons = F.array_compact(
        F.array(
            F.when(n["has_professional_lead"], "led by a professional investor"),
            F.when(~n["has_professional_lead"], "no professional lead"),
            F.when(named > 0, F.concat(F.lit("co-investors: "), F.array_join(F.slice(n["named_co_investors"], 1, 4), ", "),
                                       F.when(named > 4, F.format_string(" and %d more", named - 4)).otherwise(""))),
            F.when(n["syndicate_access"], "syndicate attached"),
            F.when(n["founder_accessible"], "founders reachable"),
            F.when(adjacent, "adjacent sector"),
            F.when(crowd > 2000, F.format_string("%d investors dilute access", crowd)),
            F.when(coverage < 0.3, "too little published to rate"),
        )
    )
    return {"network_band": band, "network_score": half_up(level), "network_reasons": reasons}
