"""Tax relief, platform fees, net multiples and hurdles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbline.config import MIN_HOLD_YEARS, PLATFORM_FEES, RELIEF_RATE, HurdleTerms, TaxProfile
from ebbline.functions.scalar import lit_or_col, lookup, ratio


def relief(wrapper: Column, liability) -> Column:
    """Up-front relief rate; worthless without tax to set it against."""
    return F.when(lit_or_col(liability), lookup(wrapper, RELIEF_RATE, 0.0)).otherwise(0.0)


def net_cost_fraction(wrapper: Column, liability) -> Column:
    return 1.0 - relief(wrapper, liability)


def investment_fee(platform: Column) -> Column:
    return lookup(F.lower(platform), {k: v[0] for k, v in PLATFORM_FEES.items()}, 0.0)


def carry(platform: Column) -> Column:
    return lookup(F.lower(platform), {k: v[1] for k, v in PLATFORM_FEES.items()}, 0.0)


def net_multiple(gross: Column, wrapper: Column, fee: Column, carry_pct: Column, tax: TaxProfile, liability=None) -> Column:
    """Multiple on money at risk: carry on profit, loss relief on a shortfall inside a wrapper."""
    liability = tax.sufficient_liability if liability is None else liability
    cost = 1.0 + fee - relief(wrapper, liability)
    proceeds = gross - F.greatest(gross - 1.0, F.lit(0.0)) * carry_pct
    recovered = F.when(wrapper != "NONE", (cost - proceeds) * tax.marginal_rate).otherwise(0.0)
    value = (
        F.when(cost <= 0, F.lit(float("inf")))
        .when(proceeds >= cost, ratio(proceeds, cost))
        .otherwise(ratio(proceeds + recovered, cost))
    )
    return F.when(gross < 0, F.raise_error(F.lit("gross multiple must not be negative")).cast("double")).otherwise(value)


def index_multiple(years, annual_return) -> Column:
    return F.pow(1.0 + lit_or_col(annual_return), lit_or_col(years))


def hurdle_multiple(years, wrapper: Column, fee: Column, carry_pct: Column, liability, annual_return, premium=0.0) -> Column:
    """Gross multiple at which the position equals the index, with the carry deduction inverted."""
    required = (1.0 + fee - relief(wrapper, liability)) * index_multiple(
        years, lit_or_col(annual_return) + lit_or_col(premium)
    )
    return ratio(required - carry_pct, 1.0 - carry_pct)


def hurdle_columns(wrapper: Column, platform: Column, terms: HurdleTerms, years=None, liability=None, premium=None) -> dict[str, Column]:
    """The hurdle report of a deal or scenario row."""
    years = lit_or_col(terms.years if years is None else years)
    liability = lit_or_col(terms.tax.sufficient_liability if liability is None else liability)
    premium = lit_or_col(terms.illiquidity_premium if premium is None else premium)
    fee, cut = investment_fee(platform), carry(platform)
    notes = F.array_compact(
        F.array(
            F.when((wrapper != "NONE") & (years < lookup(wrapper, MIN_HOLD_YEARS, 0)), F.lit("below_minimum_hold")),
            F.when((wrapper != "NONE") & ~liability, F.lit("no_liability_for_relief")),
            F.when(wrapper == "NONE", F.lit("no_relief")),
        )
    )
    return {
        "index_multiple": index_multiple(years, terms.index_return),
        "hurdle_multiple": hurdle_multiple(years, wrapper, fee, cut, liability, terms.index_return, premium),
        "breakeven_multiple": hurdle_multiple(0.0, wrapper, fee, cut, liability, terms.index_return),
        "net_cost_fraction": net_cost_fraction(wrapper, liability),
        "downside_multiple": net_multiple(F.lit(0.0), wrapper, fee, cut, terms.tax, liability),
        "hurdle_notes": notes,
    }


def edge_vs_index(expected_net: Column, years, annual_return, premium=0.0) -> Column:
    return ratio(expected_net, index_multiple(years, lit_or_col(annual_return) + lit_or_col(premium)))
