"""Outcome distributions in long form ``(dist_id, multiple, p)`` and odds of recorded portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import POSITION_GRID, TAIL_GRID, TAIL_MULTIPLE, HurdleTerms, TaxProfile
from ebbline.functions.raises import edge_vs_index, index_multiple, net_multiple
from ebbline.functions.scalar import clamp, ratio
from ebbline.operators.ranking import floor_quantiles


def expectations(outcomes: DataFrame, by: list[str], thresholds=(0.0, 1.0), net: Column | None = None) -> DataFrame:
    """Expected gross (and net) multiple and the probability of ending at or below each threshold."""
    aggs = [F.sum(F.col("multiple") * F.col("p")).alias("expected_gross")]
    if net is not None:
        aggs.append(F.sum(F.col("p") * net).alias("expected_net"))
    for t in thresholds:
        aggs.append(F.sum(F.when(F.col("multiple") <= t, F.col("p")).otherwise(0.0)).alias(f"p_at_or_below_{t:g}".replace(".", "_")))
    return outcomes.groupBy(*by).agg(*aggs)


def net_of(wrapper: str, tax: TaxProfile, fee: float = 0.0, carry: float = 0.0) -> Column:
    return net_multiple(F.col("multiple"), F.lit(wrapper), F.lit(fee), F.lit(carry), tax)


def retail(outcomes: DataFrame, tail_p: Column, by: list[str]) -> DataFrame:
    """Give the largest bucket probability ``tail_p``, the difference to the smallest one, and renormalise."""
    w = Window.partitionBy(*by)
    df = outcomes.withColumns({"_lo": F.min("multiple").over(w), "_hi": F.max("multiple").over(w), "_tp": tail_p})
    df = df.withColumn("_delta", F.sum(F.when(F.col("multiple") == F.col("_hi"), F.col("p") - F.col("_tp"))).over(w))
    moved = (
        F.when(F.col("multiple") == F.col("_hi"), F.col("_tp"))
        .when(F.col("multiple") == F.col("_lo"), F.greatest(F.lit(0.0), F.col("p") + F.col("_delta")))
        .otherwise(F.col("p"))
    )
    df = df.withColumn("p", moved)
    return df.withColumn("p", F.coalesce(ratio(F.col("p"), F.sum("p").over(w)), F.col("p"))).drop("_lo", "_hi", "_tp", "_delta")


def tilt(outcomes: DataFrame, score: Column, strength, sector_tilt=0.0, by: list[str] | None = None) -> DataFrame:
    """Exponential tilt toward the tail with the evidence score; strength 0 leaves the distribution unchanged."""
    w = Window.partitionBy(*(by or ["dist_id"]))
    z = clamp((score - 50.0) / 50.0 + sector_tilt, -1, 1)
    df = outcomes.withColumn("_w", F.col("p") * F.exp(z * strength * F.ln(F.col("multiple") + 1.0)))
    total = F.sum("_w").over(w)
    return df.withColumn("p", F.when(total > 0, F.col("_w") / total).otherwise(F.col("p"))).drop("_w")


def tail_sensitivity(outcomes: DataFrame, terms: HurdleTerms, wrapper: str = "SEIS", grid=TAIL_GRID,
                     required_edge: float = 1.25) -> DataFrame:
    """Expected multiples and edge over a grid of tail probabilities, per distribution."""
    rows = outcomes.withColumn("tail_p", F.explode(F.array(*[F.lit(float(p)) for p in grid])))
    moved = retail(rows, F.col("tail_p"), ["dist_id", "tail_p"])
    out = expectations(moved, ["dist_id", "tail_p"], (), net_of(wrapper, terms.tax))
    edge = edge_vs_index(F.col("expected_net"), terms.years, terms.index_return, terms.illiquidity_premium)
    out = out.withColumn("edge", edge)
    label = F.when(F.col("edge") >= required_edge, "worth doing").when(F.col("edge") >= 1, "beats index").otherwise("loses to index")
    return out.withColumn("label", label)


def flip_points(sensitivity: DataFrame, required_edge: float = 1.25) -> DataFrame:
    """Walking down from the fattest tail: first probability that fails the bar, and the last that passes."""
    ok = F.col("edge") >= required_edge
    return sensitivity.groupBy("dist_id").agg(
        F.max(F.when(~ok, F.col("tail_p"))).alias("flip_at"), F.min(F.when(ok, F.col("tail_p"))).alias("last_passing")
    )


def portfolios(positions: DataFrame, net: Column, grid=POSITION_GRID) -> DataFrame:
    """Net multiple and tail of each investor's first n positions, per (dist_id, investor, n) with n up to their number.

    ``positions(dist_id, investor, taken, seq, multiple)`` are recorded outcomes in order of (taken, seq). Only the first 100
    (the largest n) of an investor count, and tasks cut to those before the exchange, so an investor with a large part
    of all positions fills no partition.
    """
    order = Window.partitionBy("dist_id", "investor").orderBy("taken", "seq")
    first = positions.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= max(grid)).withColumn("net", net)
    aggs = [F.max("k").alias("held")]
    for n in grid:
        inside = F.col("k") <= n
        aggs += [
            (F.sum(F.when(inside, F.col("net")).otherwise(0.0)) / n).alias(f"m_{n}"),
            F.max(F.when(inside, F.col("multiple") >= TAIL_MULTIPLE).otherwise(False)).alias(f"t_{n}"),
        ]
    wide = first.groupBy("dist_id", "investor").agg(*aggs)
    cells = [F.struct(F.lit(n).alias("positions"), F.col(f"m_{n}").alias("multiple"), F.col(f"t_{n}").alias("any_tail")) for n in grid]
    return wide.select("dist_id", "investor", "held", F.inline(F.array(*cells))).filter("positions <= held").drop("held")


def odds(portfolio_rows: DataFrame, terms: HurdleTerms) -> DataFrame:
    """Median, mean, deciles and probabilities per (dist_id, positions)."""
    by = ["dist_id", "positions"]
    hurdle = index_multiple(terms.years, terms.index_return)
    flag = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    summary = portfolio_rows.groupBy(*by).agg(
        F.count("*").alias("investors"),
        F.avg("multiple").alias("mean_multiple"),
        flag(F.col("multiple") >= hurdle).alias("p_beat_index"),
        flag(F.col("multiple") < 1.0).alias("p_below_capital"),
        flag(F.col("any_tail")).alias("p_any_tail"),
    )
    points = floor_quantiles(portfolio_rows, by, "multiple", {"p10_multiple": 0.1, "median_multiple": 0.5, "p90_multiple": 0.9})
    return summary.join(points, by).withColumn("index_multiple", hurdle)


def any_tail_probability(outcomes: DataFrame, grid=POSITION_GRID) -> DataFrame:
    """Closed form of holding at least one tail outcome: 1 - (1 - p)^n."""
    p = F.sum(F.when(F.col("multiple") >= TAIL_MULTIPLE, F.col("p")).otherwise(0.0)) / F.sum("p")
    rows = outcomes.groupBy("dist_id").agg(p.alias("p_tail"))
    rows = rows.withColumn("positions", F.explode(F.array(*[F.lit(n) for n in grid])))
    return rows.withColumn("p_any_tail", 1.0 - F.pow(1.0 - F.col("p_tail"), F.col("positions").cast("double")))


def deployment(curve: DataFrame, budget: Column, ticket: Column, relief_rate: Column) -> DataFrame:
    """Positions a budget buys, money at risk, and the sizes at which odds turn, per distribution."""
    turns = curve.groupBy("dist_id").agg(
        F.min(F.when(F.col("p_beat_index") >= 0.5, F.col("positions"))).alias("positions_for_even_odds"),
        F.min(F.when(F.col("p_below_capital") <= 0.25, F.col("positions"))).alias("positions_for_downside_control"),
    )
    affordable = F.when(ticket > 0, F.floor(budget / ticket)).otherwise(F.lit(0)).cast("int")
    df = turns.withColumns({"positions": affordable, "capital_at_risk": budget * (1.0 - relief_rate)})
    notes = F.array_compact(
        F.array(
            F.when(F.col("positions") == 0, "ticket_exceeds_budget"),
            F.when((F.col("positions") > 0) & (F.col("positions") < F.col("positions_for_even_odds")), "below_even_odds"),
            F.when(F.col("positions") == 1, "single_position"),
            F.when(relief_rate > 0, "relief_redeployable"),
        )
    )
    return df.withColumn("notes", notes)
