"""What the observations say: does the score rank forward returns, by horizon, cause, regime, feature and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import BUY_GRADE_SCORE
from ebbline.operators.factors import chain_index
from ebbline.operators.ranking import rank_correlation, stable_positions
from ebbline.staging import broadcast_if_small, staged

MIN_ROWS = 5


def _mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def horizon_metrics(long_obs: DataFrame, by: list[str] | None = None, high_score: int = 50) -> DataFrame:
    """n, rank IC, quintile means and spread, hit rate of high scores - per horizon (and further keys)."""
    by = by or ["horizon"]
    ic = rank_correlation(long_obs, by, "signal_score", "fwd_ret")
    placed = stable_positions(long_obs, by, "signal_score", "as_of", "ticker")
    q = F.greatest(F.lit(1), F.floor(F.col("pos_total") / 5))
    high = F.col("signal_score") >= high_score
    parts = placed.groupBy(*by).agg(
        _mean_or_zero(F.when(F.col("pos") > F.col("pos_total") - q, F.col("fwd_ret"))).alias("top_mean"),
        _mean_or_zero(F.when(F.col("pos") <= q, F.col("fwd_ret"))).alias("bottom_mean"),
        _mean_or_zero(F.when(high, (F.col("fwd_ret") > 0).cast("double"))).alias("hit_rate_high"),
    )
    enough = F.col("n") >= MIN_ROWS
    cell = lambda c: F.when(enough, c).otherwise(0.0)
    return ic.join(parts, by).select(
        *by, "n", cell(F.col("ic")).alias("ic"), cell(F.col("top_mean")).alias("top_mean"),
        cell(F.col("bottom_mean")).alias("bottom_mean"),
        cell(F.col("top_mean") - F.col("bottom_mean")).alias("spread"),
        cell(F.col("hit_rate_high")).alias("hit_rate_high"),
    )


def means_by(obs: DataFrame, keys: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """Row count (all rows) and mean forward return per horizon (over measured rows, 0 if none)."""
    return obs.groupBy(*keys).agg(
        F.count("*").alias("n"), *[_mean_or_zero(F.col(f"fwd_{h}")).alias(f"mean_{h}") for h in horizons]
    )


def regimes(bars: DataFrame, sessions: int = 200) -> DataFrame:
    """(d, regime): is the chain-linked market index above its own trailing mean on that session (axis-sized).

    Known on the session: neither later listings nor later ends change it."""
    w = Window.orderBy("d").rowsBetween(-(sessions - 1), 0)
    f = chain_index(bars).withColumn("mean_level", F.avg("level").over(w))
    return f.select("d", F.when(F.col("level") > F.col("mean_level"), "ABOVE").otherwise("BELOW").alias("regime"))


def with_regime(obs: DataFrame, bars: DataFrame, sessions: int = 200) -> DataFrame:
    """Attach the regime known on each as-of session: that of the latest factor session up to it."""
    axis = bars.select("d").distinct().join(regimes(bars, sessions), "d", "left")
    known = axis.select(
        F.col("d").alias("as_of"), F.last("regime", ignorenulls=True).over(Window.orderBy("d")).alias("regime")
    )
    return obs.join(broadcast_if_small(staged(known)), "as_of")


def feature_ic(long_obs: DataFrame, features: list[str]) -> DataFrame:
    """Rank IC of each pillar or raw feature against forward returns, per horizon."""
    legs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
    stacked = long_obs.select("horizon", "fwd_ret", F.inline(F.array(*legs)))
    return rank_correlation(stacked, ["feature", "horizon"], "x", "fwd_ret")


def by_year(long_obs: DataFrame) -> DataFrame:
    return horizon_metrics(long_obs.withColumn("year", F.year("as_of")), ["year", "horizon"])


def by_half(long_obs: DataFrame) -> DataFrame:
    """First and second half of the distinct as-of sessions."""
    days = long_obs.select("as_of").distinct()
    halves = days.withColumn("half", F.ntile(2).over(Window.orderBy("as_of")))
    return horizon_metrics(long_obs.join(broadcast_if_small(staged(halves)), "as_of"), ["half", "horizon"])


def score_buckets(obs: DataFrame, horizons: tuple[int, ...], width: int = 10) -> DataFrame:
    bucket = (F.floor(F.col("signal_score") / width) * width).cast("int")
    return means_by(obs.withColumn("bucket", bucket), ["bucket"], horizons)


def score_distribution(obs: DataFrame) -> DataFrame:
    s = F.col("signal_score")
    return obs.agg(
        F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"), F.min(s).alias("lowest"),
        F.max(s).alias("highest"),
    )


def buy_grade_by_cause(obs: DataFrame, grade: int = BUY_GRADE_SCORE) -> DataFrame:
    """Share of buy-grade observations per cause."""
    hit = (F.col("signal_score") >= grade).cast("long")
    per = obs.groupBy("cause").agg(F.count("*").alias("n"), F.sum(hit).alias("buys"))
    total = F.sum("buys").over(Window.partitionBy())
    return per.withColumn("share_of_buys", F.coalesce(F.try_divide(F.col("buys"), total), F.lit(0.0)))


def buy_clustering(obs: DataFrame, crowded: int = 5, grade: int = BUY_GRADE_SCORE) -> DataFrame:
    """How strongly buy-grade signals bunch on the same session."""
    days = obs.filter(F.col("signal_score") >= grade).groupBy("as_of").agg(F.count("*").alias("k"))
    return days.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("buys"),
        F.count("*").alias("days"),
        F.coalesce(F.max("k"), F.lit(0)).alias("most_in_a_day"),
        F.coalesce(
            F.try_divide(F.sum(F.when(F.col("k") >= crowded, F.col("k")).otherwise(0)), F.sum("k")), F.lit(0.0)
        ).alias("crowded_share"),
    )


def buy_grade_vs_rest(obs: DataFrame, horizons: tuple[int, ...], grade: int = BUY_GRADE_SCORE) -> DataFrame:
    return means_by(obs.withColumn("buy_grade", F.col("signal_score") >= grade), ["buy_grade"], horizons)


def gate_sweep(rows: DataFrame, sweep: Column, name: str, gate_a: Column, gate_b: Column) -> DataFrame:
    """Expand each row over a parameter sweep and keep the settings where two gates disagree.

    No surviving row means the second gate never changes an outcome.
    """
    swept = rows.withColumn(name, F.explode(sweep)).withColumns({"gate_a": gate_a, "gate_b": gate_b})
    return swept.filter(F.col("gate_a") != F.col("gate_b"))


# --- report -----------------------------------------------------------------------------------------------


def _signed(x: str, digits: int = 2) -> Column:
    return F.concat(F.when(F.col(x) >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f", F.col(x)))


def report_lines(obs: DataFrame, long_obs: DataFrame, horizons: tuple[int, ...], require_dip: bool = True) -> DataFrame:
    """(section, pos, line): the text report, built from the metric tables."""
    head = obs.agg(F.count("*").alias("n")).select(
        F.lit(0).alias("section"), F.lit(0).alias("pos"),
        F.concat(F.lit("Observations: "), F.col("n").cast("string"), F.lit(f"  (falls only: {str(require_dip).lower()})")).alias("line"),
    )
    m = horizon_metrics(long_obs).select(
        F.lit(1).alias("section"), F.col("horizon").alias("pos"),
        F.concat_ws(
            "  ",
            F.rpad(F.concat(F.col("horizon").cast("string"), F.lit("d")), 6, " "),
            F.lpad(F.col("n").cast("string"), 8, " "), F.lpad(F.format_string("%.3f", "ic"), 6, " "),
            *[F.lpad(_signed(c), 8, " ") for c in ("top_mean", "bottom_mean", "spread")],
            F.format_string("%3.0f%%", F.col("hit_rate_high") * 100),
        ).alias("line"),
    )
    by_n = Window.orderBy(F.col("n").desc(), "cause")
    causes = means_by(obs, ["cause"], horizons).select(
        F.lit(2).alias("section"), F.row_number().over(by_n).alias("pos"),
        F.concat(
            F.rpad("cause", 24, " "), F.lpad(F.col("n").cast("string"), 8, " "),
            *[F.lpad(_signed(f"mean_{h}"), 9, " ") for h in horizons],
        ).alias("line"),
    )
    caveats = ("Survivors only; observations overlap and are correlated.", "No costs or slippage.",
               "A measured rank correlation can expose a broken score; it cannot prove an edge.")
    foot = head.select(F.posexplode(F.array(*[F.lit(t) for t in caveats])).alias("pos", "line")).select(
        F.lit(3).alias("section"), "pos", "line"
    )
    return head.unionByName(m).unionByName(causes).unionByName(foot)


def write_report(lines: DataFrame, path: str) -> None:
    """Text sink. The report has a few dozen lines, so one file in order is the natural form."""
    lines.orderBy("section", "pos").select("line").coalesce(1).write.mode("overwrite").text(path)
