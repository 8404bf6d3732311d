"""Published values and planted truths."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbline.config import BASELINE_OUTCOMES, HurdleTerms, TaxProfile, WalkForwardConfig
from ebbline.functions import raises, scalar
from ebbline.operators import factors, outcomes, ranking, scoring, screen, technicals
from ebbline.operators.asof import as_of
from ebbline.plans import live, research, walkforward
from tests import panels


def one(spark, **exprs):
    return spark.range(1).select(*[v.alias(k) for k, v in exprs.items()]).first()


@pytest.mark.parametrize("wrapper, hurdle, loss", [("SEIS", 1.104, 0.45), ("EIS", 1.533, 0.45), ("NONE", 2.176, 0.0)])
def test_hurdle_and_total_loss(spark, wrapper, hurdle, loss):
    r = one(spark, **raises.hurdle_columns(F.lit(wrapper), F.lit("crowdcube"), HurdleTerms()))
    assert r.hurdle_multiple == pytest.approx(hurdle, abs=5e-4)
    assert r.downside_multiple == pytest.approx(loss, abs=1e-9)
    assert ("no_relief" in r.hurdle_notes) == (wrapper == "NONE")


def test_carry_and_breakeven(spark):
    r = one(
        spark,
        carried=raises.net_multiple(F.lit(5.0), F.lit("SEIS"), F.lit(0.0), F.lit(0.075), TaxProfile()),
        **{k: v for k, v in raises.hurdle_columns(F.lit("SEIS"), F.lit("Crowdcube"), HurdleTerms()).items() if k == "breakeven_multiple"},
    )
    assert r.carried == pytest.approx(9.4) and r.breakeven_multiple == pytest.approx(0.515)


def test_relief_needs_liability(spark):
    r = one(spark, with_=raises.net_cost_fraction(F.lit("SEIS"), True), without=raises.net_cost_fraction(F.lit("SEIS"), False))
    assert (r.with_, r.without) == (0.5, 1.0)


def test_negative_gross_is_an_error(spark):
    bad = raises.net_multiple(F.lit(-1.0), F.lit("NONE"), F.lit(0.0), F.lit(0.0), TaxProfile())
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(bad).collect()


def test_rounding_and_bounds_keep_null(spark):
    n = F.lit(None).cast("double")
    r = one(
        spark, a=scalar.half_up(F.lit(-1.25), 1), b=scalar.half_up(F.lit(2.5)), c=scalar.clamp(n, 0, 1), d=scalar.at_most(n, 3),
        e=scalar.scale_unit(n, 0, 1), f=scalar.finite_or(F.lit(float("nan")), 7.0), g=scalar.finite_or(F.lit(float("-inf")), 7.0),
        h=scalar.text_or(F.lit(""), F.lit("x")), i=scalar.scale_unit(F.lit(3.0), 2, 2),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == (-1.2, 3, None, None, None, 7.0, 7.0, "x", 0.0)


def test_formats(spark):
    r = one(
        spark, p=scalar.price_text(F.lit(1234.5)), q=scalar.price_text(F.lit(9.129)), t=scalar.cap_text(F.lit(2500.0)),
        b=scalar.cap_text(F.lit(12.4)), m=scalar.cap_text(F.lit(0.25)), s=scalar.pct_text(F.lit(1.0)), x=scalar.times_text(F.lit(3.0)),
    )
    assert tuple(r) == ("1,234.50", "9.13", "$2.50T", "$12B", "$250M", "+1.00%", "3.0x")


def baseline(spark):
    return spark.createDataFrame([("base", m, p) for m, p in BASELINE_OUTCOMES.items()], "dist_id string, multiple double, p double")


def test_tilt_is_neutral_at_zero_and_monotone(spark):
    scores = spark.createDataFrame([(20.0,), (50.0,), (80.0,)], "score double")
    rows = baseline(spark).join(scores)

    def gross(k):
        t = outcomes.tilt(rows, F.col("score"), k, by=["score"])
        assert all(abs(r.p - 1) < 1e-12 for r in t.groupBy("score").agg(F.sum("p").alias("p")).collect())
        return [r.expected_gross for r in outcomes.expectations(t, ["score"], ()).orderBy("score").collect()]

    flat, tilted = gross(0.0), gross(0.35)
    assert max(flat) - min(flat) < 1e-12 and tilted[0] < tilted[1] < tilted[2]


def test_expected_net_is_bucketwise(spark):
    r = outcomes.expectations(baseline(spark), ["dist_id"], (0.0,), outcomes.net_of("SEIS", TaxProfile())).first()
    naive = r.expected_gross / 0.5
    assert r.expected_net > naive and r.p_at_or_below_0 == pytest.approx(0.5)


def test_retail_moves_mass_to_total_loss(spark):
    r = {x.multiple: x.p for x in outcomes.retail(baseline(spark), F.lit(0.003), ["dist_id"]).collect()}
    assert sum(r.values()) == pytest.approx(1) and r[30.0] == pytest.approx(0.003) and r[0.0] == pytest.approx(0.507)


def test_odds_of_recorded_portfolios(spark):
    """The first n positions by time count, and an investor with fewer is in no portfolio of n."""
    rows = [("base", 1, 5, 0, 0.0), ("base", 1, 2, 1, 12.0), ("base", 1, 2, 0, 0.5), ("base", 2, 1, 0, 30.0), ("base", 3, 1, 0, 0.0), ("base", 3, 2, 0, 4.0)]
    rows += [("base", 4, k, 0, 0.0 if k < 100 else 30.0) for k in range(150)]
    positions = spark.createDataFrame(rows, "dist_id string, investor int, taken int, seq int, multiple double")
    got = {(r.investor, r.positions): (r.multiple, r.any_tail) for r in outcomes.portfolios(positions, F.col("multiple")).collect()}
    assert got[1, 1] == (0.5, False) and got[1, 2] == (6.25, True) and got[1, 3] == (pytest.approx(12.5 / 3), True) and (1, 5) not in got
    assert got[2, 1] == (30.0, True) and (2, 2) not in got and got[4, 100] == (0.0, False)
    curve = {r.positions: r for r in outcomes.odds(outcomes.portfolios(positions, F.col("multiple")), HurdleTerms()).collect()}
    assert (curve[1].investors, curve[1].p_any_tail, curve[2].investors, curve[2].median_multiple) == (4, 0.25, 3, 2.0)
    plan = outcomes.deployment(outcomes.odds(outcomes.portfolios(positions, F.col("multiple")), HurdleTerms()), F.lit(9000.0), F.lit(500.0), F.lit(0.5)).first()
    assert (plan.positions, plan.capital_at_risk) == (18, 4500.0)


def test_chain_index_ignores_what_comes_later(spark):
    panel = panels.factor_panel(5, 90, 41)
    day = panel.d.map({d: k for k, d in enumerate(panels.sessions(90))})
    frame = lambda p: spark.createDataFrame(p[["ticker", "d", "c"]]).withColumn("weight", F.lit(1.0))
    before = {r.d: (r.level, r.regime) for r in factors.chain_index(frame(panel[panel.ticker < "N4"])).join(research.regimes(frame(panel[panel.ticker < "N4"]), 20), "d").collect()}
    late = frame(panel[((panel.ticker < "N4") | (day >= 60)) & ~((panel.ticker == "N0") & (day > 75))])
    after = {r.d: (r.level, r.regime) for r in factors.chain_index(late).join(research.regimes(late, 20), "d").collect()}
    days = panels.sessions(90)
    assert all(before[d][1] == after[d][1] and before[d][0] == pytest.approx(after[d][0], rel=1e-12) for d in days[:61])
    assert before[days[61]][0] != after[days[61]][0] and len(after) == 90
    step = np.log(after[days[80]][0] / after[days[79]][0])
    c = {(r.ticker, r.d): r.c for r in panel.itertuples()}
    assert step == pytest.approx(np.mean([np.log(c[f"N{k}", days[80]] / c[f"N{k}", days[79]]) for k in (1, 2, 3, 4)]))


def test_ranges_follow_the_data(spark):
    """A column in a narrow band far from zero fills all ranges evenly, and ranks are those of a plain sort."""
    rng = np.random.default_rng(2)
    v = np.r_[1e6 + rng.random(6000) * 1e-3, np.full(3000, 1e6 + 5e-4)]
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double").repartition(5)
    cuts = ranking.borders(df, ["g"], "v")
    got = df.distinct().join(cuts, "g").groupBy(ranking.value_range(F.col("v")).alias("r")).count().collect()
    assert len(got) > 150 and max(r["count"] for r in got) < 120
    below = {r.v: (r.below, r.n, r.total) for r in ranking.counted(df, ["g"], "v").collect()}
    order = np.sort(v)
    assert all(below[x] == (np.searchsorted(order, x), np.searchsorted(order, x, "right") - np.searchsorted(order, x), 9000) for x in set(v.tolist()))
    nulls = spark.createDataFrame([("g", None), ("g", 1.0), ("g", float("nan")), ("h", None)], "g string, v double")
    assert sorted((r.g, str(r.v), r.below, r.total) for r in ranking.counted(nulls, ["g"], "v").collect()) == [("g", "1.0", 1, 3), ("g", "None", 0, 3), ("g", "nan", 2, 3), ("h", "None", 0, 1)]


def test_buy_grade_names_are_ranked(spark):
    """A fall that the market explains, on an oversold name of good quality, is a buy; the best ones come first."""
    rows = [(f"T{k}", s, c, o) for k, (s, c, o) in enumerate([(70, 82, 60), (62, 60, 45), (90, 82, 80), (62, 59, 60), (61, 82, 60), (70, 82, 44)])]
    df = spark.createDataFrame(rows, "ticker string, signal_score int, catalyst_score int, overlay_score int").withColumn("dip_pct_week", F.lit(-5.0))
    judged = df.withColumn("verdict", scoring.verdict(F.col("signal_score"), F.col("catalyst_score"), F.col("overlay_score")))
    assert [(r.ticker, r.signal_score) for r in screen.top_of(judged, ("BUY_THE_DIP",), 2).collect()] == [("T2", 90), ("T0", 70)]
    assert {r.ticker: r.verdict for r in judged.collect()} == {"T0": "BUY_THE_DIP", "T1": "BUY_THE_DIP", "T2": "BUY_THE_DIP", "T3": "ACCUMULATE", "T4": "ACCUMULATE", "T5": "WATCHLIST"}


def test_as_of_join(spark):
    left = spark.createDataFrame([("A", 5, 1), ("A", 9, 2), ("A", 1, 3), ("B", 5, 4), (None, 5, 5), ("A", None, 6), ("A", 9, 2)], "k string, at int, n int")
    right = spark.createDataFrame([("A", 5, 10.0), ("A", 5, 11.0), ("A", 8, None), ("A", 12, 13.0), (None, 1, 1.0), ("B", None, 2.0), ("C", 1, 3.0)], "k string, since int, v double")
    for salts in (1, 4):
        got = as_of(left, right, ["k"], "at", "since", {"v": "v", "from": "since"}, salts).collect()
        assert sorted((r.n, r.v, r["from"]) for r in got) == [(1, 11.0, 5), (2, None, 8), (2, None, 8), (3, None, None), (4, None, None), (5, None, None), (6, None, None)]


def obs_frame(spark, rows):
    df = spark.createDataFrame(
        [(f"T{k}", dt.date(2024, 1, 1) + dt.timedelta(days=k), s, c, f) for k, (s, c, f) in enumerate(rows)],
        "ticker string, as_of date, signal_score int, cause string, fwd_5 double",
    )
    return df, walkforward.long_observations(df, (5,))


@pytest.mark.parametrize("sign, ic", [(1, 1.0), (-1, -1.0)])
def test_rank_correlation_extremes(spark, sign, ic):
    _, long = obs_frame(spark, [(k, "UNKNOWN", float(sign * k)) for k in range(100)])
    m = research.horizon_metrics(long).first()
    assert m.ic == pytest.approx(ic) and math.copysign(1, m.spread) == sign and m.n == 100


def test_too_few_rows_give_zeros(spark):
    _, long = obs_frame(spark, [(60, "UNKNOWN", 1.0)] * 4)
    m = research.horizon_metrics(long).first()
    assert (m.n, m.ic, m.top_mean, m.hit_rate_high) == (4, 0.0, 0.0, 0.0)


def test_hit_rate_and_cause_means(spark):
    obs, long = obs_frame(
        spark, [(60, "MARKET_BETA", 4.0), (70, "MARKET_BETA", 6.0), (55, "IDIOSYNCRATIC_SHOCK", -8.0), (40, "UNKNOWN", 1.0), (30, "UNKNOWN", None), (20, "UNKNOWN", 2.0)]
    )
    assert research.horizon_metrics(long).first().hit_rate_high == pytest.approx(2 / 3)
    means = {r.cause: (r.n, r.mean_5) for r in research.means_by(obs, ["cause"], (5,)).collect()}
    assert means == {"MARKET_BETA": (2, 5.0), "IDIOSYNCRATIC_SHOCK": (1, -8.0), "UNKNOWN": (3, 1.5)}


def test_ranks_quantiles_and_positions_against_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.35, 0.0, np.round(rng.standard_cauchy(3000) * 50, 3))  # one value fills a third
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "x": x, "y": rng.normal(size=3000), "s": rng.integers(0, 9, 3000), "d": rng.integers(0, 40, 3000), "t": [f"{k:04d}" for k in range(3000)]})
    df = spark.createDataFrame(pdf)
    q = ranking.floor_quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.9}).toPandas().set_index("g")
    ic = ranking.rank_correlation(df, ["g"], "x", "y").toPandas().set_index("g").ic
    for g, part in pdf.groupby("g"):
        srt = np.sort(part.x)
        assert q.loc[g].a == srt[int(0.1 * (len(srt) - 1))] and q.loc[g].b == srt[int(0.9 * (len(srt) - 1))]
        assert ic[g] == pytest.approx(part.x.rank().corr(part.y.rank()))
    pos = ranking.stable_positions(df, ["g"], "s", "d", "t").toPandas().set_index("t").pos
    srt = pdf.sort_values(["g", "s", "d", "t"])
    assert (pos.loc[srt.t].values == srt.groupby("g").cumcount().values + 1).all()


def test_factor_weights_and_shared_calendar(spark):
    days = panels.sessions(13)
    rows = [("A", d, 100 * 1.01**k, 3.0) for k, d in enumerate(days)] + [("B", d, 100 * 0.99**k, 1.0) for k, d in enumerate(days) if k not in (4, 9)]
    f = factors.factor_series(spark.createDataFrame(rows, "ticker string, d date, c double, weight double")).orderBy("d").toPandas()
    assert len(f) == 11 and f.level[0] == 100
    step = 0.75 * math.log(1.01) + 0.25 * math.log(0.99)
    assert f.ret[1] == pytest.approx(step) and f.ret[4] == pytest.approx(2 * step)


def test_planted_betas_and_additivity(spark):
    rng = np.random.default_rng(5)
    days, n = panels.sessions(220), 220
    market, sector = rng.normal(0, 0.01, n), rng.normal(0, 0.008, n)
    series = {f"M{k}": market + rng.normal(0, 0.0005, n) for k in range(12)}
    series |= {f"P{k}": market + sector + rng.normal(0, 0.0005, n) for k in range(3)}
    series["T"] = 1.5 * market + 0.8 * sector + rng.normal(0, 0.003, n)
    rows = [(t, d, 100.0, float(c), 10.0, 1000.0 if t[0] == "M" else 0.001) for t, r in series.items() for d, c in zip(days, 100 * np.exp(np.cumsum(r)))]
    bars = spark.createDataFrame(rows, "ticker string, d date, o double, c double, v double, market_cap_b double")
    edges = spark.createDataFrame([("T", f"P{k}") for k in range(3)], "ticker string, peer string")
    cfg = WalkForwardConfig(min_history=60, last_only=True)
    t = walkforward.as_of_decompositions(bars, edges, cfg)[0].filter("ticker = 'T'").first()
    assert t.beta_market == pytest.approx(1.5, abs=0.15) and t.beta_sector == pytest.approx(0.8, abs=0.15)
    parts = sum(math.log(1 + getattr(t, f"{p}_pct") / 100) for p in ("market", "sector", "idio"))
    assert parts == pytest.approx(math.log(1 + t.total_pct / 100), abs=1e-9)


def test_gap_versus_drift(spark):
    days = panels.sessions(8)
    c = [100.0, 101.0, 102.0, 100.0, 98.0, 96.0, 94.0, 92.0]
    gap = [("G", d, c[max(k - 1, 0)] * 0.981 if k else 100.0, c[k], 1.0) for k, d in enumerate(days)]
    drift = [("D", d, float(c[max(k - 1, 0)]), c[k], 1.0) for k, d in enumerate(days)]
    none = [("N", d, None, c[k], 1.0) for k, d in enumerate(days)]
    df = spark.createDataFrame(gap + drift + none, "ticker string, d date, o double, c double, v double")
    r = {x.ticker: x.gap_share for x in technicals.technicals(df).filter(F.col("d") == days[-1]).collect()}
    assert r["G"] > 0.8 and r["D"] == pytest.approx(0.0) and r["N"] is None


def test_verdict_ladder(spark):
    cases = [((45, 20, 80), "FALLING_KNIFE"), ((39, 29, 80), "AVOID"), ((62, 60, 45), "BUY_THE_DIP"), ((62, 60, 44), "WATCHLIST"),
             ((50, 55, 45), "ACCUMULATE"), ((49, 90, 90), "WATCHLIST"), ((38, 40, 0), "WATCHLIST"), ((25, 40, 0), "FALLING_KNIFE"), ((24, 40, 0), "AVOID")]
    for (signal, catalyst, overlay), want in cases:
        assert one(spark, v=scoring.verdict(F.lit(signal), F.lit(catalyst), F.lit(overlay))).v == want


def test_short_histories_are_not_admitted(spark):
    days = panels.sessions(310)
    rows = [("LONG", d, 1.0) for d in days] + [("SHORT", d, 1.0) for d in days[:59]]
    df = spark.createDataFrame(rows, "ticker string, d date, c double")
    r = {x.ticker: x["count"] for x in live.admitted(live.newest_sessions(df)).groupBy("ticker").count().collect()}
    assert r == {"LONG": 300}


def test_popular_peer_is_split_without_changing_rows(spark):
    names = [f"F{k}" for k in range(300)]
    panel = spark.createDataFrame([("HOT", 1, 1, 2.0), ("COLD", 1, 1, 3.0)], "ticker string, di int, admitted_di int, c double")
    edges = spark.createDataFrame([(n, "HOT", 0) for n in names] + [("F1", "COLD", 1)], "ticker string, peer string, pos int")
    got = factors.followed_bars(panel, edges)
    assert got.count() == 301 and got.filter("peer = 'HOT'").select("part").distinct().count() == 5
    assert {r.follower for r in got.collect()} == set(names)


def test_report_is_written_as_text(spark, tmp_path):
    obs, long = obs_frame(spark, [(k, "MARKET_BETA" if k % 2 else "UNKNOWN", float(k)) for k in range(50)])
    path = str(tmp_path / "report")
    research.write_report(research.report_lines(obs, long, (5,)), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0].startswith("Observations: 50") and lines[1].startswith("5d") and len(lines) == 7


def test_empty_universe_is_an_error(spark):
    empty = spark.createDataFrame([], "ticker string, d date, c double")
    with pytest.raises(ValueError, match="enough history"):
        live.require_names(live.admitted(empty))


def test_overlay_defaults(spark):
    rows = spark.createDataFrame([("A", 1.0), ("B", 1.0)], "ticker string, price double")
    full = {k: (v if isinstance(v, str) else v + 1) for k, v in walkforward.NEUTRAL.items()} | {"ticker": "A", "name": "Alpha"}
    got = {r.ticker: r for r in walkforward.with_overlay(rows, spark.createDataFrame([full])).collect()}
    assert (got["A"].name, got["A"].pe_forward, got["A"].moat) == ("Alpha", 21.0, 4.0)
    assert (got["B"].name, got["B"].pe_forward, got["B"].moat, got["B"].catalyst_type) == ("B", 20.0, 3.0, "no_news")
    assert got["B"].sector_pe == pytest.approx(18.0) and got["B"].ev_to_ebitda == 12.0


def test_closes_without_a_logarithm_leave_the_factor_alone(spark):
    rows = [(t, dt.date(2024, 1, d), 10.0 * d, 1.0) for t in ("A", "B") for d in (1, 2, 3)] + [("C", dt.date(2024, 1, d), c, 5.0) for d, c in ((1, 10.0), (2, 0.0), (3, 30.0))]
    got = factors.factor_series(spark.createDataFrame(rows, "ticker string, d date, c double, weight double")).orderBy("d").collect()
    assert [round(r.level, 6) for r in got] == [100.0, 200.0, 300.0]
