"""Segmented panel against one explicit window per as-of session, on panels that break every simplification."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import sql_equity as eq
from ebbline.config import WalkForwardConfig
from ebbline.plans import walkforward
from tests import panels

NUMBERS = ["total_pct", "market_pct", "sector_pct", "idio_pct", "systematic_share", "beta_market", "beta_sector",
           "residual_z", "gap_share", "price", "dip_pct_week", "volume_ratio", "rsi14", "sma50", "sma200",
           "support_level", "resistance_level", "dip_z", "atr_pct", "realized_vol_pct", "drawdown_pct", "range_position"]


def frames(spark, panel):
    return spark.createDataFrame(panel), spark.createDataFrame(panels.edges_of(panel))


def brute_force(panel, min_history, last_only=False):
    con = duckdb.connect()
    bars = panel.drop(columns="market_cap_b").copy()
    bars["d"] = pd.to_datetime(bars.d)
    con.register("bars0", bars)
    con.register("caps", panel[["ticker", "market_cap_b"]].drop_duplicates())
    con.register("edges", panels.edges_of(panel))
    con.execute("create view bars as select ticker, sector, cast(d as date) as d, case when isnan(o) then null else o end as o, c, v from bars0")
    return con.sql(f"with {eq.TECH.lstrip()}, {eq.decomposition(min_history, last_only)} select * from dec").df()


def compare(got, want):
    got["as_of"], want["as_of"] = pd.to_datetime(got.as_of), pd.to_datetime(want.as_of)
    m = got.merge(want, on=["ticker", "as_of"], how="outer", suffixes=("", "_w"), indicator=True)
    assert (m._merge == "both").all(), m._merge.value_counts()
    assert (m.cause == m.cause_w).all(), m[m.cause != m.cause_w][["ticker", "as_of", "cause", "cause_w"]].head()
    assert (m.confidence == m.confidence_w).all()
    for c in NUMBERS:
        a, b = m[c].astype(float), m[f"{c}_w"].astype(float)
        assert (a.isna() == b.isna()).all(), c
        np.testing.assert_allclose(a.fillna(0), b.fillna(0), rtol=1e-7, atol=1e-9, err_msg=c)
    return m


@pytest.mark.parametrize(
    "build, min_history",
    [(panels.late_and_gappy, 60), (panels.sparse_member, 100), (panels.delisted, 60)],
    ids=["late-gappy", "sparse", "delisted"],
)
def test_equals_explicit_windows(spark, build, min_history):
    panel = build()
    bars, edges = frames(spark, panel)
    cfg = WalkForwardConfig(min_history=min_history, require_dip=False)
    rows, _ = walkforward.as_of_decompositions(bars, edges, cfg)
    m = compare(rows.toPandas(), brute_force(panel, min_history))
    assert m.cause.nunique() >= 3


def test_an_ended_name_does_not_multiply_the_panel(spark, monkeypatch):
    """Four names over 1,400 sessions, one of which stops at 500: explicit windows, from under ten copies of a bar."""
    panel = panels.ended(4, 1400, 500)
    copies = []

    def counted(fn):
        def run(*args):
            out = fn(*args)
            copies.append(out.count())
            return out

        return run

    for name in ("live_panel", "window_rows"):
        monkeypatch.setattr(walkforward.panel, name, counted(getattr(walkforward.panel, name)))
    rows, _ = walkforward.as_of_decompositions(*frames(spark, panel), WalkForwardConfig(require_dip=False))
    m = compare(rows.toPandas(), brute_force(panel, 300))
    assert len(copies) == 2 and sum(copies) < 10 * len(panel)
    assert m.cause.nunique() >= 3 and len(m) > 4000


def test_one_session_segments_agree(spark):
    panel = panels.late_and_gappy(11)
    bars, edges = frames(spark, panel)
    wide = WalkForwardConfig(min_history=70, require_dip=False)
    narrow = WalkForwardConfig(min_history=70, require_dip=False, segment_sessions=1)
    a = walkforward.as_of_decompositions(bars, edges, wide)[0].toPandas()
    b = walkforward.as_of_decompositions(bars, edges, narrow)[0].toPandas()
    compare(a, b)


def test_newest_session_only(spark):
    panel = panels.late_and_gappy(13)
    bars, edges = frames(spark, panel)
    cfg = WalkForwardConfig(min_history=60, last_only=True)
    rows = walkforward.as_of_decompositions(bars, edges, cfg)[0].toPandas()
    assert rows.as_of.nunique() == 1
    compare(rows, brute_force(panel, 60, last_only=True))


def test_no_look_ahead(spark):
    panel = panels.factor_panel(4, 140, 17)
    cut = panels.sessions(140)[120]
    cfg = WalkForwardConfig(min_history=70, require_dip=False, horizons=(5,))
    keep = ["ticker", "as_of", "signal_score", "cause", "residual_z"]
    full = walkforward.observations(*frames(spark, panel), cfg).filter(F.col("as_of") < F.lit(cut)).select(*keep, "fwd_5").toPandas()
    early = walkforward.observations(*frames(spark, panel[panel.d <= cut]), cfg).select(*keep, "fwd_5").toPandas()
    m = full.merge(early, on=["ticker", "as_of"], suffixes=("", "_e"))
    assert len(m) > 100
    assert (m.signal_score == m.signal_score_e).all() and (m.cause == m.cause_e).all()
    np.testing.assert_allclose(m.residual_z, m.residual_z_e, rtol=1e-8)


def test_forward_returns_use_the_shared_axis(spark):
    panel = panels.late_and_gappy(19)
    bars, edges = frames(spark, panel)
    cfg = WalkForwardConfig(min_history=60, horizons=(5, 20))
    obs = walkforward.observations(bars, edges, cfg).toPandas()
    assert (obs.dip_pct_week < 0).all()
    axis = panels.sessions(150)
    at = {(r.ticker, r.d): r.c for r in panel.itertuples()}
    for o in obs.itertuples():
        for h in (5, 20):
            i = axis.index(o.as_of) + h
            future = at.get((o.ticker, axis[i])) if i < len(axis) else None
            value = getattr(o, f"fwd_{h}")
            if future is None:
                assert np.isnan(value)
            else:
                assert value == pytest.approx((future / o.price - 1) * 100)


def test_window_is_capped(spark):
    """Prices older than 300 bars must not reach any feature."""
    panel = panels.factor_panel(3, 420, 23)
    inflated = panel.copy()
    old = inflated.d < panels.sessions(420)[60]
    inflated.loc[old, ["c", "o"]] *= 10
    cfg = WalkForwardConfig(last_only=True)
    a = walkforward.as_of_decompositions(*frames(spark, panel), cfg)[0].toPandas()
    b = walkforward.as_of_decompositions(*frames(spark, inflated), cfg)[0].toPandas()
    compare(a, b)
