"""The incremental screen against the whole screen, after every batch."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.plans import live, walkforward
from ebbline.streaming import jobs, rescore
from tests import panels

SCORED = ["verdict", "signal_score", "dip_score", "cause", "total_pct", "market_pct", "sector_pct", "beta_market", "beta_sector", "residual_z", "price", "stop"]


@pytest.fixture(scope="module")
def market(spark):
    p = panels.factor_panel(7, 330, 31, vol=0.02)
    day = p.d.map({d: k for k, d in enumerate(panels.sessions(330))})
    p = p[~((p.ticker == "N5") & (day < 290)) & ~((p.ticker == "N6") & (day % 9 == 4))]
    names = sorted(p.ticker.unique())
    overlay = spark.createDataFrame([
        {k: (v if isinstance(v, str) else float(v)) for k, v in walkforward.NEUTRAL.items()} | {"ticker": t, "name": t, "overlay_sector": "S", "moat": 4.0, "balance_sheet": 4.0} for t in names
    ])
    profile = spark.createDataFrame(
        [(t, "", None, 1e9 * (k + 1), None, None, None, None, "", "") for k, t in enumerate(names)],
        "ticker string, company_name string, quote_price double, market_cap double, beta double, volume double, average_volume double, change_pct double, profile_sector string, profile_industry string",
    )
    empty = lambda s: spark.createDataFrame([], s)
    ratios = empty("ticker string, gross_margin double, operating_margin double, pe_ttm double")
    metrics = empty("ticker string, ev_to_ebitda double, net_debt_ebitda double, roic double, fcf_yield double")
    edges = spark.createDataFrame(panels.edges_of(p))
    sides = (edges, overlay, profile, ratios, metrics, empty("sector string, date date, pe double"))
    return p, tuple(df.cache() for df in sides)


def bars_of(spark, panel, seq=0):
    rows = [(r.ticker, r.d, float(r.o), float(r.c), float(r.v), seq) for r in panel.itertuples()]
    return spark.createDataFrame(rows, rescore.BARS)


def test_each_batch_equals_the_whole_screen(spark, market, tmp_path):
    """A name's fall that the stored table lacks, the rest of that session, a correction in the past, a late listing that
    becomes a member."""
    panel, sides = market
    last = panels.sessions(330)[-1]
    screen = rescore.Screen(str(tmp_path / "state"), str(tmp_path / "out"), *sides)
    bars = bars_of(spark, panel)
    screen.start(bars)
    after = [last + dt.timedelta(days=k) for k in range(1, 25)]
    price = {t: float(g.c.iloc[-1]) for t, g in panel.groupby("ticker")}
    new = lambda t, d, f, seq=1: (t, d, price[t], round(price[t] * f, 2), 500.0, seq)
    correction = panel[(panel.ticker == "N3") & (panel.d == panels.sessions(330)[280])].iloc[0]
    batches = [
        [new("N0", after[0], 0.7)],
        [new(t, after[0], 0.98) for t in ("N1", "N2", "N3", "N4", "N5", "N6")],
        [("N3", correction.d, float(correction.o), float(correction.c) * 1.1, 5.0, 2), new("N0", after[0], 0.99, 2)],
        [new("N5", d, 1.0 + 0.01 * (k % 3)) for k, d in enumerate(after[1:])],
    ]
    scored, verdicts = [], []
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, rescore.BARS)
        bars = bars.union(batch)
        screen.advance(batch, k)
        merged = bars.groupBy("ticker", "d").agg(F.max(F.struct("seq", "o", "c", "v")).alias("x")).select("ticker", "d", "x.o", "x.c", "x.v")
        want = live.analyses(merged, *sides).select("ticker", *SCORED).toPandas().sort_values("ticker").reset_index(drop=True)
        out = spark.read.parquet(str(tmp_path / "out"))
        got = jobs.newest_by_key(out.select("batch", "ticker", *SCORED)).toPandas().sort_values("ticker").reset_index(drop=True)
        assert got.ticker.tolist() == want.ticker.tolist()
        for c in SCORED:
            if got[c].dtype == object:
                assert got[c].tolist() == want[c].tolist(), (k, c)
            else:
                np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-8, err_msg=f"{k} {c}")
        scored.append(out.filter(F.col("batch") == k + 1).count())
        verdicts.append(got.set_index("ticker").verdict["N0"])
    assert scored[:3] == [4, 6, 6] and "N5" in got.ticker.tolist() and len(set(verdicts)) > 1
