"""Small price panels with the irregularities the point-in-time rules are about."""

from __future__ import annotations

import numpy as np
import pandas as pd


def sessions(n: int) -> list:
    return list(pd.bdate_range("2020-01-01", periods=n).date)


def factor_panel(names: int, n: int, seed: int, vol=0.01) -> pd.DataFrame:
    """Complete panel: market + two sector factors + own noise, opens between closes."""
    rng = np.random.default_rng(seed)
    days = sessions(n)
    market = rng.normal(0, vol, n)
    sector = rng.normal(0, vol * 0.8, (2, n))
    rows = []
    for k in range(names):
        r = (0.7 + 0.1 * k) * market + 0.6 * sector[k % 2] + rng.normal(0, vol, n)
        c = 100 * np.exp(np.cumsum(r))
        gap = rng.uniform(0, 1, n)
        o = c * np.exp(-r * gap)
        v = rng.integers(0, 50, n) * 10.0
        for t in range(n):
            rows.append((f"N{k}", f"S{k % 2}", days[t], round(o[t], 4), round(c[t], 4), float(v[t]), 1.0 + k))
    return pd.DataFrame(rows, columns=["ticker", "sector", "d", "o", "c", "v", "market_cap_b"])


def edges_of(panel: pd.DataFrame) -> pd.DataFrame:
    names = panel[["ticker", "sector"]].drop_duplicates()
    m = names.merge(names, on="sector", suffixes=("", "_p"))
    m = m[m.ticker != m.ticker_p]
    return m.rename(columns={"ticker_p": "peer"})[["ticker", "peer"]]


def late_and_gappy(seed: int = 3) -> pd.DataFrame:
    """One name starts late, one misses every seventh session, one is halted for a while, one has NULL opens."""
    p = factor_panel(6, 150, seed)
    days = sessions(150)
    day_no = p.d.map({d: i for i, d in enumerate(days)})
    drop = (p.ticker == "N1") & (day_no < 40)
    drop |= (p.ticker == "N2") & (day_no % 7 == 3)
    drop |= (p.ticker == "N3") & day_no.between(100, 108)
    p.loc[(p.ticker == "N4") & (day_no % 11 == 0), "o"] = np.nan
    return p[~drop].reset_index(drop=True)


def sparse_member(seed: int = 5) -> pd.DataFrame:
    """A name that trades on one session in four: its frames reach back beyond the others' windows."""
    p = factor_panel(5, 620, seed)
    days = sessions(620)
    day_no = p.d.map({d: i for i, d in enumerate(days)})
    return p[~((p.ticker == "N2") & (day_no % 4 != 0))].reset_index(drop=True)


def delisted(seed: int = 7) -> pd.DataFrame:
    p = factor_panel(5, 160, seed)
    days = sessions(160)
    day_no = p.d.map({d: i for i, d in enumerate(days)})
    return p[~((p.ticker == "N3") & (day_no > 120))].reset_index(drop=True)


def ended(names: int, n: int, last: int, seed: int = 9) -> pd.DataFrame:
    """Complete names, of which one stops for good after ``last`` sessions."""
    p = factor_panel(names, n, seed)
    return p[~((p.ticker == "N1") & (p.d > sessions(n)[last - 1]))].reset_index(drop=True)
