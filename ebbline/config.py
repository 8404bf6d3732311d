"""Fixed values and run options.

The numbers in the first part are fixed values of the scoring model: results are only comparable when they
are exactly these. The dataclasses below them are what a caller may change per run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: equity desk -------------------------------------------------------------------------

SESSION_WINDOW = 300
MIN_LIVE_SESSIONS = 60
DIP_SESSIONS = 5
ESTIMATION_SESSIONS = 120
MIN_ESTIMATION_RETURNS = 30

PILLAR_WEIGHTS = {
    "quality": 0.22,
    "catalyst": 0.22,
    "valuation": 0.18,
    "dip_character": 0.18,
    "technical": 0.12,
    "flow": 0.08,
}
SIGNAL_PILLARS = ("catalyst", "dip_character", "technical")

SHOCK_Z = -2.5
GAP_DOMINANT = 0.6
GAP_SHOCK_Z = -1.5
SYSTEMATIC_DOMINANT = 0.7

VERDICTS = ("BUY_THE_DIP", "ACCUMULATE", "WATCHLIST", "FALLING_KNIFE", "AVOID")
BUY_GRADE_SCORE = 62

INDEX_PROXIES = {"SPY": "S&P 500", "QQQ": "Nasdaq 100", "DIA": "Dow Jones", "IWM": "Russell 2000"}

# --- fixed values: private-raise desk -------------------------------------------------------------------

RELIEF_RATE = {"SEIS": 0.5, "EIS": 0.3, "NONE": 0.0}
MIN_HOLD_YEARS = {"SEIS": 3, "EIS": 3, "NONE": 0}

# platform -> (fee on the amount invested, carry on profit)
PLATFORM_FEES = {
    "crowdcube": (0.015, 0.0),
    "seedrs": (0.0, 0.075),
    "republic": (0.0, 0.075),
    "wefunder": (0.02, 0.0),
    "startengine": (0.035, 0.0),
}

BASELINE_OUTCOMES = {0.0: 0.5, 0.3: 0.13, 1.0: 0.17, 2.0: 0.1, 5.0: 0.06, 10.0: 0.03, 30.0: 0.01}
TAIL_GRID = (0.02, 0.015, 0.012, 0.01, 0.008, 0.007, 0.005, 0.003, 0.0)
POSITION_GRID = (1, 2, 3, 5, 8, 10, 15, 20, 30, 50, 75, 100)
TAIL_MULTIPLE = 10.0

EVIDENCE_WEIGHTS = {
    "team": 20.0,
    "traction": 20.0,
    "terms": 20.0,
    "integrity": 16.0,
    "smart_money": 14.0,
    "market": 10.0,
}
MISSING_VALUE = -0.55
STAGE_REVENUE_NORM = {
    "pre_seed": 50_000.0,
    "seed": 300_000.0,
    "series_a": 1_500_000.0,
    "growth": 5_000_000.0,
    "unknown": 300_000.0,
}
OPACITY_FLAG = 0.40
OPACITY_VETO = 0.65
EXTREME_REVENUE_MULTIPLE = 30.0
NO_RIGHTS_REVENUE_MULTIPLE = 15.0
INSOLVENCY_PATTERN = 2

NETWORK_WEIGHTS = {
    "professional_lead": 30.0,
    "named_co_investors": 20.0,
    "syndicate_access": 18.0,
    "founder_accessible": 12.0,
    "sector_adjacency": 12.0,
    "investor_scale": 8.0,
}

ANGEL_VERDICTS = ("ELIGIBLE", "ELIGIBLE_WITH_FLAGS", "INSUFFICIENT_DATA", "REJECTED")
LIVE_RAISE_KINDS = ("offering", "amendment")


# --- run options ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class WalkForwardConfig:
    """Options of a walk-forward run. ``last_only`` scores only the newest session (the live screen)."""

    horizons: tuple[int, ...] = (5, 20, 60)
    min_history: int = SESSION_WINDOW
    require_dip: bool = True
    min_names: int = 3
    last_only: bool = False
    segment_sessions: int = 1024


@dataclass(frozen=True)
class TaxProfile:
    marginal_rate: float = 0.45
    sufficient_liability: bool = True


@dataclass(frozen=True)
class HurdleTerms:
    """The comparison a deal is priced against."""

    years: float = 8.0
    index_return: float = 0.10
    illiquidity_premium: float = 0.0
    tax: TaxProfile = field(default_factory=TaxProfile)
