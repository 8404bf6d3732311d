"""Registered queries against their SQL on the smallest data folder."""

import itertools

import pytest

import __spark_entry__ as contract
from checks.compare import difference, duck
from ebbline import fixtures

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "history_bars", "payload_quarantine", "filing_listings", "offering_terms", "positions_current", "price_levels",
    "volume_ratios", "market_factor", "decompositions", "trade_plans", "risk_flags", "horizon_metrics", "feature_ic",
    "order_value_quantiles", "evidence_signals", "deal_verdicts", "research_tasks", "hurdle_scenarios",
    "tail_sensitivity", "portfolio_odds", "stream_session_bars",
)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert difference(got, con.sql(contract.oracle_sql()[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns[:4] == ["ticker", "as_of", "signal_score", "cause"] and df.count() > 100


def test_lines_are_joined_to_orders_that_know_their_nation(spark):
    """The join with the customers holds no order lines: those would move once more."""
    plan = fixtures.bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    tops = [k for k, line in enumerate(plan) if "Join Inner" in line and "c_custkey" in line]
    assert tops
    for k in tops:
        below = itertools.takewhile(lambda line: depth(line) > depth(plan[k]), plan[k + 1 :])
        assert not any("l_shipdate" in line for line in below)
