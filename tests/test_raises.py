"""Vetoes, verdict precedence, disclosure, network, tasks - on single deals with overrides."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ebbline import queries
from ebbline.operators import evidence
from ebbline.plans import assess
from ebbline.sources import filings
from ebbline.staging import staged

AS_OF = "2026-07-01"
DIR = "/root/testdata/sf0.001"
FULL = {
    "founders": [("Ada", 10.0, True, True, True, 0), ("Bo", 4.0, False, False, True, 0)],
    "traction": (400000.0, 120.0, 70.0, 18.0, 4.0, 1.0),
    "terms": (2000000.0, 300000.0, None, None, "ordinary", True, True, True, "SEIS", False, 80.0),
    "registry": ("1", dt.date(2019, 1, 1), "current", False, False, 0, 3, "registry"),
    "network": (["A", "B", "C"], True, 200, True, 0.8, True),
}


def deal_frame(spark, country="UK", sector="fintech", **parts):
    values = FULL | parts
    schema = "deal_id string, company_name string, platform string, sector string, stage string, country string, " + ", ".join(
        f"{k} {t}" for k, t in filings.DEAL_PARTS.items()
    )
    row = ("d1", "Co", "crowdcube", sector, "seed", country, *[values[k] for k in filings.DEAL_PARTS])
    return assess.assess(spark.createDataFrame([row], schema), AS_OF)


def deal(spark, *args, **kw):
    return deal_frame(spark, *args, **kw).first()


def terms(**kw):
    names = ["pre_money", "target_raise", "amount_raised", "equity_offered_pct", "share_class", "has_preemption_rights",
             "has_information_rights", "has_voting_rights", "tax_wrapper", "nominee_structure", "founder_retained_pct"]
    return tuple(kw.get(n, v) for n, v in zip(names, FULL["terms"]))


def registry(**kw):
    names = ["company_number", "incorporated_on", "filing_health", "accounts_overdue", "confirmation_overdue", "outstanding_charges", "active_directors", "source"]
    return tuple(kw.get(n, v) for n, v in zip(names, FULL["registry"]))


def codes(row):
    return [v.code for v in row.vetoes]


def test_clean_deal_is_eligible(spark):
    r = deal(spark)
    assert r.verdict == "ELIGIBLE" and codes(r) == [] and r.opacity_index == 0 and r.network_band == "HIGH"
    assert r.task_codes == []


def test_missing_wrapper_is_hard_in_uk_and_soft_elsewhere(spark):
    uk, us = deal(spark, terms=terms(tax_wrapper="NONE")), deal(spark, country="US", terms=terms(tax_wrapper="NONE"))
    assert (uk.verdict, codes(uk)) == ("REJECTED", ["no_advance_assurance"])
    assert (us.verdict, codes(us)) == ("ELIGIBLE_WITH_FLAGS", ["unwrapped_jurisdiction"])
    assert us.hurdle_multiple > 2 * deal(spark).hurdle_multiple * 0.9


def test_registry_vetoes(spark):
    assert codes(deal(spark, registry=registry(accounts_overdue=True))) == ["accounts_overdue"]
    assert codes(deal(spark, registry=registry(filing_health="strike_off_proposed"))) == ["strike_off_proposed"]
    charged = deal(spark, registry=registry(outstanding_charges=2))
    assert codes(charged) == ["secured_debt_ahead"] and charged.verdict == "ELIGIBLE_WITH_FLAGS"


def test_insolvency_pattern_names_the_founder(spark):
    r = deal(spark, founders=[("Ada", 10.0, True, True, True, 1), ("Cy", 3.0, False, False, True, 2)])
    assert codes(r) == ["director_insolvency_pattern"] and "Cy" in r.vetoes[0].reason


def test_price_vetoes(spark):
    dear = terms(pre_money=13000000.0)
    assert codes(deal(spark, terms=dear)) == ["extreme_valuation"]
    assert codes(deal(spark, sector="deeptech", terms=dear)) == []
    no_rights = terms(pre_money=7000000.0, share_class="b_shares", has_preemption_rights=False, has_information_rights=False)
    assert codes(deal(spark, terms=no_rights)) == ["no_rights_at_high_price"]
    unknown = terms(pre_money=7000000.0, share_class="b_shares", has_preemption_rights=None, has_information_rights=False)
    assert codes(deal(spark, terms=unknown)) == []


def test_undisclosed_is_not_default(spark):
    blank = deal(
        spark, founders=[], traction=(None,) * 6, registry=None, network=(None,) * 6,
        terms=terms(pre_money=None, share_class="unknown", has_preemption_rights=None, has_information_rights=None, has_voting_rights=None, nominee_structure=None, founder_retained_pct=None),
    )
    assert blank.verdict == "INSUFFICIENT_DATA" and blank.opacity_index >= 0.65 and blank.network_band == "NONE"
    assert blank.task_codes[0] == "integrity.no_registry" and len(blank.task_codes) == len(set(blank.task_codes))
    assert {s.missing for s in blank.terms_signals} == {True}
    worse = deal(
        spark, founders=[], traction=(None,) * 6, registry=None, network=(None,) * 6,
        terms=terms(pre_money=None, share_class="unknown", has_preemption_rights=None, has_information_rights=None, has_voting_rights=None, nominee_structure=None, founder_retained_pct=None, tax_wrapper="NONE"),
    )
    assert worse.verdict == "REJECTED"  # a known disqualifying fact outranks missing disclosure


def test_network_never_lifts_a_rejection(spark):
    r = deal(spark, terms=terms(tax_wrapper="NONE"))
    assert r.network_band == "HIGH" and r.verdict == "REJECTED"


def test_long_form_agrees_with_row_form(spark):
    df = deal_frame(spark, registry=None, founders=[("Ada", None, None, None, None, 0)])
    row = df.first()
    long = evidence.deal_rows(evidence.pillar_rows(evidence.signal_rows(df))).first()
    assert long.evidence_score == row.evidence_score and long.opacity_index == row.opacity_index


def test_display_order(spark):
    rows = [("a", "REJECTED", 0.0), ("b", "ELIGIBLE", 0.3), ("c", "ELIGIBLE", 0.1), ("d", "INSUFFICIENT_DATA", 0.0), ("e", "ELIGIBLE_WITH_FLAGS", 0.9)]
    df = spark.createDataFrame(rows, "deal_id string, verdict string, opacity_index double")
    assert [r.deal_id for r in assess.in_display_order(df).collect()] == ["c", "b", "e", "d", "a"]


FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>x</title>
<entry><title>C - Alpha Inc (0001234567) (Filer)</title><link rel="alternate" href="https://www.sec.gov/Archives/edgar/data/1/000123456726000001/0001234567-26-000001-index.htm"/><updated>2026-07-01T10:00:00Z</updated></entry>
<entry><title>C/A - Beta &amp; Sons (0001234568) (Filer)</title><link href="https://www.sec.gov/Archives/edgar/data/1/000123456826000002/"/></entry>
<entry><title>C-AR - Gamma (0001234569) (Filer)</title><link href="https://www.sec.gov/x"/></entry>
<entry><title>no pattern here</title><link href="https://www.sec.gov/y"/></entry>
<entry><title>C - Lost (0001234567)</title></entry></feed>"""


def test_feed_is_read_entry_by_entry(spark):
    docs = spark.createDataFrame([("f", FEED), ("h", "<!DOCTYPE html><html></html>"), ("t", "oops")], "path string, body string")
    rows = {r.company_name: r for r in filings.listings(filings.feed_entries(docs)).collect()}
    assert set(rows) == {"Alpha Inc", "Beta & Sons", "Gamma", "no pattern here"}
    assert rows["Alpha Inc"].accession_number == "0001234567-26-000001" and rows["Alpha Inc"].kind == "offering"
    assert rows["Beta & Sons"].accession_number == "0001234568-26-000002" and rows["Beta & Sons"].kind == "amendment"
    assert rows["Gamma"].kind == "annual_report" and rows["Gamma"].unparsed == ["accession"] and rows["Gamma"].filing_path == ""
    assert rows["no pattern here"].unparsed == ["title", "accession"] and rows["no pattern here"].form_type == "C"
    assert {r.field for r in filings.feed_report(docs).collect()} == {"endpoint", "feed", "entry", "title", "accession"}
    live = [r.company_name for r in filings.live_raises(filings.listings(filings.feed_entries(docs)), None).collect()]
    assert set(live) == {"Alpha Inc", "Beta & Sons", "no pattern here"}


def test_skeletons_state_nothing_that_was_not_filed(spark):
    docs = spark.createDataFrame([("f", FEED)], "path string, body string")
    body = "<x><nameOfIssuer>Alpha Corp</nameOfIssuer><offeringamount>$50,000</offeringamount><price>abc</price></x>"
    offers = filings.offerings(spark.createDataFrame([("0001234567-26-000001", body)], "accession_number string, body string"))
    o = offers.first()
    assert o.offering_amount == 50000 and o.price is None and o.unparsed == ["maximumOfferingAmount"]
    deals = {r.deal_id: r for r in filings.deal_skeletons(filings.listings(filings.feed_entries(docs)), offers).collect()}
    alpha, beta = deals["edgar:0001234567-26-000001"], deals["edgar:0001234568-26-000002"]
    assert alpha.company_name == "Alpha Corp" and alpha.terms.target_raise == 50000 and alpha.terms.pre_money is None
    assert beta.unparsed == ["primary_doc"] and beta.terms.target_raise is None and deals["edgar:1234569" if "edgar:1234569" in deals else "edgar:0001234569"].founders == []
    verdicts = assess.assess(filings.deal_skeletons(filings.listings(filings.feed_entries(docs)), offers), AS_OF)
    assert {r.verdict for r in verdicts.select(F.col("verdict")).collect()} <= {"INSUFFICIENT_DATA", "ELIGIBLE_WITH_FLAGS"}


def test_pillar_scores_are_the_grouped_signals_without_an_exchange(spark):
    profiled = evidence.with_profile(queries.Inputs(spark, DIR).deals, queries.AS_OF)
    direct = evidence.pillar_scores(profiled)
    assert "Exchange" not in direct._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(df.select("deal_id", "pillar", "score", "opacity", "weight").collect())
    got, want = rows(direct), rows(evidence.pillar_rows(evidence.signal_rows(profiled)))
    assert len(got) == 6 * profiled.count() and [r[:2] for r in got] == [r[:2] for r in want]
    assert [list(r[2:]) for r in got] == [pytest.approx(list(r[2:]), abs=1e-9) for r in want]


def test_assessments_compute_only_what_a_query_takes(spark, monkeypatch):
    """Hurdles and the gate sweep need neither signal texts nor vetoes; nothing but the deals and outcomes is stored."""
    stored = []
    monkeypatch.setattr(queries, "staged", lambda df: stored.append(df.columns) or staged(df))
    monkeypatch.setattr(queries, "_INPUTS", {})
    for name in ("deal_hurdles", "gate_sweep"):
        plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "Not disclosed" not in plan and "no_advance_assurance" not in plan
    assert len(stored) == 2 and not any("vetoes" in columns for columns in stored)
