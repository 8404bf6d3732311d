"""Payload parsing, quarantine, stored tables, and streaming jobs against their batch meaning."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ebbline.sources import filings, payloads, tables
from ebbline.streaming import jobs


def bodies(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol string, body string")


def bar(day, close, **kw):
    return {"date": day, "open": close, "close": close, "volume": 5} | kw


def test_quarantine_reasons(spark):
    df = bodies(
        spark, ("ok", "[]"), ("plan", json.dumps({"Error Message": "Legacy endpoint"})), ("err", json.dumps({"Error Message": "bad symbol"})),
        ("text", "Limit Reach. Please upgrade"), ("html", "<html>"), ("cut", '[{"date": '), ("none", None), ("hist", '{"historical": []}'),
    )
    good, bad = payloads.split_quarantine(df)
    assert {r.symbol for r in good.collect()} == {"ok", "hist"}
    assert {r.symbol: r.reason for r in bad.collect()} == {
        "plan": "plan_limit", "err": "provider_error", "text": "plan_limit", "html": "not_json", "cut": "not_json", "none": "empty",
    }


def test_history_forms_and_cap(spark):
    rows = [bar(f"2024-01-{d:02d}", 100.0 + d) for d in range(20, 0, -1)]
    df = bodies(spark, ("A", json.dumps(rows)), ("A", json.dumps(rows[:8])), ("B", json.dumps({"historical": rows[:3] + [bar("2024-02-01", None)]})))
    got = payloads.history_bars(df, sessions=5).orderBy("ticker", "d").collect()
    assert [(r.ticker, r.d.day, r.c) for r in got[:5]] == [("A", d, 100.0 + d) for d in range(16, 21)]
    assert [r.d.day for r in got[5:]] == [18, 19, 20]


def test_first_item_of_each_response(spark):
    df = bodies(spark, ("A", '[{"pe": 20.5, "date": "2024-01-02"}, {"pe": 1}]'), ("B", "[]"), ("C", '{"pe": 9}'), ("D", '[{"pe": null}]'))
    assert {r.sector: (r.date, r.pe) for r in payloads.sector_pe(df).collect()} == {"A": (dt.date(2024, 1, 2), 20.5), "C": (None, 9.0)}
    good, _ = payloads.split_quarantine(df)
    plan = payloads.sector_pe(good)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_read_bodies_takes_whole_files(spark, tmp_path):
    (tmp_path / "AAA.json").write_text('[{"pe":\n 3}]')
    assert payloads.read_bodies(spark, str(tmp_path)).first().asDict() == {"symbol": "AAA", "body": '[{"pe":\n 3}]'}


def test_history_cache_writes_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        rows = [("L", dt.date(2023, 12, 28) + dt.timedelta(days=k), 1.0) for k in range(8)] + [("S", dt.date(2024, 1, 1), 1.0)]
        return spark.createDataFrame(rows, "ticker string, d date, c double")

    path = str(tmp_path / "cache")
    for _ in range(2):
        got = tables.cached_history(spark, path, build, min_history=5)
        assert {r.ticker for r in got.collect()} == {"L"} and got.columns == ["ticker", "d", "c"]
    assert calls == [1]
    tables.cached_history(spark, path, build, refresh=True, min_history=5)
    assert calls == [1, 1]


def test_appended_history_rewrites_touched_years(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "ticker string, d date, c double"
    rows = [("L", dt.date(2023, 12, 26) + dt.timedelta(days=k), float(k)) for k in range(12)]
    tables.cached_history(spark, path, lambda: spark.createDataFrame(rows, schema), min_history=5)
    files = lambda year: {str(f) for f in (tmp_path / "cache" / f"year={year}").glob("*.parquet")}
    before = files(2023), files(2024)
    tables.append_history(spark, path, spark.createDataFrame([("L", dt.date(2024, 1, 2), 99.0), ("M", dt.date(2024, 5, 1), 1.0)], schema))
    assert files(2023) == before[0] and not files(2024) & before[1]
    got = {(r.ticker, r.d): r.c for r in tables.cached_history(spark, path, None).collect()}
    assert got == {(t, d): c for t, d, c in rows} | {("L", dt.date(2024, 1, 2)): 99.0, ("M", dt.date(2024, 5, 1)): 1.0}


def test_positions(spark):
    t = dt.datetime(2024, 1, 1)
    ev = [("A", 1, "toggle", None), ("A", 2, "enter", 10.0), ("B", 1, "toggle", None), ("B", 2, "toggle", None), ("C", 1, "enter", 5.0), ("C", 2, "toggle", None),
          ("D", 1, "toggle", None), ("D", 2, "enter", 7.0), ("D", 3, "clear", None), ("E", 1, "toggle", None), ("E", 2, "enter", 3.0), ("E", 3, "toggle", None), ("E", 4, "toggle", None)]
    df = spark.createDataFrame([(k, t, n, a, p, 2.0 if p else None) for k, n, a, p in ev], "ticker string, ts timestamp, seq int, action string, entry_price double, size_pct double")
    got = {r.ticker: r.entry_price for r in tables.current_positions(df).collect()}
    assert got == {"A": 10.0, "C": None, "D": None, "E": None}


def stream(spark, folder, schema, batches, build, sink):
    """Feed files one per micro-batch, in order."""
    src = folder / "in"
    src.mkdir()
    out, check = str(folder / "out"), str(folder / "check")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{k}"))
        df = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        sink(build(df), out, check).awaitTermination()
    return spark.read.parquet(out)


def test_session_bars_with_late_ticks(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "ticker string, ts timestamp, seq long, price double, size long"
    batches = [
        [("A", at(1, 9), 1, 10.0, 1), ("A", at(1, 15), 2, 12.0, 1), ("A", at(2, 9), 3, 11.0, 1), ("A", at(1, 12), 4, -1.0, 1)],
        [("A", at(1, 10), 5, 8.0, 2), ("A", at(3, 9), 6, 9.0, 1)],  # late but within two days
        [("A", at(9, 9), 7, 9.5, 1)],
        [("A", at(1, 11), 8, 99.0, 1), ("A", at(20, 9), 9, 9.0, 1)],  # too late: dropped
    ]
    got = stream(spark, tmp_path, schema, batches, jobs.session_bars, jobs.write_available)
    first = got.filter(F.col("d") == dt.date(2024, 1, 1)).collect()
    assert [(r.o, r.h, r.l, r.c, r.v) for r in first] == [(10.0, 12.0, 8.0, 12.0, 4)]
    assert got.filter(F.col("d") == dt.date(2024, 1, 9)).count() == 1


def test_filings_once_across_batches(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    schema = "accession_number string, kind string, filed_at timestamp"
    batches = [[("1", "offering", at(1)), ("2", "update", at(1)), ("1", "offering", at(1))], [("1", "offering", at(2)), ("3", "amendment", at(2))]]
    got = stream(spark, tmp_path, schema, batches, jobs.distinct_filings, jobs.write_available)
    assert sorted(r.accession_number for r in got.collect()) == ["1", "3"]


def test_running_positions_equal_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "ticker string, ts timestamp, seq int, action string, entry_price double, size_pct double"
    batches = [[("A", t, 1, "toggle", None, None), ("B", t, 1, "toggle", None, None)], [("A", t, 2, "enter", 9.0, 1.0), ("B", t, 2, "toggle", None, None)]]
    versions = stream(spark, tmp_path, schema, batches, jobs.position_states, jobs.upsert_batches)
    got = tables.held_positions(jobs.newest_by_key(versions)).collect()
    want = tables.current_positions(spark.createDataFrame(sum(batches, []), schema)).collect()
    assert got == want and [(r.ticker, r.entry_price) for r in got] == [("A", 9.0)]


def test_staged_tables_live_in_the_shared_folder(spark, tmp_path):
    from ebbline.staging import broadcast_if_small, shared_folder, staged

    assert shared_folder(spark) == shared_folder(spark)
    df = staged(spark.range(1000))
    assert df.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark).replace("file://", ""))
    assert "ResolvedHint" in broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(df, limit=10)._jdf.queryExecution().analyzed().toString()


def test_refusals_follow_the_endpoint(spark):
    df = bodies(spark, ("name", '{"companyName":"Legacy Housing","price":3.0}'), ("said", '{"note":"Upgrade your plan"}'))
    assert {r.symbol for r in payloads.split_quarantine(df)[0].collect()} == {"name", "said"}
    assert {r.reason for r in payloads.split_quarantine(df, history=True)[1].collect()} == {"plan_limit"}


def test_full_history_and_unusable_bars(spark):
    rows = [bar(f"2024-01-{d:02d}", 100.0) for d in range(1, 21)] + [bar("2024-02-01", 0.0), bar(None, 5.0), bar("2024-02-02", None)]
    df = bodies(spark, ("A", json.dumps(rows)))
    assert payloads.history_bars(df).count() == 20
    assert sorted(r.reason for r in payloads.unusable_bars(df).collect()) == ["close_not_positive", "no_close", "no_date"]


def test_cut_off_documents_are_reported(spark):
    whole = '<?xml version="1.0"?><feed><entry><title>C - A Co (0000000001) (Filer)</title><link href="x"/></entry></feed>'
    one = whole.replace("</feed>", "")
    rows = [("a", whole), ("b", whole[:80]), ("c", "plain"), ("d", "<html></html>"), ("e", one + "<entry><title>C - B Co (00000"), ("f", None), ("g", "<!-- <entry></entry>" + whole[21:])]
    feeds = spark.createDataFrame(rows, "path string, body string")
    assert {tuple(r) for r in filings.feed_report(feeds).collect()} == {
        ("a", "accession"), ("b", "feed"), ("c", "feed"), ("d", "endpoint"), ("e", "feed"), ("e", "accession"), ("f", "feed"), ("g", "feed"),
    }
    assert [(r.path, r.title) for r in filings.feed_entries(feeds).orderBy("path").collect()] == [(p, "C - A Co (0000000001) (Filer)") for p in "ae"]
    docs = [
        ("1", "<d><nameOfIssuer><![CDATA[Acme & Co]]></nameOfIssuer><offeringAmount>5</offeringAmount><maximumOfferingAmount>9</maximumOfferingAmount></d>"),
        ("2", "<d><nameOfIssuer>B &amp; Co</nameOfIssuer><offeringAmount>5</offer"),
    ]
    got = {r.accession_number: r for r in filings.offerings(spark.createDataFrame(docs, "accession_number string, body string")).collect()}
    assert (got["1"].issuer_name, got["1"].offering_amount, got["1"].unparsed) == ("Acme & Co", 5.0, [])
    assert (got["2"].issuer_name, got["2"].offering_amount) == ("B & Co", None) and "document" in got["2"].unparsed


def test_offerings_are_read_by_schema(spark):
    """Comments, repeated and nested elements, numeric entities, prefixes, spellings, and tags in unusual places."""
    docs = {
        "comment": "<e><!-- <price>1</price> --><formData><offeringInformation><price>2</price></offeringInformation></formData></e>",
        "nested": "<e><formData><offeringInformation><price><price>3</price></price></offeringInformation></formData></e>",
        "repeated": "<e><offeringInformation><price>4</price><price>5</price></offeringInformation></e>",
        "entity": "<e><formData><issuerInformation><nameOfIssuer>A &#38; &#x42;</nameOfIssuer></issuerInformation><price>6</price></formData></e>",
        "prefix": "<f:e xmlns:f='u'><f:formData><f:offeringInformation><f:price>7</f:price></f:offeringInformation></f:formData></f:e>",
        "spelling": "<e><formdata><issuerinformation><ISSUERNAME>B</ISSUERNAME></issuerinformation><PRICE>8</PRICE></formdata></e>",
        "deep": "<e><x><y><price>9</price></y></x></e>",
        "broken": "<e><price>1</price><x></y></e>",
        "empty": "", "null": None, "cut": "<e><price>10</price><![CDATA[ <price>11</price>",
    }
    got = {r.accession_number: r for r in filings.offerings(spark.createDataFrame(list(docs.items()), "accession_number string, body string")).collect()}
    prices = {k: got[k].price for k in docs}
    assert prices == {"comment": 2, "nested": 3, "repeated": 4, "entity": 6, "prefix": 7, "spelling": 8, "deep": 9, "broken": None, "empty": None, "null": None, "cut": 10}
    assert (got["entity"].issuer_name, got["spelling"].issuer_name) == ("A & B", "B")
    assert {k for k in docs if "document" in got[k].unparsed} == {"broken", "empty", "null", "cut"}


def test_one_deal_for_each_filing(spark):
    row = ("", "", "", "2026-01-01", "C", "offering", "", "http://x/{}", [])
    rows = [(*row[:7], row[7].format(k), row[8]) for k in (1, 2, 3, 3)]
    schema = "company_name string, cik string, accession_number string, filed_at string, form_type string, kind string, filing_path string, edgar_url string, unparsed array<string>"
    listed = filings.distinct_listings(spark.createDataFrame(rows, schema))
    none = spark.createDataFrame([], "accession_number string, issuer_name string, offering_amount double, unparsed array<string>")
    deals = [r.deal_id for r in filings.deal_skeletons(listed, none).collect()]
    assert len(deals) == len(set(deals)) == 3


def test_filing_states_do_not_depend_on_batches(spark, tmp_path):
    at = lambda d: dt.datetime(2024, d, 1)
    schema = "accession_number string, kind string, filed_at timestamp"
    rows = [("1", "offering", at(9)), ("2", "amendment", at(2)), ("1", "offering", at(1)), ("3", "update", at(3)), ("4", "offering", at(1))]
    want = [("1", at(1)), ("2", at(2)), ("4", at(1))]
    for name, batches in {"one": [rows], "each": [[r] for r in rows], "back": [[r] for r in reversed(rows)]}.items():
        (tmp_path / name).mkdir()
        got = jobs.newest_by_key(stream(spark, tmp_path / name, schema, batches, jobs.filing_states, jobs.upsert_batches), "accession_number")
        assert sorted((r.accession_number, r.filed_at) for r in got.collect()) == want
