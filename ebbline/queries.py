"""Every operator as a named query over the driver tables.

Derived input tables and the two shared results (observations, analyses) are staged once per session and data
folder; each query then reads them like any stored table.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline import fixtures, fixtures_sql
from ebbline.config import INDEX_PROXIES, PILLAR_WEIGHTS, HurdleTerms, TaxProfile, WalkForwardConfig
from ebbline.functions import raises, scalar
from ebbline.functions.scalar import rounded
from ebbline.operators import decompose, evidence, factors, outcomes, ranking, scoring, screen, technicals
from ebbline.operators.asof import as_of
from ebbline.plans import assess, live, research, walkforward
from ebbline.session import spread, tuned
from ebbline.sources import filings, payloads, tables
from ebbline.staging import shared_folder, staged
from ebbline.streaming import jobs, rescore

HORIZONS = (5, 20, 60)
CONFIG = WalkForwardConfig(horizons=HORIZONS, min_history=200, require_dip=False)
FALLS = WalkForwardConfig(horizons=HORIZONS, min_history=200)
AS_OF = "2026-07-01"
TERMS = HurdleTerms()
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "pages")

_INPUTS: dict[tuple, "Inputs"] = {}


def publish(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Select columns with doubles rounded and integers widened, the form results are compared in."""
    df = df.select(*columns) if columns else df
    kinds = dict(df.dtypes)
    return df.select(
        *[
            rounded(c, digits).alias(c) if kinds[c] in ("double", "float")
            else F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "bigint", "smallint")
            else F.col(c)
            for c in df.columns
        ]
    )


class Inputs:
    """Derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tuned(spark), sf_dir.rstrip("/")

    def sql(self, text: str) -> DataFrame:
        for name in TABLES:
            self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return self.spark.sql(text)

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    @cached_property
    def bars(self) -> DataFrame:
        return staged(fixtures.capped_bars(self.spark, self.sf_dir))

    @cached_property
    def edges(self) -> DataFrame:
        return staged(fixtures.peer_edges(self.spark, self.sf_dir))

    @cached_property
    def technicals(self) -> DataFrame:
        return staged(technicals.technicals(self.bars))

    @cached_property
    def as_of_rows(self) -> DataFrame:
        return staged(walkforward.as_of_decompositions(self.bars, self.edges, CONFIG)[0])

    @cached_property
    def observations(self) -> DataFrame:
        axis = walkforward.panel.date_axis(self.bars)
        return staged(walkforward.observe(self.as_of_rows, self.bars, axis, FALLS))

    @cached_property
    def long_observations(self) -> DataFrame:
        return walkforward.long_observations(self.observations, HORIZONS)

    @cached_property
    def overlay(self) -> DataFrame:
        return self.sql(fixtures_sql.OVERLAY).drop("k")

    @cached_property
    def analyses(self) -> DataFrame:
        side = {k: self.sql(getattr(fixtures_sql, k)) for k in ("PROFILE", "RATIOS", "METRICS", "SECTOR_PE")}
        return staged(
            live.analyses(
                self.bars.drop("market_cap_b"), self.edges, self.overlay, side["PROFILE"], side["RATIOS"],
                side["METRICS"], side["SECTOR_PE"],
            )
        )

    @cached_property
    def position_events(self) -> DataFrame:
        return self.sql(fixtures_sql.POSITION_EVENTS)

    @cached_property
    def deals(self) -> DataFrame:
        f = self.sql(fixtures_sql.FOUNDERS)
        fields = ("name", "domain_years", "prior_founder", "prior_exit", "full_time", "insolvency_count")
        packed = f.groupBy("deal_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("f")))).alias("fs"))
        flat = self.sql(fixtures_sql.DEALS).join(packed, "deal_id", "left")
        c = F.col
        pick = lambda part, *names: {n: c(n) for n in names}
        registry = filings.record(
            "registry", company_number=c("deal_id"), source=F.lit("registry"),
            **pick("", "incorporated_on", "filing_health", "accounts_overdue", "confirmation_overdue", "outstanding_charges", "active_directors"),
        )
        names = F.transform(F.sequence(F.lit(1), c("n_co_investors")), lambda i: F.concat(F.lit("Investor "), i.cast("string")))
        return staged(
            spread(flat, "deal_id").select(
                "deal_id", "k", "company_name", "country", "platform", "sector", "stage",
                F.coalesce(F.transform("fs", lambda x: x["f"]), F.array()).cast(filings.DEAL_PARTS["founders"]).alias("founders"),
                filings.record("traction", **pick("", "revenue_ltm", "revenue_growth_pct", "gross_margin_pct", "runway_months", "ltv_cac", "churn_pct_monthly")).alias("traction"),
                filings.record("terms", **pick("", "pre_money", "share_class", "has_preemption_rights", "has_information_rights", "has_voting_rights", "tax_wrapper", "nominee_structure", "founder_retained_pct")).alias("terms"),
                F.when(c("has_registry"), registry).alias("registry"),
                filings.record(
                    "network", named_co_investors=F.when(c("n_co_investors") > 0, names).when(c("n_co_investors") == 0, F.array()),
                    **pick("", "has_professional_lead", "investor_count", "founder_accessible", "sector_adjacency", "syndicate_access"),
                ).alias("network"),
            )
        )

    @cached_property
    def deal_segments(self) -> DataFrame:
        deal = F.concat(F.lit("deal:"), F.col("c_custkey").cast("string"))
        return self.table("customer").select(deal.alias("deal_id"), F.col("c_mktsegment").alias("dist_id"))

    @cached_property
    def portfolios(self) -> DataFrame:
        return staged(outcomes.portfolios(self.sql(fixtures_sql.POSITIONS), outcomes.net_of("SEIS", TaxProfile())))

    @cached_property
    def assessed(self) -> DataFrame:
        """A projection of the deals, not stored: each query computes only the columns that it takes."""
        return assess.assess(self.deals, AS_OF, TERMS)

    @cached_property
    def outcomes(self) -> DataFrame:
        return staged(self.sql(fixtures_sql.OUTCOMES))

    @cached_property
    def filing_rows(self) -> DataFrame:
        return self.sql(fixtures_sql.FILINGS)

    @cached_property
    def feeds(self) -> DataFrame:
        """Atom documents of twenty entries each; every tenth feed is an HTML page, one entry in 23 has no link."""
        esc = F.replace("title", F.lit("&"), F.lit("&amp;"))
        link = F.when(F.col("k") % 23 != 0, F.format_string('<link rel="alternate" href="%s"/>', F.col("href"))).otherwise("")
        entry = F.concat(F.lit("<entry><title>"), esc, F.lit("</title>"), link, F.lit("<updated>"), F.col("updated"), F.lit("</updated></entry>"))
        grouped = self.filing_rows.withColumns({"g": F.floor(F.col("k") / 20), "e": entry}).groupBy("g").agg(
            F.array_join(F.array_sort(F.collect_list("e")), "").alias("es")
        )
        atom = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Latest</title>'), "es", F.lit("</feed>"))
        html = F.lit("<!doctype html><html><body>app</body></html>")
        return grouped.select(F.concat(F.lit("feed-"), F.col("g").cast("string")).alias("path"), F.when(F.col("g") % 10 == 9, html).otherwise(atom).alias("body"))

    @cached_property
    def offering_documents(self) -> DataFrame:
        """One primary document per supplier with the tag spellings and gaps a parser has to live with."""
        s = self.table("supplier")
        k, bal = F.col("s_suppkey"), F.abs("s_acctbal")
        part = lambda cond, text: F.when(cond, text).otherwise("")
        ns = F.when(k % 11 == 5, "f:").otherwise("")
        price = F.format_string("<price>%d.25</price>", k % 50)
        body = F.concat(
            F.lit("<?xml version='1.0'?><edgarSubmission xmlns:f='urn:form'><"), ns, F.lit("formData><"), ns, F.lit("issuerInformation>"),
            F.when(k % 10 == 6, F.concat(F.lit("<nameOfIssuer>"), "s_name", F.lit(" &#38; &#x43;o</nameOfIssuer>")))
            .when(k % 4 == 2, F.concat(F.lit("<nameOfIssuer><![CDATA["), "s_name", F.lit(" & Co]]></nameOfIssuer>")))
            .when(k % 2 == 0, F.concat(F.lit("<nameOfIssuer>"), "s_name", F.lit(" &amp; Co</nameOfIssuer>")))
            .when(k % 4 == 1, F.concat(F.lit("<issuername>"), "s_name", F.lit("</issuername>"))).otherwise(""),
            part(k % 3 == 0, F.lit("<jurisdictionOrganization>DE</jurisdictionOrganization>")),
            F.lit("</"), ns, F.lit("issuerInformation>"), part(k % 8 == 3, F.lit("<!-- <price>1.00</price> </formData> -->")), F.lit("<offeringInformation>"),
            F.when(k % 5 == 0, "").when(k % 5 == 1, "<offeringAmount>n/a</offeringAmount>")
            .when(k % 5 == 2, F.format_string("<offeringamount> $%,d </offeringamount>", F.floor(bal * 10)))
            .otherwise(F.format_string("<offeringAmount>%d.50</offeringAmount>", F.floor(bal * 10))),
            part(k % 4 != 0, F.format_string("<maximumOfferingAmount>%d</maximumOfferingAmount>", F.floor(bal * 100))),
            F.when(k % 2 == 0, "<securityOfferedType>Common Stock</securityOfferedType>").otherwise("<typeOfSecurityOffered>SAFE</typeOfSecurityOffered>"),
            part(k % 6 != 0, F.when(k % 9 == 4, F.concat(F.lit("<price>"), price, F.lit("</price>"))).when(k % 9 == 5, F.concat(F.lit("<terms><unit>"), price, F.lit("</unit></terms>"))).otherwise(price)),
            part(k % 7 != 0, F.lit("<deadlineDate>12-31-2026</deadlineDate>")),
            F.lit("</offeringInformation></"), ns, F.lit("formData></edgarSubmission>"),
        )
        acc = F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-26-000001"))
        return s.select(acc.alias("accession_number"), body.alias("body"), "s_suppkey")


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _INPUTS:
        _INPUTS[key] = Inputs(spark, sf_dir)
    return _INPUTS[key]


QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(inputs(spark, sf_dir))
    return fn


# --- sources ------------------------------------------------------------------------------------------------


def _json_body(df: DataFrame, key: str, cols: dict[str, str]) -> DataFrame:
    item = F.to_json(F.struct(*[F.col(v).alias(k) for k, v in cols.items()]))
    return df.select(F.col(key).alias("symbol"), F.concat(F.lit("["), item, F.lit("]")).alias("body"))


@query
def history_bars(i):
    item = F.struct(F.col("d").alias("date"), F.col("o").alias("open"), F.col("c").alias("close"), F.col("v").alias("volume"))
    rows = F.reverse(F.array_sort(F.collect_list(item)))
    text = i.bars.groupBy("ticker").agg(F.to_json(rows).alias("j"))
    nested = F.concat(F.lit('{"historical":'), "j", F.lit("}"))
    bodies = text.select(F.col("ticker").alias("symbol"), F.when(F.length("ticker") % 2 == 0, F.col("j")).otherwise(nested).alias("body"))
    good, _ = payloads.split_quarantine(bodies, history=True)
    return publish(payloads.history_bars(good), "ticker", "d", "o", "c", "v")


@query
def bar_quarantine(i):
    """Every order as a bar: some without a date, some without a close, some closing at 0."""
    k = F.col("o_orderkey")
    item = F.struct(
        F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("date"), F.when(k % 13 == 0, 0.0).when(k % 7 != 0, F.col("o_totalprice")).alias("close")
    )
    bodies = i.table("orders").select(F.concat(F.lit("ORDER_"), k.cast("string")).alias("symbol"), F.to_json(F.array(item)).alias("body"))
    good, _ = payloads.split_quarantine(bodies, history=True)
    return payloads.unusable_bars(good).groupBy("reason").agg(F.count("*").alias("bars"), F.min("ticker").alias("first_ticker"), F.max("ticker").alias("last_ticker"))


@query
def company_profiles(i):
    """Responses written as one file each and read back from there."""
    bodies = _json_body(i.sql(fixtures_sql.PROFILE), "ticker", payloads.PROFILE_NAMES | {"exchange": "ticker"})
    cols = ["ticker", "company_name", "quote_price", "market_cap", "beta", "volume", "average_volume", "change_pct", "profile_sector", "profile_industry"]
    folder = f"{shared_folder(i.spark)}/profiles-{uuid.uuid4().hex}"
    bodies.write.partitionBy("symbol").text(folder)
    df = payloads.profiles(payloads.read_bodies(i.spark, folder)).withColumn("market_cap", F.col("market_cap") / 1e9)
    return publish(df, *cols)


@query
def ttm_ratios(i):
    return publish(payloads.ratios(_json_body(i.sql(fixtures_sql.RATIOS), "ticker", payloads.RATIOS_NAMES)))


@query
def ttm_key_metrics(i):
    return publish(payloads.key_metrics(_json_body(i.sql(fixtures_sql.METRICS), "ticker", payloads.METRICS_NAMES)))


@query
def sector_pe_lookup(i):
    """Each order with the newest P/E snapshot of its customer's region that is not later than the order."""
    snapshots = payloads.sector_pe(_json_body(i.sql(fixtures_sql.SECTOR_PE), "sector", {"date": "date", "pe": "pe"}))
    place = i.table("nation").join(i.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("sector"))
    buyers = i.table("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "sector")
    orders = i.table("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "sector", F.to_date("o_orderdate").alias("d"))
    return publish(as_of(orders, snapshots, ["sector"], "d", "date", {"pe": "pe", "snapshot": "date"}, salts=16))


@query
def index_strip(i):
    """Every order as a quote response; the newest of each index proxy counts."""
    k = F.col("o_orderkey")
    symbols = F.element_at(F.array(*[F.lit(s) for s in (*INDEX_PROXIES, "OTHER")]), (k % 5 + 1).cast("int"))
    quotes = i.table("orders").select(
        symbols.alias("symbol"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), (F.col("o_custkey") % 21 / 10.0 - 1.0).alias("change"),
        (F.datediff("o_orderdate", F.lit("1970-01-01")) * F.lit(10_000_000_000) + k).alias("at"),
    )
    bodies = _json_body(quotes, "symbol", {"price": "price", "changePercentage": "change", "timestamp": "at"})
    good, _ = payloads.split_quarantine(bodies)
    proxies = i.spark.createDataFrame(list(INDEX_PROXIES.items()), "symbol string, label string")
    return publish(screen.latest_quotes(payloads.quotes(good), proxies))


@query
def payload_quarantine(i):
    """Every document's whole text as a response: well-formed, as an error message, cut off, as a name, or bare."""
    k, text = F.col("doc_id"), F.col("text")
    body = (
        F.when(k % 5 == 0, F.to_json(F.array(F.struct(text.alias("note")))))
        .when(k % 5 == 1, F.to_json(F.struct(text.alias("Error Message"))))
        .when(k % 5 == 2, F.concat(F.lit('[{"note": "'), text))
        .when(k % 5 == 3, F.to_json(F.struct(F.concat(F.lit("Legacy "), text).alias("companyName"))))
        .otherwise(text)
    )
    judged = payloads.judged(i.table("documents").select("doc_id", body.alias("body")))
    return judged.groupBy("reason").agg(F.count("*").alias("bodies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query
def overlay_peers(i):
    """Overlay written as JSON and read back through its source; peers exploded to edges."""
    peers = i.edges.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "peer"))), lambda x: x["peer"]).alias("peers"))
    o = i.overlay.join(peers, "ticker").select(
        "ticker", "name", F.col("overlay_sector").alias("sector"), F.col("overlay_industry").alias("industry"),
        F.struct(F.col("catalyst_type").alias("type"), F.col("catalyst_severity").alias("severity"), F.col("catalyst_transience").alias("transience")).alias("catalyst"),
        "moat", F.col("balance_sheet").alias("balanceSheet"), F.col("pe_5y_avg").alias("pe5yAvg"), "peers",
    )
    path = f"{shared_folder(i.spark)}/overlay-{uuid.uuid4().hex}"
    o.write.json(path)
    read = tables.read_overlay(i.spark, path)
    joined = tables.peer_edges(read).join(read.select("ticker", "moat", "catalyst_type", "pe_5y_avg"), "ticker")
    return publish(joined, "ticker", "pos", "peer", "moat", "catalyst_type", "pe_5y_avg")


@query
def history_cache(i):
    path = f"{shared_folder(i.spark)}/history-{uuid.uuid4().hex}"
    bars = tables.cached_history(i.spark, path, lambda: i.bars, min_history=356)
    return bars.groupBy("ticker").agg(F.count("*").alias("sessions"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


@query
def filing_listings(i):
    """Feeds written as one file each and read back from there."""
    cols = ["company_name", "cik", "accession_number", "filed_at", "form_type", "kind", "filing_path", "edgar_url"]
    folder = f"{shared_folder(i.spark)}/feeds-{uuid.uuid4().hex}"
    i.feeds.write.partitionBy("path").text(folder)
    rows = filings.listings(filings.feed_entries(filings.read_documents(i.spark, folder)))
    return rows.select(*cols, F.array_join("unparsed", ",").alias("unparsed"))


@query
def feed_report(i):
    """The feeds, and each of them once more cut off after two thirds."""
    half = F.substring("body", F.lit(1), (F.length("body") * 2 / 3).cast("int"))
    cut = i.feeds.select(F.concat("path", F.lit("-cut")).alias("path"), half.alias("body"))
    return filings.feed_report(i.feeds.unionByName(cut))


@query
def live_raises(i):
    return filings.live_raises(filings.listings(filings.feed_entries(i.feeds))).select("company_name", "cik", "accession_number", "filed_at", "kind")


@query
def form_kinds(i):
    rows = i.filing_rows.select(F.regexp_extract("title", filings.TITLE, 1).alias("form_type"))
    return rows.withColumn("kind", filings.form_kind(F.col("form_type"))).groupBy("form_type", "kind").agg(F.count("*").alias("filings"))


@query
def offering_terms(i):
    df = filings.offerings(i.offering_documents)
    return publish(df.withColumn("unparsed", F.array_join("unparsed", ",")))


@query
def deal_skeletons(i):
    rows = filings.listings(filings.feed_entries(i.feeds))
    df = filings.deal_skeletons(rows, filings.offerings(i.offering_documents))
    return publish(
        df.select(
            "deal_id", "company_name", "country", F.col("terms.target_raise").alias("target_raise"),
            F.col("terms.tax_wrapper").alias("tax_wrapper"), F.col("terms.pre_money").alias("pre_money"),
            F.size("founders").alias("founders"), F.col("registry.company_number").alias("company_number"),
            F.array_join("unparsed", ",").alias("unparsed"),
        )
    )


@query
def filing_assessments(i):
    """Filings end to end: feed, offering, deal, verdict."""
    rows = filings.listings(filings.feed_entries(i.feeds))
    deals = filings.deal_skeletons(rows, filings.offerings(i.offering_documents))
    return publish(assess.assess(deals, AS_OF, TERMS), "deal_id", "verdict", "evidence_score", "opacity_index", "network_band")


@query
def deal_listings(i):
    """Every deal with the filing it came from; all filings are listed by two feeds."""
    rows = filings.listings(filings.feed_entries(i.feeds.unionByName(i.feeds)))
    deals = filings.deal_skeletons(filings.distinct_listings(rows), filings.offerings(i.offering_documents))
    return deals.select("deal_id", F.array_join("unparsed", ",").alias("unparsed"), "form_type", F.col("discovered_at").alias("filed_at"), "filing_path")


@query
def positions_current(i):
    return publish(tables.current_positions(i.position_events))


# --- technicals -----------------------------------------------------------------------------------------------


def _tech(name, *cols):
    def run(i):
        return publish(i.technicals, "ticker", "d", *cols)

    run.__name__ = name
    query(run)


_tech("returns", "ret", "log_ret", "dip_pct_day", "dip_pct_week")
_tech("moving_averages", "sma50", "sma200")
_tech("rsi", "rsi14")
_tech("trailing_range", "high_52w", "low_52w", "drawdown_pct", "range_position")
_tech("volatility", "realized_vol_pct", "atr_pct", "dip_z")
_tech("price_levels", "support_defined", "support_level", "resistance_level")
_tech("overnight_share", "gap_share")
_tech("volume_ratios", "avg_volume", "volume_ratio")


@query
def sparkline(i):
    return publish(technicals.tail(i.bars, 40), "ticker", "age", "c", "y", "rising")


@query
def chart_domains(i):
    points = technicals.tail(i.bars, 252)
    plan = i.analyses.select("ticker", scoring.published("stop").alias("published_stop"), scoring.published("target2").alias("published_target2"))
    return publish(technicals.chart_domain(points, plan))


# --- factors and decomposition --------------------------------------------------------------------------------


@query
def session_axis(i):
    return publish(walkforward.panel.date_axis(i.bars), "d", "di")


@query
def market_factor(i):
    return publish(factors.factor_series(i.bars.withColumn("weight", factors.member_weight("market_cap_b"))))


@query
def sector_factors(i):
    return publish(factors.factor_series(i.bars.withColumn("weight", F.lit(1.0)), ["sector"]))


@query
def aligned_factor(i):
    f = factors.factor_series(i.bars.withColumn("weight", F.lit(1.0)))
    return publish(factors.align_to(i.bars.select("ticker", "d"), f), "ticker", "d", "aligned")


@query
def shared_sessions(i):
    """Sessions every name has (the calendar factors live on); one count per session decides."""
    per = i.bars.groupBy("d").agg(F.count("*").alias("names"))
    size = i.bars.groupBy("ticker").agg(F.lit(1).alias("one")).agg(F.count("*").alias("names"))
    return per.join(size, "names").select("d", "names")


@query
def ols_betas(i):
    """Slope, correlation and moments of each name's log return on the market factor's."""
    f = factors.factor_series(i.bars.withColumn("weight", F.lit(1.0))).select("d", F.col("ret").alias("rm"))
    j = i.technicals.join(f, "d").filter(F.col("log_ret").isNotNull() & F.col("rm").isNotNull())
    slope = scalar.ratio(F.covar_pop("log_ret", "rm"), F.var_pop("rm"))
    return publish(
        j.groupBy("ticker").agg(
            F.count("*").alias("n"), F.coalesce(slope, F.lit(0.0)).alias("beta"),
            F.when(F.count("*") >= 3, F.coalesce(F.corr("log_ret", "rm"), F.lit(0.0))).otherwise(0.0).alias("pearson"),
            (F.var_pop("log_ret") * 10000).alias("variance_bp"),
        )
    )


DECOMPOSITION = ("cause", "total_pct", "market_pct", "sector_pct", "idio_pct", "systematic_share", "beta_market",
                 "beta_sector", "residual_z", "gap_share", "confidence")


@query
def decompositions(i):
    return publish(i.as_of_rows, "ticker", "as_of", *DECOMPOSITION)


@query
def decomposition_shares(i):
    parts = {f"{p}_share": decompose.share_of_total(f"{p}_pct") for p in ("market", "sector", "idio")}
    return publish(i.as_of_rows.select("ticker", "as_of", decompose.cause_label().alias("label"), *[v.alias(k) for k, v in parts.items()]))


@query
def cause_notes(i):
    return i.as_of_rows.select("ticker", "as_of", "cause", decompose.cause_note().alias("note"))


@query
def point_in_time_snapshots(i):
    return publish(i.as_of_rows, "ticker", "as_of", "price", "dip_pct_day", "dip_pct_week", "volume_ratio", "rsi14", "sma50", "sma200", "support_level", "dip_z")


@query
def point_in_time_analyses(i):
    """Full scoring of every as-of row with the authored overlay."""
    scored = scoring.analyze(walkforward.with_overlay(i.as_of_rows, i.overlay))
    return publish(
        scored, "ticker", "as_of", "name", *[f"{p}_score" for p in PILLAR_WEIGHTS], "signal_score", "overlay_score", "dip_score",
        "verdict", "conviction", "stop", "target1", "suggested_size_pct",
    )


# --- live screen ----------------------------------------------------------------------------------------------

SNAPSHOT = ("sector", "name", "industry", "market_cap_b", "price", "dip_pct_day", "dip_pct_week", "beta", "avg_volume_m",
            "volume_ratio", "pe_forward", "sector_pe", "ev_to_ebitda", "fcf_yield_pct", "gross_margin_pct", "op_margin_pct",
            "roic_pct", "net_debt_to_ebitda")


@query
def live_snapshot(i):
    return publish(i.analyses, "ticker", *SNAPSHOT)


@query
def live_admission(i):
    return publish(live.admitted(live.newest_sessions(i.bars)).groupBy("ticker").agg(F.count("*").alias("sessions")))


@query
def live_decomposition(i):
    return publish(i.analyses, "ticker", "as_of", *DECOMPOSITION)


@query
def pillar_scores(i):
    return publish(i.analyses, "ticker", *[f"{p}_score" for p in PILLAR_WEIGHTS], "signal_score", "overlay_score", "dip_score")


@query
def pillar_scores_long(i):
    return publish(scoring.pillar_rows(i.analyses, ["ticker"]))


@query
def verdicts(i):
    return publish(i.analyses, "ticker", "verdict", "conviction", "is_dip")


@query
def trade_plans(i):
    return publish(i.analyses, "ticker", "entry_low", "entry_high", "stop", "target1", "target2", "risk_reward",
                   "win_probability_pct", "expected_value_pct", "suggested_size_pct", "max_risk_pct", "horizon")


@query
def published_plans(i):
    return publish(i.analyses.select("ticker", *[scoring.published(x).alias(x) for x in ("entry_low", "entry_high", "stop", "target1", "target2")]))


@query
def risk_flags(i):
    return i.analyses.select("ticker", F.posexplode(scoring.risk_flags()).alias("pos", "flag")).withColumn("pos", F.col("pos").cast("bigint"))


@query
def theses(i):
    notes = scoring.pillar_notes()
    return i.analyses.select("ticker", scoring.thesis().alias("thesis"), *[v.alias(k) for k, v in notes.items()])


@query
def highlights(i):
    return publish(i.analyses.select("ticker", *[v.alias(k) for k, v in scoring.highlights().items()], *[v.alias(k) for k, v in scoring.distances().items()], scalar.score_band("signal_score").alias("band")))


@query
def display_formats(i):
    a = i.analyses
    return a.select(
        "ticker", scalar.price_text(F.col("price")).alias("price"), scalar.pct_text(F.col("dip_pct_week")).alias("week"),
        scalar.cap_text(F.col("market_cap_b")).alias("cap"), scalar.times_text(F.col("sector_pe")).alias("sector_pe"),
        F.lower(F.regexp_replace("verdict", "_", " ")).alias("verdict"),
    )


SCREEN = ("ticker", "sector", "verdict", "signal_score", "dip_pct_day", "dip_pct_week", "market_cap_b")


def _screen(name, **kw):
    def run(i):
        return publish(screen.screen(i.analyses, **kw), *SCREEN)

    run.__name__ = name
    query(run)


_screen("screen_by_score")
_screen("screen_by_day", sort="day")
_screen("screen_by_cap_in_sector", sort="cap", sector="ASIA")
_screen("screen_watchlist_by_week", sort="week", verdict="WATCHLIST")


@query
def ranked_analyses(i):
    return publish(i.analyses.orderBy(F.col("signal_score").desc(), "ticker"), *SCREEN)


@query
def ticker_lookup(i):
    return publish(screen.point_lookup(i.analyses, "nation_7"), *SCREEN)


@query
def top_buys(i):
    return publish(screen.top_of(i.analyses, ("BUY_THE_DIP",), 3), "ticker", "signal_score")


@query
def top_knives(i):
    return publish(screen.top_of(i.analyses, ("FALLING_KNIFE", "AVOID"), 4), "ticker", "signal_score")


@query
def breadth(i):
    return publish(screen.breadth(i.analyses))


@query
def verdict_facets(i):
    return publish(screen.verdict_facets(i.analyses))


@query
def sector_facets(i):
    return screen.sectors(i.analyses)


@query
def covered_peers(i):
    return publish(screen.covered_peers(i.analyses, i.edges))


@query
def positions_open(i):
    rows = screen.position_rows(tables.current_positions(i.position_events), i.analyses)
    return publish(rows, "ticker", "entry_price", "size_pct", "price", "pnl_pct", "published_stop", "published_target1")


@query
def positions_uncovered(i):
    held = tables.current_positions(i.position_events)
    return screen.uncovered_positions(held, i.analyses, i.overlay).select("ticker", "name")


@query
def positions_pnl(i):
    return publish(screen.open_pnl(screen.position_rows(tables.current_positions(i.position_events), i.analyses)))


# --- walk-forward ---------------------------------------------------------------------------------------------


@query
def walk_forward_observations(i):
    return publish(i.observations, "ticker", "as_of", "signal_score", "catalyst_score", "dip_character_score", "technical_score", "cause", "dip_pct_week", *[f"fwd_{h}" for h in HORIZONS])


@query
def supplier_walk_forward(i):
    """The walk-forward at a grain that grows with the data: a name per supplier, a session per month, with late listings
    and exits."""
    cfg = WalkForwardConfig(horizons=(1, 3), min_history=40, require_dip=False)
    obs = walkforward.observations(fixtures.supplier_bars(i.spark, i.sf_dir), fixtures.supplier_edges(i.spark, i.sf_dir), cfg)
    return publish(obs, "ticker", "as_of", "cause", "confidence", "total_pct", "market_pct", "beta_market", "fwd_1", "fwd_3")


@query
def forward_returns(i):
    return publish(i.long_observations, "ticker", "as_of", "horizon", "fwd_ret")


@query
def horizon_metrics(i):
    return publish(research.horizon_metrics(i.long_observations))


@query
def cause_metrics(i):
    return publish(research.means_by(i.observations, ["cause"], HORIZONS))


@query
def report_lines(i):
    return publish(research.report_lines(i.observations, i.long_observations, HORIZONS))


@query
def market_index(i):
    """The chain-linked index of all suppliers, with late listings and exits, and its regimes against 24 months."""
    bars = fixtures.supplier_bars(i.spark, i.sf_dir).withColumn("weight", factors.member_weight("market_cap_b"))
    index = factors.chain_index(bars).join(research.regimes(bars, 24), "d")
    return publish(index, "d", "names", "level", "regime")


@query
def regime_split(i):
    obs = research.with_regime(i.observations, i.bars.withColumn("weight", factors.member_weight("market_cap_b")))
    return publish(research.means_by(obs, ["regime"], HORIZONS))


@query
def regime_by_cause(i):
    obs = research.with_regime(i.observations, i.bars.withColumn("weight", factors.member_weight("market_cap_b")))
    return publish(research.means_by(obs, ["regime", "cause"], HORIZONS))


FEATURES = ("catalyst_score", "dip_character_score", "technical_score", "dip_z", "volume_ratio", "rsi14", "dip_pct_week", "drawdown_pct")


@query
def feature_ic(i):
    return publish(research.feature_ic(i.long_observations, list(FEATURES)))


@query
def ic_by_year(i):
    return publish(research.by_year(i.long_observations))


@query
def ic_by_half(i):
    return publish(research.by_half(i.long_observations))


@query
def score_buckets(i):
    return publish(research.score_buckets(i.observations, HORIZONS))


@query
def score_distribution(i):
    return publish(research.score_distribution(i.observations))


@query
def buy_grade_by_cause(i):
    return publish(research.buy_grade_by_cause(i.observations))


@query
def buy_clustering(i):
    return publish(research.buy_clustering(i.observations))


@query
def buy_grade_vs_rest(i):
    return publish(research.buy_grade_vs_rest(i.observations, HORIZONS))


@query
def return_quantiles(i):
    return publish(ranking.floor_quantiles(i.long_observations, ["horizon"], "fwd_ret", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


@query
def order_value_quantiles(i):
    """Floor quantiles and rank correlation on a large skewed column: order values by priority."""
    o = i.table("orders").withColumn("day_no", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("double"))
    q = ranking.floor_quantiles(o, ["o_orderpriority"], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    ic = ranking.rank_correlation(o, ["o_orderpriority"], "day_no", "o_totalprice")
    return publish(q.join(ic, "o_orderpriority"))


@query
def gate_sweep(i):
    """Sweep the tilt strength over all deals: where do the evidence gate and the edge gate disagree?"""
    buckets = i.outcomes.groupBy("dist_id").agg(F.collect_list(F.struct("multiple", "p")).alias("buckets"))
    rows = i.assessed.select("deal_id", "evidence_score").join(i.deal_segments, "deal_id").join(buckets, "dist_id")
    z = scalar.clamp((F.col("evidence_score") - 50.0) / 50.0, -1, 1)
    weight = lambda b: b["p"] * F.exp(z * F.col("strength") * F.ln(b["multiple"] + 1.0))
    fold = lambda f: F.aggregate("buckets", F.lit(0.0), lambda acc, b: acc + f(b))
    value = lambda b: raises.net_multiple(b["multiple"], F.lit("SEIS"), F.lit(0.0), F.lit(0.0), TaxProfile())
    edge = raises.edge_vs_index(fold(lambda b: weight(b) * value(b)) / fold(weight), TERMS.years, TERMS.index_return)
    grid = F.array(*[F.lit(x) for x in (0.0, 0.35, 0.7)])
    hits = research.gate_sweep(rows, grid, "strength", F.col("evidence_score") >= 46, edge >= 1.25)
    return publish(
        hits.groupBy("strength", "gate_a", "gate_b").agg(
            F.count("*").alias("deals"), F.min("evidence_score").alias("lowest"), F.max("evidence_score").alias("highest")
        )
    )


# --- private raises -------------------------------------------------------------------------------------------


@query
def evidence_signals(i):
    rows = evidence.signal_rows(i.assessed)
    return publish(rows, "deal_id", "pillar", "code", "value", "weight", "missing", "provenance", digits=6)


@query
def evidence_pillars(i):
    return publish(evidence.pillar_scores(i.assessed), digits=6)


@query
def evidence_scores(i):
    return publish(evidence.deal_rows(evidence.pillar_rows(evidence.signal_rows(i.assessed))), digits=6)


@query
def founder_rollups(i):
    f = F.col("founders")
    repeat = F.get(F.filter(f, lambda x: x["insolvency_count"] >= 2), F.lit(0))["name"]
    return publish(
        i.deals.select(
            "deal_id", F.size(f).alias("founders"), F.array_max(F.transform(f, lambda x: x["domain_years"])).alias("best_years"),
            F.size(F.filter(f, lambda x: F.coalesce(x["prior_exit"], F.lit(False)))).alias("exits"),
            F.aggregate(f, F.lit(0), lambda a, x: a + x["insolvency_count"]).alias("insolvencies"),
            repeat.alias("first_repeat"),
        )
    )


@query
def revenue_multiples(i):
    return publish(i.deals.select("deal_id", evidence.revenue_multiple().alias("revenue_multiple")))


@query
def deal_vetoes(i):
    return i.assessed.select("deal_id", F.inline("vetoes")).select("deal_id", "code", "hard")


@query
def deal_verdicts(i):
    return publish(i.assessed, "deal_id", "verdict", "evidence_score", "opacity_index", digits=6)


@query
def network_ratings(i):
    return publish(i.assessed, "deal_id", "network_band", "network_score")


@query
def assessment_order(i):
    return publish(assess.in_display_order(i.assessed), "deal_id", "verdict", "opacity_index", digits=6)


@query
def deal_narratives(i):
    return i.assessed.select("deal_id", F.size("rationale").cast("bigint").alias("lines"), F.array_join("rationale", " ").alias("rationale"), F.array_join("network_reasons", "; ").alias("network"))


@query
def research_tasks(i):
    return publish(evidence.research_tasks(i.assessed), "deal_id", "rank", "code", "task")


@query
def deal_hurdles(i):
    return publish(
        i.assessed.withColumn("notes", F.array_join("hurdle_notes", ",")), "deal_id", "index_multiple", "hurdle_multiple",
        "breakeven_multiple", "net_cost_fraction", "downside_multiple", "notes",
    )


@query
def hurdle_scenarios(i):
    """Every deal's platform under each wrapper, horizon, liability and premium; parameters are expanded per row."""
    each = lambda *xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    df = i.deals.select("deal_id", "platform").withColumn("wrapper", each("SEIS", "EIS", "NONE"))
    df = df.withColumn("years", each(2.0, 8.0)).withColumn("liability", each(True, False)).withColumn("premium", each(0.0, 0.04))
    df = df.withColumns(raises.hurdle_columns(F.col("wrapper"), F.col("platform"), TERMS, F.col("years"), F.col("liability"), F.col("premium")))
    return publish(
        df.groupBy("platform", "wrapper", "years", "liability", "premium").agg(
            F.count("*").alias("deals"), F.max("hurdle_multiple").alias("hurdle"), F.max("breakeven_multiple").alias("breakeven"),
            F.max("downside_multiple").alias("downside"), F.max("net_cost_fraction").alias("net_cost"), F.max("index_multiple").alias("index_multiple"),
        )
    )


@query
def net_multiples(i):
    each = lambda *xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    df = i.outcomes.withColumn("wrapper", each("SEIS", "EIS", "NONE")).withColumn("platform", each("Crowdcube", "seedrs", "startengine", "none"))
    value = raises.net_multiple(F.col("multiple"), F.col("wrapper"), raises.investment_fee(F.col("platform")), raises.carry(F.col("platform")), TaxProfile())
    return publish(df.select("dist_id", "multiple", "wrapper", "platform", value.alias("net")))


@query
def outcome_expectations(i):
    net = outcomes.net_of("SEIS", TaxProfile())
    df = outcomes.expectations(i.outcomes, ["dist_id"], (0.0, 1.0), net)
    return publish(df.withColumn("edge", raises.edge_vs_index(F.col("expected_net"), 8.0, 0.1)))


@query
def retailed_outcomes(i):
    return publish(outcomes.retail(i.outcomes, F.lit(0.005), ["dist_id"]), digits=6)


@query
def tail_sensitivity(i):
    return publish(outcomes.tail_sensitivity(i.outcomes, TERMS))


@query
def flip_points(i):
    return publish(outcomes.flip_points(outcomes.tail_sensitivity(i.outcomes, TERMS)))


@query
def tilted_outcomes(i):
    """Each deal's outcome distribution, tilted by its evidence score."""
    rows = i.assessed.select("deal_id", "evidence_score").join(i.deal_segments, "deal_id").join(i.outcomes, "dist_id")
    tilted = outcomes.tilt(rows, F.col("evidence_score"), 0.35, by=["deal_id"])
    out = outcomes.expectations(tilted, ["deal_id"], (0.0,), outcomes.net_of("SEIS", TaxProfile()))
    return publish(out)


@query
def portfolio_odds(i):
    return publish(outcomes.odds(i.portfolios, TERMS))


@query
def any_tail_odds(i):
    return publish(outcomes.any_tail_probability(i.outcomes), "dist_id", "positions", "p_any_tail", digits=6)


@query
def deployment_plans(i):
    curve = outcomes.odds(i.portfolios, TERMS)
    df = outcomes.deployment(curve, F.lit(9000.0), F.lit(500.0), raises.relief(F.lit("SEIS"), True))
    return publish(df.withColumn("notes", F.array_join("notes", ",")))


# --- streaming ------------------------------------------------------------------------------------------------


def _stream(i, name):
    schema = i.table(name).schema
    return i.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(i.sf_dir)


def _landing(i, name):
    base = f"{shared_folder(i.spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


@query
def stream_session_bars(i):
    ticks = _stream(i, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1).alias("size")
    )
    out, check = _landing(i, "bars")
    jobs.upsert_batches(jobs.session_bars(ticks), out, check).awaitTermination()
    return publish(jobs.newest_by_key(i.spark.read.parquet(out), "ticker", "d"))


@query
def stream_distinct_filings(i):
    k = F.col("o_custkey")
    rows = _stream(i, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("filed_at"), F.lpad(k.cast("string"), 18, "0").alias("accession_number"),
        filings.form_kind(F.element_at(F.array(*[F.lit(x) for x in ("C", "C/A", "C-U", "C-AR", "C-W", "C-TR")]), (k % 6 + 1).cast("int"))).alias("kind"),
    )
    out, check = _landing(i, "filings")
    jobs.upsert_batches(jobs.filing_states(rows), out, check).awaitTermination()
    return jobs.newest_by_key(i.spark.read.parquet(out), "accession_number").select("accession_number", "kind", F.to_date("filed_at").alias("filed_on"))


@query
def stream_positions(i):
    o = _stream(i, "orders")
    b = F.col("o_orderkey") % 5
    events = o.select(
        F.concat(F.lit("NATION_"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 29).cast("string")).alias("ticker"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.when(b < 2, "toggle").when(b < 4, "enter").otherwise("clear").alias("action"),
        F.when(b.isin(2, 3), F.col("o_totalprice") / 4000.0 + 60.0).alias("entry_price"),
        F.when(b.isin(2, 3), (F.col("o_orderkey") % 6 + 1).cast("double")).alias("size_pct"),
    )
    out, check = _landing(i, "positions")
    jobs.upsert_batches(jobs.position_states(events), out, check).awaitTermination()
    return publish(tables.held_positions(jobs.newest_by_key(i.spark.read.parquet(out))))


@query
def stream_rescored(i):
    """The newest three sessions arrive in three batches, with wrong closes that later batches correct; each batch re-scores
    what it can change, and the state after the last is the screen of all bars."""
    days = i.bars.select("d").distinct().orderBy(F.col("d").desc()).limit(3).agg(F.sort_array(F.collect_list("d")).alias("last"))
    bars = i.bars.select("ticker", "d", "o", "c", "v").crossJoin(F.broadcast(days)).withColumn("k", F.array_position("last", F.col("d")))
    first = F.xxhash64("ticker") % 2 == 0
    wrong = bars.withColumn("c", F.col("c") * 0.9).withColumn("seq", F.lit(1))
    right = bars.withColumn("seq", F.lit(2))
    batches = (wrong.filter("k = 1"), right.filter((F.col("k") == 2) & first), right.filter(((F.col("k") == 2) & ~first) | F.col("k").isin(1, 3)))
    base = f"{shared_folder(i.spark)}/rescore-{uuid.uuid4().hex}"
    fields = ["ticker", "d", "o", "c", "v", "seq"]
    for n, batch in enumerate(batches):
        batch.select(*fields).coalesce(1).write.parquet(f"{base}/new/{n}")
    screen = rescore.Screen(f"{base}/state", f"{base}/out", i.edges, i.overlay, *(i.sql(getattr(fixtures_sql, k)) for k in ("PROFILE", "RATIOS", "METRICS", "SECTOR_PE")))
    screen.start(bars.filter("k = 0").withColumn("seq", F.lit(0)).select(*fields))
    schema = i.spark.read.parquet(f"{base}/new/0").schema
    stream = i.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/new")
    rescore.rescore(stream, screen, f"{base}/checkpoint").awaitTermination()
    rows = jobs.newest_by_key(i.spark.read.parquet(f"{base}/out").select("batch", "ticker", "verdict", "signal_score", "dip_pct_week", "market_pct"))
    return publish(rows, "ticker", "verdict", "signal_score", "dip_pct_week", "market_pct")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank falling names of every as-of session by signal score, at region grain."""
    tuned(spark)
    bars = staged(fixtures.capped_bars(spark, sf_dir, grain="region"))
    edges = fixtures.peer_edges(spark, sf_dir, grain="region")
    obs = walkforward.observations(bars, edges, FALLS)
    return publish(obs, "ticker", "as_of", "signal_score", "cause", "dip_pct_week", *[f"fwd_{h}" for h in HORIZONS]).orderBy(
        F.col("signal_score").desc(), "as_of", "ticker"
    )
