"""Filing feeds and offering documents: XML in bulk to listings, offerings and deal skeletons.

Whatever a document does not state stays NULL; what it states but cannot be read is reported in ``unparsed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.config import LIVE_RAISE_KINDS

# fixed patterns of the feed
TITLE = r"^\s*([A-Z0-9/-]+)\s+-\s+(.+?)\s*\((\d{7,10})\)"
ACCESSION = r"(\d{10}-\d{2}-\d{6})"
BARE_ACCESSION = r"(\d{18})"
HTML_BODY = r"(?i)^\s*(<!doctype html|<html)"

FEED_XML = "entry array<struct<title: string, link: array<struct<_href: string>>, updated: string>>"
#: Prefixes do not matter, and a text that is no XML gives NULL.
XML_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, body), one row per file."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def unavailable(body: Column) -> Column:
    """An HTML page in place of a feed: the endpoint is missing, the data is not at fault."""
    return F.coalesce(body.rlike(HTML_BODY), F.lit(False))


def whole_document(body: Column) -> Column:
    """An XML text whose last tag closes its first element (or that is one empty element)."""
    text = F.regexp_replace(body, r"(?s)^\s*(?:<[?!][^>]*>\s*)*", "")
    root = F.regexp_extract(text, r"^<([A-Za-z_][\w.:-]*)", 1)
    closed = F.rtrim(F.regexp_replace(text, r"\s+$", "")).endswith(F.concat(F.lit("</"), root, F.lit(">")))
    return F.coalesce((root != "") & (closed | text.rlike(r"^<[^>]*/>\s*$")), F.lit(False))


def _without_open(body: Column, begin: str, end: str) -> Column:
    """The text before a comment or character section that does not end."""
    tail = F.substring_index(body, begin, -1)
    cut = (F.instr(body, begin) > 0) & (F.instr(tail, end) == 0)
    return F.when(cut, F.left(body, F.length(body) - F.length(tail) - len(begin))).otherwise(body)


def closed(body: Column, element: str = r"[^<>\s]+") -> Column:
    """A document that is cut off, up to the last whole ``element`` (by default any), with its open elements closed.

    The open elements are a fold over the tags; a whole document stays as it is.
    """
    text = _without_open(_without_open(body, "<!--", "-->"), "<![CDATA[", "]]>")
    kept = F.regexp_extract(text, rf"(?s)^(.*</(?:[\w.-]+:)?{element}\s*>)", 1)
    bare = F.regexp_replace(kept, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>", "")
    tags = F.regexp_extract_all(bare, F.lit(r"<[^<>]+>"), F.lit(0))
    name = lambda t: F.regexp_extract(t, r"^<([^\s/>]+)", 1)
    opened = F.aggregate(
        tags, F.array().cast("array<string>"),
        lambda acc, t: F.when(t.startswith("</"), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(t.endswith("/>"), acc).otherwise(F.concat(acc, F.array(name(t)))),
    )
    ends = F.array_join(F.transform(F.reverse(opened), lambda n: F.concat(F.lit("</"), n, F.lit(">"))), "")
    return F.when(whole_document(body), body).otherwise(F.nullif(F.concat(kept, ends), F.lit("")))


def _read_xml(documents: DataFrame, body: Column, schema: str) -> DataFrame:
    """Adds ``xml``, the body as a struct. It comes out of a generator, so each document is parsed once."""
    return documents.select("*", F.explode(F.array(F.from_xml(body, schema, XML_OPTIONS))).alias("xml"))


def _parsed_feeds(documents: DataFrame) -> DataFrame:
    """(path, entry, whole, html): the entries before the cut of a feed that is cut off, none of one that is no XML."""
    judged = documents.select("path", "body", unavailable(F.col("body")).alias("html"))
    text = F.when(~F.col("html"), closed(F.col("body"), "entry"))
    read = _read_xml(judged, text, FEED_XML)
    return read.select("path", F.col("xml.entry").alias("entry"), whole_document(F.col("body")).alias("whole"), "html")


def _entry_fields(e: Column) -> dict[str, Column]:
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return {"title": text(e["title"]), "href": F.get(e["link"], F.lit(0))["_href"], "updated": text(e["updated"])}


def feed_entries(documents: DataFrame) -> DataFrame:
    """One row per feed entry (path, title, href, updated); entries lacking title or link are kept with NULLs.

    Feeds that cannot be read have none; :func:`feed_report` names them.
    """
    entries = _parsed_feeds(documents).select("path", F.explode("entry").alias("e"))
    return entries.select("path", *[v.alias(k) for k, v in _entry_fields(F.col("e")).items()])


def form_kind(form: Column) -> Column:
    t = F.upper(F.trim(form))
    return (
        F.when(t == "C", "offering")
        .when(t == "C/A", "amendment")
        .when(t.startswith("C-U"), "update")
        .when(t.startswith("C-AR"), "annual_report")
        .when(t.startswith("C-W"), "withdrawal")
        .otherwise("other")
    )


def accession(href: Column) -> Column:
    """Hyphenated number if the link holds one, else 18 bare digits hyphenated, else ''."""
    bare = F.regexp_extract(href, BARE_ACCESSION, 1)
    return F.coalesce(
        F.nullif(F.regexp_extract(href, ACCESSION, 1), F.lit("")),
        F.regexp_replace(bare, r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3"),
    )


def listings(entries: DataFrame) -> DataFrame:
    """Typed listing rows with per-row ``unparsed``; entries without title or link are not listings."""
    df = entries.filter(F.col("title").isNotNull() & F.col("href").isNotNull())
    hit = F.col("title").rlike(TITLE)
    part = lambda i, miss: F.when(hit, F.regexp_extract("title", TITLE, i)).otherwise(miss)
    df = df.withColumns(
        {
            "form_type": part(1, F.lit("C")), "company_name": part(2, F.col("title")), "cik": part(3, F.lit("")),
            "accession_number": accession(F.col("href")),
            "filing_path": F.coalesce(F.get(F.split("href", "/Archives/"), F.lit(1)), F.lit("")),
            "filed_at": F.coalesce("updated", F.lit("")),
        }
    )
    return df.select(
        "company_name", "cik", "accession_number", "filed_at", "form_type", form_kind(F.col("form_type")).alias("kind"),
        "filing_path", F.col("href").alias("edgar_url"),
        F.array_compact(
            F.array(F.when(~hit, "title"), F.when(F.col("accession_number") == "", "accession"))
        ).alias("unparsed"),
    )


def feed_report(documents: DataFrame) -> DataFrame:
    """(path, field): what could not be read of each document. ``endpoint`` stands for an HTML page, ``feed`` for a feed
    that is no XML or cut off, ``entry`` for entries without title or link. One pass, one parse of each document."""

    def unread(e: Column) -> Column:
        f = _entry_fields(e)
        bare = f["title"].isNull() | f["href"].isNull()
        return F.array_compact(
            F.array(
                F.when(bare, "entry"), F.when(~bare & ~f["title"].rlike(TITLE), "title"),
                F.when(~bare & (accession(f["href"]) == ""), "accession"),
            )
        )

    fields = F.concat(
        F.array_compact(F.array(F.when(F.col("html"), "endpoint"), F.when(~F.col("html") & ~F.col("whole"), "feed"))),
        F.coalesce(F.flatten(F.transform("entry", unread)), F.array().cast("array<string>")),
    )
    return _parsed_feeds(documents).select("path", F.explode(F.array_distinct(fields)).alias("field")).distinct()


def live_raises(rows: DataFrame, count: int | None = None) -> DataFrame:
    """New offerings and amendments; with ``count`` the newest so many, in order."""
    df = rows.filter(F.col("kind").isin(*LIVE_RAISE_KINDS))
    if count is None:
        return df
    return df.orderBy(F.col("filed_at").desc(), "accession_number").limit(count)


_TAGS = (
    "nameOfIssuer", "issuerName", "offeringAmount", "maximumOfferingAmount", "securityOfferedType",
    "typeOfSecurityOffered", "deadlineDate", "jurisdictionOrganization", "price",
)
#: Elements below the root that hold the tags; the spelling's case does not matter.
_HOLDERS = ("", "formData", "formData.issuerInformation", "formData.issuerInformation.issuerInfo", "formData.offeringInformation",
            "issuerInformation", "issuerInformation.issuerInfo", "offeringInformation")


def _offering_schema(prefix: str = "") -> str:
    """Fields of the element ``prefix``: the tags, as lists because they may repeat, and the holders below it."""
    below = {h.removeprefix(prefix).lstrip(".") for h in _HOLDERS if h.startswith(prefix) and h != prefix}
    inner = sorted(h for h in below if h and "." not in h)
    parts = [(t, "array<string>") for t in _TAGS]
    parts += [(h, f"struct<{_offering_schema(f'{prefix}.{h}'.lstrip('.'))}>") for h in inner]
    return ", ".join(f"{name}{':' if prefix else ''} {kind}" for name, kind in parts)


OFFERING_XML = _offering_schema() + ", _corrupt_record string"


def _tag(tag: str) -> Column:
    """Text of the first such element in the holders, or else, for documents that have it in another place, anywhere.

    An element with elements inside counts with their text.
    """
    found = F.coalesce(*[F.get(F.col(".".join(x for x in ("xml", h, tag) if x)), F.lit(0)) for h in _HOLDERS])
    named = f"translate(local-name(), '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}') = '{tag.lower()}'"
    there = F.lower("body").rlike(rf"<(?:[\w.-]+:)?{tag.lower()}[\s>]") & F.col("_whole")
    anywhere = F.when(there, F.xpath_string("body", F.lit(f"(//*[{named}])[1]")))
    return F.nullif(F.trim(F.regexp_replace(F.coalesce(found, anywhere), r"<[^>]*>", "")), F.lit(""))


def _amount(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^0-9.]", "").try_cast("double")


def offerings(documents: DataFrame) -> DataFrame:
    """Offering terms per document ``(accession_number, body)``, each read once by schema.

    An amount whose text holds no digits is NULL and counts as unparsed, and so does a document that is cut off; what
    stands in it whole is kept. A document that is no XML gives NULLs and counts as unparsed.
    """
    df = _read_xml(documents, closed(F.col("body")), OFFERING_XML)
    df = df.withColumn("_whole", whole_document(F.col("body")) & F.col("xml").isNotNull() & F.col("xml._corrupt_record").isNull())
    df = df.withColumns({f"_{t}": _tag(t) for t in _TAGS})
    df = df.withColumns({"offering_amount": _amount(F.col("_offeringAmount")),
                         "maximum_offering_amount": _amount(F.col("_maximumOfferingAmount"))})
    return df.select(
        "accession_number",
        F.coalesce("_nameOfIssuer", "_issuerName").alias("issuer_name"),
        "offering_amount", "maximum_offering_amount",
        F.coalesce("_securityOfferedType", "_typeOfSecurityOffered").alias("security_type"),
        _amount(F.col("_price")).alias("price"),
        F.col("_deadlineDate").alias("deadline"),
        F.col("_jurisdictionOrganization").alias("jurisdiction"),
        F.array_compact(
            F.array(
                F.when(F.col("offering_amount").isNull(), "offeringAmount"),
                F.when(F.col("maximum_offering_amount").isNull(), "maximumOfferingAmount"),
                F.when(~F.col("_whole"), "document"),
            )
        ).alias("unparsed"),
    )


DEAL_PARTS = {
    "founders": "array<struct<name:string,domain_years:double,prior_founder:boolean,prior_exit:boolean,"
                "full_time:boolean,insolvency_count:int>>",
    "traction": "struct<revenue_ltm:double,revenue_growth_pct:double,gross_margin_pct:double,runway_months:double,"
                "ltv_cac:double,churn_pct_monthly:double>",
    "terms": "struct<pre_money:double,target_raise:double,amount_raised:double,equity_offered_pct:double,"
             "share_class:string,has_preemption_rights:boolean,has_information_rights:boolean,"
             "has_voting_rights:boolean,tax_wrapper:string,nominee_structure:boolean,founder_retained_pct:double>",
    "registry": "struct<company_number:string,incorporated_on:date,filing_health:string,accounts_overdue:boolean,"
                "confirmation_overdue:boolean,outstanding_charges:int,active_directors:int,source:string>",
    "network": "struct<named_co_investors:array<string>,has_professional_lead:boolean,investor_count:int,"
               "founder_accessible:boolean,sector_adjacency:double,syndicate_access:boolean>",
}


def record(part: str, **known: Column) -> Column:
    """A deal part with the given fields; every other field is NULL."""
    body = DEAL_PARTS[part][len("struct<"):-1]
    depth, fields, start = 0, [], 0
    for i, ch in enumerate(body + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            fields.append(body[start:i].split(":", 1))
            start = i + 1
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def distinct_listings(listing_rows: DataFrame) -> DataFrame:
    """Each filing once, however many feeds list it: the newest row of an accession number, or of a link without one."""
    columns = [F.col(c) for c in listing_rows.columns]
    key = F.coalesce(F.nullif(F.col("accession_number"), F.lit("")), F.col("edgar_url"))
    newest = F.max(F.struct("filed_at", F.struct(*columns).alias("row"))).alias("top")
    return listing_rows.groupBy(key.alias("key")).agg(newest).select("top.row.*")


def with_deal_id(listing_rows: DataFrame) -> DataFrame:
    """The accession number names a deal, else the issuer, else a hash of the link: never an empty name."""
    named = [F.nullif(F.col(c), F.lit("")) for c in ("accession_number", "cik")]
    key = F.coalesce(*named, F.concat(F.lit("link-"), F.md5(F.coalesce("edgar_url", F.lit("")))))
    return listing_rows.withColumn("deal_id", F.concat(F.lit("edgar:"), key))


def deal_skeletons(listing_rows: DataFrame, offering_rows: DataFrame) -> DataFrame:
    """Listings with their offering, as deals. A US issuer carries no relief; all else absent stays undisclosed.

    Listings without an offering document carry ``unparsed = ['primary_doc']``. A deal keeps the form, date and path of
    its filing, so nothing is joined back.
    """
    o = offering_rows.select(
        "accession_number", "issuer_name", "offering_amount", F.col("unparsed").alias("offering_unparsed"),
        F.lit(True).alias("found"),
    )
    df = with_deal_id(listing_rows).drop("unparsed").join(o, "accession_number", "left")
    return df.select(
        "deal_id",
        F.coalesce("issuer_name", "company_name").alias("company_name"),
        F.lit("other").alias("platform"), F.lit("other").alias("sector"), F.lit("unknown").alias("stage"),
        F.lit("US").alias("country"), F.col("edgar_url").alias("url"),
        F.array().cast(DEAL_PARTS["founders"]).alias("founders"),
        record("traction").alias("traction"),
        record("terms", target_raise=F.col("offering_amount"), share_class=F.lit("unknown"), tax_wrapper=F.lit("NONE")).alias("terms"),
        record("registry", company_number=F.col("cik"), filing_health=F.lit("current"), accounts_overdue=F.lit(False),
               confirmation_overdue=F.lit(False), outstanding_charges=F.lit(0), active_directors=F.lit(0),
               source=F.lit("sec_edgar")).alias("registry"),
        record("network").alias("network"),
        F.when(F.col("found").isNull(), F.array(F.lit("primary_doc"))).otherwise(F.col("offering_unparsed")).alias("unparsed"),
        F.col("filed_at").alias("discovered_at"), "form_type", "filing_path",
    )
