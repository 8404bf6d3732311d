"""URL filters with redirect equivalence.

A url's own rule decides where one fits. Redirect and canonical-link edges join urls into components; a component's
explicit decisions reach its members without a rule, and an explicit allow goes before a block. Everything else is
allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm.common import small
from llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and for urls without ``://``."""
    url, shape = F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, shape, 1), _UPPER, _LOWER), F.regexp_extract(url, shape, 2)


def node(url: Column) -> Column:
    """What redirects lead to: host, path and query, without scheme and fragment; NULL where there is no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[^#?]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def link_targets(pages: DataFrame) -> DataFrame:
    """(url, target) of pages(url, html): canonical links and refresh redirects, resolved against the page's url."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    link = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0))
    meta = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    href = lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]*)", 1)
    goto = lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]*)", 1)
    df = pages.select(F.col("url").cast("string").alias("url"), F.concat(F.transform(link, href), F.transform(meta, goto)).alias("targets"))
    df = df.where(F.size("targets") > 0).select("url", F.explode(F.array_distinct("targets")).alias("t"))
    df = df.withColumn("t", F.replace("t", F.lit("&amp;"), F.lit("&"))).where(r"t <> '' and t not like '#%' and not t rlike '^(?i)(?!https?:)[a-z][a-z0-9+.-]*:'")
    host, path = host_and_path(F.col("url"))
    root = F.concat(F.lit("http://"), host)
    folder = F.regexp_extract(path, "^.*/", 0)
    target = (
        F.when(F.locate("://", "t") > 0, F.col("t")).when(F.startswith("t", F.lit("//")), F.concat(F.lit("http:"), F.col("t")))
        .when(F.startswith("t", F.lit("/")), F.concat(root, F.col("t"))).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), F.col("t")))
    )
    return df.select("url", target.alias("target"))


def _ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) of the distinct places(host, path) that a rule fits. The longest rule wins, then the
    longer host, then allow, then the greater string."""
    r = rules.select(
        F.col("action"), F.col("rule"), F.regexp_extract("rule", "^[^/]*", 0).alias("suffix"), F.regexp_extract("rule", "/.*$", 0).alias("prefix")
    ).distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    tails = places.where("host <> ''").distinct().withColumn("suffix", F.explode(ends))
    fit = tails.join(small(staged(r)), "suffix").where(F.startswith("path", "prefix"))
    best = F.max(F.struct(F.length("rule"), F.length("suffix"), F.when(F.col("action") == "allow", 1).otherwise(0), "rule", "action"))
    return staged(fit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, reason) of each row of pages(page_id, url).

    ``rules(action, rule)``: allow or block, and a host suffix with a path prefix such as ``net/es/``; NULLs are
    ignored. ``redirects(url, target)`` are edges in either sense; ends without a host are ignored. ``reason`` is rule,
    alias or default. Repeated rows come back as often as they came. Empty tables give no rows or no effect.
    """
    host, path = host_and_path(F.col("url"))
    df = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rules = rules.select("action", "rule").where("action in ('allow', 'block') and rule is not null")
    own = _ruled(df.select("host", "path"), rules)
    out = df.join(small(own), ["host", "path"], "left")
    alias = _aliases(redirects, rules) if redirects is not None else None
    if alias is None:
        out = out.withColumn("spread", F.lit(None).cast("string"))
    else:
        out = out.withColumn("node", node(F.col("url"))).join(small(alias), "node", "left")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"),
        F.when(F.col("action").isNotNull(), "rule").when(F.col("spread").isNotNull(), "alias").otherwise("default").alias("reason"),
    )


def _aliases(redirects: DataFrame, rules: DataFrame) -> DataFrame | None:
    """(node, spread): the decision that each url's component carries; None without edges."""
    edges = redirects.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b")).where("a <> b")
    edges = staged(edges.distinct())
    if edges.isEmpty():
        return None
    of = components(edges)
    host, path = host_and_path(F.concat(F.lit("http://"), F.col("node")))
    places = of.select("node", "component", host.alias("host"), path.alias("path"))
    decided = places.join(small(_ruled(places.select("host", "path"), rules)), ["host", "path"])
    spread = staged(decided.groupBy("component").agg(F.min("action").alias("spread")))  # allow sorts before block
    return staged(of.join(small(spread), "component").select("node", "spread"))


#: Fixed values of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule string")
