"""Provider payloads: JSON bodies with one response each, parsed in bulk, bad ones set aside with a reason.

A payload table is ``(symbol, endpoint, body)``; ``read_bodies`` makes one from a directory of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.functions.scalar import finite

# fixed pattern: phrases a provider puts into a refused response
PLAN_PHRASES = "(?i)legacy|subscription|restricted|upgrade|special endpoint|limit reach"

BAR_JSON = "date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
PROFILE_JSON = (
    "symbol STRING, companyName STRING, price DOUBLE, marketCap DOUBLE, beta DOUBLE, volume DOUBLE, "
    "averageVolume DOUBLE, changePercentage DOUBLE, sector STRING, industry STRING, exchange STRING"
)
RATIOS_JSON = "grossProfitMarginTTM DOUBLE, operatingProfitMarginTTM DOUBLE, priceToEarningsRatioTTM DOUBLE"
METRICS_JSON = (
    "evToEBITDATTM DOUBLE, netDebtToEBITDATTM DOUBLE, returnOnInvestedCapitalTTM DOUBLE, freeCashFlowYieldTTM DOUBLE"
)
SECTOR_JSON = "date DATE, pe DOUBLE"
QUOTE_JSON = "price DOUBLE, changePercentage DOUBLE, timestamp BIGINT"

PROFILE_NAMES = {
    "companyName": "company_name", "price": "quote_price", "marketCap": "market_cap", "beta": "beta",
    "volume": "volume", "averageVolume": "average_volume", "changePercentage": "change_pct",
    "sector": "profile_sector", "industry": "profile_industry", "exchange": "exchange",
}
RATIOS_NAMES = {
    "grossProfitMarginTTM": "gross_margin", "operatingProfitMarginTTM": "operating_margin",
    "priceToEarningsRatioTTM": "pe_ttm",
}
METRICS_NAMES = {
    "evToEBITDATTM": "ev_to_ebitda", "netDebtToEBITDATTM": "net_debt_ebitda",
    "returnOnInvestedCapitalTTM": "roic", "freeCashFlowYieldTTM": "fcf_yield",
}


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its whole body, and the symbol from its folder ``symbol=...`` or else from its name."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("path", F.url_decode("_metadata.file_path"))
    symbol = F.coalesce(*[F.nullif(F.regexp_extract("path", p, 1), F.lit("")) for p in (r"/symbol=([^/]+)/[^/]*$", r"([^/.]+)[^/]*$")])
    return files.select(symbol.alias("symbol"), F.col("value").alias("body"))


def _first_char(body: Column) -> Column:
    return F.substring(F.trim(body), 1, 1)


def parsed(payloads: DataFrame) -> DataFrame:
    """Adds ``json``, the body as a VARIANT, NULL where it is none.

    It comes out of a generator, which expressions over it are not moved through: a body is parsed once, however many
    checks and fields are read from it.
    """
    if "json" in payloads.columns:
        return payloads
    return payloads.select("*", F.explode(F.array(F.try_parse_json("body"))).alias("json"))


def _rejection(history: bool) -> Column:
    """Why a body cannot be used, or NULL. Refusals of the ``history`` endpoint can be any object without bars that
    holds such a phrase; elsewhere an object is refused by its error message only."""
    body, json = F.col("body"), F.col("json")
    message = F.try_variant_get(json, "$['Error Message']", "string")
    listed = F.try_variant_get(json, "$.historical", "variant").isNotNull()
    structured = json.isNotNull() & _first_char(body).isin("[", "{")
    return (
        F.when(body.isNull() | (F.trim(body) == ""), "empty")
        .when(message.rlike(PLAN_PHRASES), "plan_limit")
        .when(message.isNotNull(), "provider_error")
        .when(~structured, F.when(body.rlike(PLAN_PHRASES), "plan_limit").otherwise("not_json"))
        .when(F.lit(history) & (_first_char(body) == "{") & ~listed & body.rlike(PLAN_PHRASES), "plan_limit")
    )


def judged(payloads: DataFrame, history: bool = False) -> DataFrame:
    """The parsed payloads with the ``reason`` for which a body cannot be used, NULL for usable ones."""
    return parsed(payloads).withColumn("reason", _rejection(history))


def split_quarantine(payloads: DataFrame, history: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined): usable rows go on with their parsed body, the others keep their reason and whole body."""
    rows = judged(payloads, history)
    return rows.filter(F.col("reason").isNull()).drop("reason"), rows.filter(F.col("reason").isNotNull()).drop("json")


def _rows(item: str) -> Column:
    """The array a body holds: bare, or under ``historical``."""
    kind = f"array<struct<{item}>>"
    return F.coalesce(F.try_variant_get("json", "$", kind), F.try_variant_get("json", "$.historical", kind))


def _ddl(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ":", 1) for f in fields.split(","))


def _bar_rows(usable: DataFrame) -> DataFrame:
    return parsed(usable).select(F.col("symbol").alias("ticker"), F.inline(_rows(_ddl(BAR_JSON))))


def unusable_bars(usable: DataFrame) -> DataFrame:
    """(ticker, d, c, reason) of the bars that :func:`history_bars` cannot use."""
    reason = F.when(F.col("date").isNull(), "no_date").when(F.col("close").isNull(), "no_close").when(~(F.col("close") > 0), "close_not_positive")
    rows = _bar_rows(usable).select("ticker", F.col("date").alias("d"), F.col("close").alias("c"), reason.alias("reason"))
    return rows.filter(F.col("reason").isNotNull())


def history_bars(usable: DataFrame, sessions: int | None = None) -> DataFrame:
    """Daily bars of every symbol, all or the last ``sessions`` of each; :func:`unusable_bars` has the rest.

    Landing tables hold many copies of the same bar (each fetch repeats the history), so copies are reduced to
    one row per (ticker, d) before anything is ordered; of differing copies the greatest row stays.
    """
    bars = _bar_rows(usable).filter(F.col("date").isNotNull() & (F.col("close") > 0)).select(
        "ticker", F.col("date").alias("d"), finite("open").alias("o"), finite("high").alias("h"),
        finite("low").alias("l"), F.col("close").alias("c"), finite("volume").alias("v"),
    )
    bars = bars.groupBy("ticker", "d").agg(F.max(F.struct("c", "o", "h", "l", "v")).alias("b"))
    bars = bars.select("ticker", "d", "b.o", "b.h", "b.l", "b.c", "b.v")
    if sessions is None:
        return bars
    newest = Window.partitionBy("ticker").orderBy(F.col("d").desc())
    return bars.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= sessions).drop("_age")


def first_item(usable: DataFrame, fields: str, names: dict[str, str], key: str = "ticker") -> DataFrame:
    """First element of each response array (or the bare object), renamed; symbols with an empty array drop out."""
    kind = f"struct<{_ddl(fields)}>"
    item = F.coalesce(F.try_variant_get("json", "$[0]", kind), F.try_variant_get("json", "$", kind))
    rows = parsed(usable).select(F.col("symbol").alias(key), F.explode(F.array(item)).alias("x")).filter(F.col("x").isNotNull())
    return rows.select(key, *[F.col(f"x.{k}").alias(v) for k, v in names.items()])



def profiles(usable: DataFrame) -> DataFrame:
    return first_item(usable, PROFILE_JSON, PROFILE_NAMES)


def ratios(usable: DataFrame) -> DataFrame:
    return first_item(usable, RATIOS_JSON, RATIOS_NAMES)


def key_metrics(usable: DataFrame) -> DataFrame:
    return first_item(usable, METRICS_JSON, METRICS_NAMES)


def sector_pe(usable: DataFrame) -> DataFrame:
    """(sector, date, pe): the snapshots that have a value; failures are simply absent."""
    return first_item(usable, SECTOR_JSON, {"date": "date", "pe": "pe"}, key="sector").filter(F.col("pe").isNotNull())


def quotes(usable: DataFrame) -> DataFrame:
    names = {"price": "price", "changePercentage": "change_pct", "timestamp": "ts"}
    return first_item(usable, QUOTE_JSON, names, key="symbol")
