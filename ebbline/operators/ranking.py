"""Exact ranks and order statistics without gathering a group in one task.

Values are first reduced to distinct ones with their counts (a value that fills a third of the table is one row), then
spread over value ranges whose borders come from a mergeable quantile sketch of the data, so that every range holds about
as many rows whatever the scale or spread of the column; ranges get offsets from their totals, and ordering happens
inside a range only. A rank is offset + position, exactly what one global sort would give: the sketch decides how the
work is dealt, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.scalar import ratio
from ebbline.staging import broadcast_if_small, staged

#: Ranges of a group, found in two steps of SPLIT borders each.
SPLIT = 16
RANGES = SPLIT * SPLIT


def borders(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, coarse, fine): ascending quantiles of each group, from one sketch per group and task, merged (stored).

    ``coarse`` has every SPLIT-th of the RANGES - 1 borders, ``fine`` those between two of them. A group without usable
    values has none."""
    points = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    sketch = df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("s"), F.count(value).alias("n"))
    found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", points))
    cuts = sketch.select(*by, F.sort_array(F.coalesce(found, F.array().cast("array<double>"))).alias("q"))
    parts = F.array(*[F.slice("q", k * SPLIT + 1, SPLIT - 1) for k in range(SPLIT)])
    return staged(cuts.select(*by, F.filter("q", lambda _, i: (i + 1) % SPLIT == 0).alias("coarse"), parts.alias("fine")))


def value_range(x: Column) -> Column:
    """Number of borders below a value, in rows that carry ``coarse`` and ``fine``."""
    at = F.size(F.filter("coarse", lambda b: b < x))
    return at * SPLIT + F.size(F.filter(F.get("fine", at), lambda b: b < x))


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values per group with count ``n``, rows below ``below`` and group size ``total``. NULL comes first."""
    cuts = broadcast_if_small(borders(df, by, value))
    distinct = df.groupBy(*by, value).agg(F.count("*").alias("n")).join(cuts, by)
    distinct = distinct.withColumn("_range", F.coalesce(value_range(F.col(value).cast("double")), F.lit(-1))).drop("coarse", "fine")
    inner = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = staged(distinct.withColumn("_inside", F.coalesce(F.sum("n").over(inner), F.lit(0))))
    ordered = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "_range").agg(F.sum("n").alias("_size")).withColumns(
        {
            "_offset": F.coalesce(F.sum("_size").over(ordered), F.lit(0)),
            "total": F.sum("_size").over(Window.partitionBy(*by)),
        }
    )
    joined = placed.join(sizes, [*by, "_range"])  # at most RANGES rows a group: broadcast at run time
    return joined.withColumn("below", F.col("_offset") + F.col("_inside")).drop("_range", "_size", "_offset", "_inside")


def floor_quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Lower empirical quantiles: the value at zero-based position floor(q * (n - 1))."""
    c = counted(df, by, value)
    aggs = []
    for name, q in points.items():
        pos = F.floor((F.col("total") - 1) * F.lit(float(q)))
        hit = (F.col("below") <= pos) & (pos < F.col("below") + F.col("n"))
        aggs.append(F.max(F.when(hit, F.col(value))).alias(name))
    return c.groupBy(*by).agg(*aggs)


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per group (0 below three rows or without variation) and the row count, over the rows that
    have both values."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = staged(both.groupBy(*by, x, y).agg(F.count("*").alias("_pairs")))

    def ranks(value, out):
        return counted(both, by, value).select(
            *by, value, (F.col("below") + (F.col("n") + 1) / 2.0 - (F.col("total") + 1) / 2.0).alias(out)
        )

    joined = pairs.join(ranks(x, "_rx"), [*by, x]).join(ranks(y, "_ry"), [*by, y])
    n, rx, ry = F.col("_pairs"), F.col("_rx"), F.col("_ry")
    sums = joined.groupBy(*by).agg(
        F.sum("_pairs").alias("n"),
        F.sum(n * rx * ry).alias("_xy"), F.sum(n * rx * rx).alias("_xx"), F.sum(n * ry * ry).alias("_yy"),
    )
    ic = F.when(F.col("n") >= 3, ratio(F.col("_xy"), F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))))
    return sums.select(*by, "n", F.coalesce(ic, F.lit(0.0)).alias("ic"))


def stable_positions(df: DataFrame, by: list[str], score: str, date: str, tie: str, out: str = "pos") -> DataFrame:
    """1-based position by (score, date, tie) inside each group, counted through score and date totals.

    Only names of one score on one date are ordered together; everything above that is a sum of counts.
    """
    cells = df.groupBy(*by, score, date).agg(F.count("*").alias("_n"))
    scores = cells.groupBy(*by, score).agg(F.sum("_n").alias("_sn"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.withColumns(
        {
            "_so": F.coalesce(F.sum("_sn").over(before(Window.partitionBy(*by).orderBy(score))), F.lit(0)),
            "_total": F.sum("_sn").over(Window.partitionBy(*by)),
        }
    )
    cells = cells.withColumn(
        "_do", F.coalesce(F.sum("_n").over(before(Window.partitionBy(*by, score).orderBy(date))), F.lit(0))
    )
    offsets = cells.join(scores, [*by, score]).select(*by, score, date, (F.col("_so") + F.col("_do")).alias("_off"), "_total")
    w = Window.partitionBy(*by, score, date).orderBy(tie)
    return (
        df.join(offsets, [*by, score, date])
        .withColumn(out, F.col("_off") + F.row_number().over(w))
        .withColumnRenamed("_total", f"{out}_total")
        .drop("_off")
    )
