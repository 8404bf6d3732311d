"""Market factor and peer baskets as log levels.

A factor is the weighted mean of its members' log returns between consecutive sessions that *every* member has.
Summed from session to session that is the weighted mean of log prices, so a factor level needs one grouped sum
per (segment, session) - no member-by-member alignment - and any two levels give the return between them,
also across sessions some member misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.scalar import ratio
from ebbline.session import spread
from ebbline.staging import broadcast_if_small, staged


def member_weight(market_cap):
    """Capitalisation, or 1 where it is unknown or not positive."""
    return F.when(F.col(market_cap) > 0, F.col(market_cap)).otherwise(F.lit(1.0))


def priced_weight():
    """The weight of a row whose close has a logarithm; others leave numerator and denominator alike."""
    return F.when(F.col("c") > 0, F.col("weight"))


def market_levels(indexed: DataFrame, epochs: DataFrame) -> DataFrame:
    """(seg, di, market_level, market_di): an epoch's level as of each session of its windows, and the session it is from.

    Levels are on the sessions all members have and carried to the next one (axis-sized). Sums per (session, admission)
    are kept once; an epoch adds up those admitted by its ``since``. No bar is copied.
    """
    sums = indexed.groupBy("di", F.col("admitted_di").alias("since")).agg(
        F.sum(F.col("weight") * F.ln("c")).alias("s"), F.sum(priced_weight()).alias("w"), F.count("*").alias("n")
    )
    none = {"seg": F.lit(None).cast("int"), "members": F.lit(None).cast("int")}
    grid = epochs.filter(F.col("oldest") <= F.col("t_hi")).select(
        F.explode(F.sequence("oldest", "t_hi")).alias("di"), "since", F.lit(0.0).alias("s"), F.lit(0.0).alias("w"),
        F.lit(0).cast("bigint").alias("n"), "seg", "members",
    )
    by_admission = Window.partitionBy("di").orderBy("since").rangeBetween(Window.unboundedPreceding, 0)
    level = ratio(F.sum("s").over(by_admission), F.sum("w").over(by_admission))
    upto = sums.withColumns(none).unionByName(grid).withColumns({"market_level": level, "here": F.sum("n").over(by_admission)})
    shared = F.col("here") == F.col("members")
    carried = Window.partitionBy("seg").orderBy("di").rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        "market_level": F.last(F.when(shared, F.col("market_level")), ignorenulls=True).over(carried),
        "market_di": F.last(F.when(shared, F.col("di")), ignorenulls=True).over(carried),
    }
    on_grid = upto.filter(F.col("seg").isNotNull()).withColumns(filled)
    return on_grid.filter(F.col("market_di").isNotNull()).select("seg", "di", "market_level", "market_di")


def factor_series(bars: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stand-alone factor of a fixed member set: level 100 on the first shared session.

    ``bars`` needs ticker, d, c, weight. ``by`` keys independent factors (e.g. one per sector).
    """
    keep = by or []
    by = by or ["_all"]
    if not keep:
        bars = bars.withColumn("_all", F.lit(1))
    sizes = bars.groupBy(*by, "ticker").count().filter("count > 1").groupBy(*by).agg(F.count("*").alias("members"))
    usable = bars.join(bars.groupBy(*by, "ticker").count().filter("count > 1"), [*by, "ticker"], "left_semi")
    per_day = usable.groupBy(*by, "d").agg(
        F.sum(F.col("weight") * F.ln("c")).alias("s"), F.sum(priced_weight()).alias("w"), F.count("*").alias("n")
    )
    joined = per_day.join(sizes, by)
    w = Window.partitionBy(*by).orderBy("d")
    level = F.col("s") / F.col("w")
    return (
        joined.filter(F.col("n") == F.col("members"))
        .withColumns({"ret": level - F.lag(level).over(w), "base": F.first(level).over(w)})
        .withColumn("level", F.exp(level - F.col("base")) * 100.0)
        .select(*keep, "d", "ret", "level")
    )


def chain_index(bars: DataFrame) -> DataFrame:
    """(d, names, ret, level): a chain-linked index over changing members, 100 before the first return (axis-sized).

    Each session's return is the weighted mean, over the names with a bar, of their return since their own last bar; the
    level is carried on from session to session. A listing joins with its second bar and an end leaves without a trace,
    so neither changes an earlier level; a halted name's move enters when it trades again.

    ``bars`` needs ticker, d, c, weight.
    """
    w = Window.partitionBy("ticker").orderBy("d")
    last = F.lag("c").over(w)
    moved = bars.withColumn("_r", F.when((F.col("c") > 0) & (last > 0), F.ln(F.col("c") / last)))
    per_day = moved.groupBy("d").agg(
        F.count("_r").alias("names"),
        ratio(F.sum(F.col("weight") * F.col("_r")), F.sum(F.when(F.col("_r").isNotNull(), F.col("weight")))).alias("ret"),
    )
    so_far = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.withColumn("level", F.exp(F.coalesce(F.sum("ret").over(so_far), F.lit(0.0))) * 100.0)


def align_to(targets: DataFrame, factor: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Carry a factor onto each target's sessions: forward-filled, leading gap back-filled, 1 when empty."""
    keys = keys or ["d"]
    w = Window.partitionBy("ticker").orderBy("d")
    filled = F.last("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = targets.join(factor.select(*keys, "level"), keys, "left")
    leading = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("d"))).over(Window.partitionBy("ticker"))
    return joined.withColumn("aligned", F.coalesce(filled, leading, F.lit(1.0)))


FOLLOWERS_PER_TASK = 64


def followed_bars(bars: DataFrame, peer_edges: DataFrame) -> DataFrame:
    """The peers' bars, once per name that lists them.

    A peer that very many names list is cut into groups of followers: its bars are repeated per group, so that no
    task expands a popular peer alone. Peers with up to 64 followers stay one group.
    """
    edges = peer_edges.select("ticker", "peer").distinct()
    groups = edges.groupBy("peer").agg(F.ceil(F.count("*") / FOLLOWERS_PER_TASK).cast("int").alias("groups"))
    groups = broadcast_if_small(staged(groups))
    sides = edges.join(groups, "peer").select(
        F.col("ticker").alias("follower"), "peer", F.pmod(F.hash("ticker"), F.col("groups")).alias("part")
    )
    bars = bars.select(F.col("ticker").alias("peer"), "di", F.col("admitted_di").alias("since"), "c").join(groups, "peer")
    bars = bars.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    return bars.join(sides, ["peer", "part"])


def peer_admissions(indexed: DataFrame, peer_edges: DataFrame) -> DataFrame:
    """(ticker, joined): the admissions of each name's peers, one entry per peer."""
    names = indexed.select(F.col("ticker").alias("peer"), F.col("admitted_di").alias("since")).distinct()
    edges = peer_edges.select("ticker", "peer").distinct()
    return edges.join(names, "peer").groupBy("ticker").agg(F.collect_list("since").alias("joined"))


def peer_sums(placed: DataFrame, indexed: DataFrame, peer_edges: DataFrame) -> DataFrame:
    """(ticker, di, seg_lo, seg_hi, parts) of each bar: its peers' log prices that session, as (since, s, n) by admission.

    Two levels: sums per (name, session, admission), combined before the exchange, then one list per (name, session).
    Both keys hold the session, so a name whose peers are the whole universe is spread over all tasks.
    """
    peers = followed_bars(indexed, peer_edges).groupBy(F.col("follower").alias("ticker"), "di", "since").agg(
        F.sum(F.ln("c")).alias("s"), F.count("*").alias("n")
    )
    own = placed.select("ticker", "di", F.struct("seg_lo", "seg_hi").alias("own"))
    part = peers.select("ticker", "di", F.struct("since", "s", "n").alias("part"))
    both = own.withColumn("part", F.lit(None).cast(part.schema["part"].dataType)).unionByName(
        part.withColumn("own", F.lit(None).cast(own.schema["own"].dataType))
    )
    lists = both.groupBy("ticker", "di").agg(F.max("own").alias("own"), F.collect_list("part").alias("parts"))
    return lists.filter(F.col("own").isNotNull()).select("ticker", "di", "own.*", "parts")


def basket_level() -> Column:
    """Mean log price of the peers admitted by ``since``, where all of them have a bar."""
    fold = lambda f: F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.when(p["since"] <= F.col("since"), f(p)).otherwise(0.0))
    peers = F.size(F.filter("joined", lambda x: x <= F.col("since")))
    here = fold(lambda p: p["n"].cast("double"))
    return F.when((peers > 0) & (here == peers), ratio(fold(lambda p: p["s"]), here))


def own_and_peer_rows(panel: DataFrame, peers: DataFrame, joined: DataFrame, epochs: DataFrame, market: DataFrame, carried: list[str]) -> DataFrame:
    """One row per (ticker, seg, d) of the name's own bars with market and peer-basket levels.

    ``panel`` has the bars by epoch, ``peers`` and ``joined`` come from ``peer_sums`` and ``peer_admissions``. Own bars
    and basket levels are stacked and reduced by key: a single exchange by (ticker, seg) feeds that and all windows
    that follow. ``market``, ``epochs`` and ``joined`` are stored axis-sized tables and join before it.
    """
    own = panel.join(broadcast_if_small(market), ["seg", "di"], "left").select(
        "ticker", "seg", "di", F.struct("market_level", "market_di", *carried).alias("own"), F.lit(None).cast("double").alias("peer_level")
    )
    each = peers.filter(F.col("seg_lo").isNotNull()).withColumn("seg", F.explode(F.sequence("seg_lo", "seg_hi")))
    each = each.join(broadcast_if_small(epochs.select("seg", "since")), "seg").join(broadcast_if_small(joined), "ticker")
    each = each.withColumn("peer_level", basket_level()).filter(F.col("peer_level").isNotNull())
    baskets = each.select("ticker", "seg", "di", F.lit(None).cast(own.schema["own"].dataType).alias("own"), "peer_level")
    stacked = spread(own.unionByName(baskets), "ticker", "seg")
    merged = stacked.groupBy("ticker", "seg", "di").agg(
        F.first("own", ignorenulls=True).alias("own"), F.max("peer_level").alias("peer_level")
    )
    return merged.select("ticker", "seg", "di", "own.*", "peer_level")


def late_rows(late: DataFrame, windows: DataFrame, starts: DataFrame, peers: DataFrame, joined: DataFrame, market: DataFrame, carried: list[str]) -> DataFrame:
    """``own_and_peer_rows`` of late as-of rows, each in a window of its own (``seg`` below zero): factor sessions before
    the latest start of the members' windows, or of the peers', do not count."""
    df = windows.join(broadcast_if_small(market), ["seg", "di"], "left").join(starts, ["ticker", "t"], "left")
    df = df.join(peers.select("ticker", "di", "parts"), ["ticker", "di"], "left").join(broadcast_if_small(joined), "ticker", "left")
    inside = F.col("market_di") >= F.col("latest_start")
    level = F.when(F.col("di") >= F.col("peers_start"), basket_level())
    return df.withColumns(
        {
            "peer_level": level, "market_level": F.when(inside, F.col("market_level")), "market_di": F.when(inside, F.col("market_di")),
            "seg": -(F.col("t") + 1),
        }
    ).select("ticker", "seg", "di", "market_level", "market_di", *carried, "peer_level", "rn0", "t", "as_of")
