"""Point-in-time panel: which bars each as-of session may see, without materialising one window per session.

A name is admitted with its ``min_history``-th bar and stays, with its last close, when it stops trading. As-of sessions
are cut into *epochs* ("segments" in the code) of constant membership. What an as-of row reads are its name's last 126
levels, its *frame*; so a bar is copied once per epoch in which it stands in a frame, ``1 + 125 / epoch length`` times.

The market of an epoch needs no copies at all: sums per (session, admission) are kept once and added up in the order of
admission, and an epoch's level on a session is the sum up to its last admission, where every member has a bar.

A trailing window starts 299 bars before its as-of row, and a session counts for a factor only if it lies in the window of
every member. That bound is later than the frame only for names whose frame reaches far back: those that trade rarely,
and those that have ended. Their as-of rows ("late") get a frame of their own, cut at the bound; all others are
measured in the epoch. Rows whose window holds no session that all members share have no market by definition.

Tables called "axis-sized" below have at most one row per session, or per epoch and session of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.config import DIP_SESSIONS, ESTIMATION_SESSIONS, SESSION_WINDOW, WalkForwardConfig
from ebbline.operators.asof import as_of
from ebbline.operators.technicals import by_ticker
from ebbline.staging import broadcast_if_small

# rows before the as-of row that the decomposition may read: 5 + 120 returns, hence one more level
FRAME_ROWS = DIP_SESSIONS + ESTIMATION_SESSIONS


def date_axis(bars: DataFrame) -> DataFrame:
    """Sorted distinct sessions over all names with their position ``di`` (axis-sized)."""
    days = bars.select("d").distinct()
    whole = Window.orderBy("d")
    return days.select(
        "d",
        (F.row_number().over(whole) - 1).alias("di"),
        (F.count("*").over(Window.partitionBy()) - 1).cast("int").alias("last_di"),
    )


def index_bars(df: DataFrame, min_history: int) -> DataFrame:
    """Position every bar (with ``di``, ``rn``) in its name's history; drop names that are never admitted."""
    w = by_ticker()
    first_di = F.first("di").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns(
        {
            "next_di": F.lead("di").over(w),
            "expires_di": F.lead("di", FRAME_ROWS + 1).over(w),
            "start_di": F.coalesce(F.lag("di", SESSION_WINDOW - 1).over(w), first_di),
            "admitted_di": F.max(F.when(F.col("rn") == min_history, F.col("di"))).over(Window.partitionBy("ticker")),
        }
    ).filter(F.col("admitted_di").isNotNull())


def as_of_bounds(cfg: WalkForwardConfig) -> tuple[Column, Column]:
    """First and last axis position that is scored."""
    if cfg.last_only:
        return F.col("last_di"), F.col("last_di")
    return F.lit(cfg.min_history), F.col("last_di") - 1


def positions(lo: Column, hi: Column) -> Column:
    """Array lo..hi, empty when lo > hi."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def as_of_stats(indexed: DataFrame, cfg: WalkForwardConfig) -> DataFrame:
    """Per as-of session: number of admitted names and the latest start of their windows (axis-sized)."""
    lo, hi = as_of_bounds(cfg)
    valid = positions(
        F.greatest("di", "admitted_di", lo), F.least(F.coalesce(F.col("next_di") - 1, F.col("last_di")), hi)
    )
    return (
        indexed.filter(F.col("rn") >= cfg.min_history)
        .select(F.explode(valid).alias("t"), "start_di")
        .groupBy("t")
        .agg(F.count("*").cast("int").alias("members"), F.max("start_di").alias("latest_start"))
        .filter(F.col("members") >= cfg.min_names)
    )


def segments(indexed: DataFrame, cfg: WalkForwardConfig) -> DataFrame:
    """(t, seg, members, latest_start): the epoch of each scored as-of session (axis-sized)."""
    w = Window.orderBy("t")
    cut = (
        (F.col("members") != F.lag("members").over(w))
        | (F.col("t") != F.lag("t").over(w) + 1)
        | (F.col("t") % cfg.segment_sessions == 0)
    )
    df = as_of_stats(indexed, cfg).withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int"))
    return df.select("t", F.sum("_cut").over(w).cast("int").alias("seg"), "members", "latest_start")


def calendar(axis: DataFrame, segs: DataFrame) -> DataFrame:
    """The axis with each session's epoch, its bounds, and the nearest epochs before and after (axis-sized)."""
    up, down = Window.orderBy("di"), Window.orderBy(F.col("di").desc())
    within = Window.partitionBy("seg")
    return axis.join(segs, axis.di == segs.t, "left").select(
        "di", "d", "seg", "members", "latest_start",
        F.min("t").over(within).alias("t_lo"), F.max("t").over(within).alias("t_hi"),
        F.max("seg").over(up).alias("seg_before"), F.min("seg").over(down).alias("seg_after"),
    )


def epoch_table(days: DataFrame) -> DataFrame:
    """(seg, since, members, oldest, t_lo, t_hi): members are the names admitted by ``since`` (axis-sized).

    Window starts never move back, so no session before ``oldest`` is in all windows of the epoch.
    """
    first = days.filter(F.col("di") == F.col("t_lo"))
    return first.select("seg", F.col("t_lo").alias("since"), "members", F.col("latest_start").alias("oldest"), "t_lo", "t_hi")


def epochs_of_bars(indexed: DataFrame, days: DataFrame) -> DataFrame:
    """Adds the first and last epoch (``seg_lo``, ``seg_hi``) in which a bar stands in a frame, NULL for bars in none.

    Lookups in the calendar only: the bars are not exchanged here.
    """
    df = indexed.withColumns(
        {
            "live_from": F.greatest("di", "admitted_di"),
            "live_to": F.coalesce(F.col("expires_di") - 1, F.col("last_di")),
        }
    )
    df = df.join(days.select(F.col("di").alias("live_from"), F.col("seg_after").alias("seg_lo")), "live_from")
    df = df.join(days.select(F.col("di").alias("live_to"), F.col("seg_before").alias("seg_hi")), "live_to")
    some = F.col("seg_lo") <= F.col("seg_hi")
    return df.withColumns({k: F.when(some, F.col(k)) for k in ("seg_lo", "seg_hi")}).drop("live_from", "live_to")


def live_panel(placed: DataFrame, epochs: DataFrame) -> DataFrame:
    """One row per bar and epoch in which it stands in a frame, with the epoch's bounds."""
    some = placed.filter(F.col("seg_lo").isNotNull())
    each = some.withColumn("seg", F.explode(F.sequence("seg_lo", "seg_hi"))).drop("seg_lo", "seg_hi")
    return each.join(broadcast_if_small(epochs.select("seg", "t_lo", "t_hi")), "seg")


def at_sessions(rows: DataFrame, days: DataFrame) -> DataFrame:
    """One row per (ticker, as-of session ``t``): the name's newest row in the session's epoch. Rows that only fill
    frames vanish here."""
    here = positions(
        F.greatest("di", "admitted_di", "t_lo"), F.least(F.coalesce(F.col("next_di") - 1, F.col("t_hi")), "t_hi")
    )
    known = days.select(F.col("di").alias("t"), F.col("d").alias("as_of"), "latest_start")
    return rows.withColumn("t", F.explode(here)).join(known, "t")


def without_market(reach: dict[str, Column]) -> Column:
    """No factor session of the frame is in the windows of all members, or none moves the level inside the frame."""
    last = reach["market"]
    return last.isNull() | (last < F.col("latest_start")) | F.coalesce(last <= reach["frame"], F.lit(False))


def is_late(reach: dict[str, Column]) -> Column:
    """The epoch's levels may reach back beyond some member's window in this row's frame."""
    start, frame = F.col("latest_start"), reach["frame"]
    moved = lambda last: last.isNotNull() & ~F.coalesce(last <= frame, F.lit(False))
    market = moved(reach["market"]) & F.coalesce(reach["market_base"] < start, F.lit(False))
    # the level at the frame's edge is unknown where the epoch holds no earlier row of the name with one
    unknown = frame.isNotNull() & (F.col("rn") > FRAME_ROWS + 1) & reach["peers_edge"].isNull()
    base = F.coalesce(reach["peers_edge"], reach["peers_first"])
    peers = moved(reach["peers"]) & (unknown | F.coalesce(base < start, F.lit(False)))
    return ~without_market(reach) & (market | peers)


def window_rows(late: DataFrame, indexed: DataFrame) -> DataFrame:
    """The bars of each late row's window: an equi-join on (ticker, block of bar numbers), then the exact range."""
    block = lambda rn: F.floor(rn / SESSION_WINDOW)
    blocks = F.array_distinct(F.array(block(F.greatest(F.col("rn0") - SESSION_WINDOW + 1, F.lit(1))), block(F.col("rn0"))))
    sides = late.withColumn("_block", F.explode(blocks))
    rows = indexed.withColumn("_block", block(F.col("rn"))).join(sides, ["ticker", "_block"]).drop("_block")
    return rows.filter((F.col("rn") <= F.col("rn0")) & (F.col("rn") > F.col("rn0") - SESSION_WINDOW))


def peer_starts(late: DataFrame, indexed: DataFrame, peer_edges: DataFrame) -> DataFrame:
    """(ticker, t, peers_start): the latest window start among a name's peers, as of session t."""
    asked = late.select("ticker", "t").join(peer_edges.select("ticker", "peer").distinct(), "ticker")
    starts = indexed.select("ticker", "di", "start_di")
    wanted = asked.select(F.col("peer").alias("ticker"), "t").distinct()
    found = as_of(wanted, starts, ["ticker"], "t", "di", {"start_di": "start_di"})
    found = found.select(F.col("ticker").alias("peer"), "t", "start_di")
    return asked.join(found, ["peer", "t"]).groupBy("ticker", "t").agg(F.max("start_di").alias("peers_start"))
