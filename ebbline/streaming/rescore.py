"""Incremental screen: a batch of bars re-scores exactly the names whose result it can change.

Stored between batches, each as one folder of changed rows per batch (re-running a batch replaces its folders):

* ``tails``: the newest 300 bars of each name, the newest version of each bar;
* ``names``: per name the number of bars and the session at its frame's edge;
* ``sessions``: per session the market's sums over all members' tails, updated by the difference of old and new tails.

A batch merges its bars into the tails of its names and moves the session sums by what changed. The market level is known
then without reading any other name. To be scored anew are the names of the batch, the names that list one of them as a
peer, and, if a market level changed, the names whose frame reaches that session. Only those and their peers are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbline.config import MIN_LIVE_SESSIONS, SESSION_WINDOW
from ebbline.operators.asof import as_of
from ebbline.operators.factors import member_weight
from ebbline.operators.panel import FRAME_ROWS, date_axis
from ebbline.plans import live
from ebbline.staging import broadcast_if_small, staged

BARS = "ticker string, d date, o double, c double, v double, seq bigint"
NAMES = "ticker string, bars bigint, edge date, covered boolean"
SESSIONS = "d date, s double, w double, n bigint"
#: Level differences up to this are rounding.
SAME_LEVEL = 1e-12


@dataclass(frozen=True)
class Screen:
    """What scoring needs besides bars; ``folder`` holds the state, ``out`` the analyses."""

    folder: str
    out: str
    peer_edges: DataFrame
    overlay: DataFrame
    profile: DataFrame
    ratios: DataFrame
    metrics: DataFrame
    sector_pe: DataFrame

    def _store(self, rows: DataFrame, part: str, version: int) -> DataFrame:
        path = f"{self.folder}/{part}/version={version:012d}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _current(self, spark: SparkSession, part: str, schema: str, before: int, *key: str) -> DataFrame:
        """Rows of each key's newest version below ``before``."""
        stored = spark.read.schema(schema + ", version bigint").option("basePath", f"{self.folder}/{part}").parquet(f"{self.folder}/{part}/*")
        stored = stored.filter(F.col("version") < before)
        newest = staged(stored.groupBy(*key).agg(F.max("version").alias("version")))
        return stored.join(broadcast_if_small(newest), [*key, "version"], "left_semi").drop("version")

    def start(self, bars: DataFrame) -> None:
        """State and analyses of the stored bars, as version 0."""
        spark = bars.sparkSession
        for part, schema in (("tails", BARS), ("names", NAMES), ("sessions", SESSIONS)):
            self._store(spark.createDataFrame([], schema), part, 0)
        self._advance(bars, 0, 0)

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        self._advance(batch, batch_id + 1, batch_id + 1)

    def _advance(self, batch: DataFrame, version: int, before: int) -> None:
        spark = batch.sparkSession
        fresh = staged(batch.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in BARS.split(", ")]).filter("ticker is not null and d is not null and c > 0"))
        changed = staged(fresh.select("ticker").distinct())
        if changed.isEmpty():
            return
        old = staged(self._current(spark, "tails", BARS, before, "ticker").join(broadcast_if_small(changed), "ticker", "left_semi"))
        cells = [c for c in old.columns if c not in ("ticker", "d")]
        newest = F.max(F.struct("seq", *[c for c in cells if c != "seq"])).alias("x")
        merged = old.unionByName(fresh).groupBy("ticker", "d").agg(newest).select("ticker", "d", *[F.col(f"x.{c}") for c in cells])
        new = self._store(live.newest_sessions(merged, SESSION_WINDOW), "tails", version)
        covered = self.overlay.select("ticker", F.lit(True).alias("covered"))
        edge = F.get(F.sort_array(F.collect_list("d"), asc=False), F.lit(FRAME_ROWS)).alias("edge")
        known = new.groupBy("ticker").agg(F.count("*").alias("bars"), edge).join(covered, "ticker", "left")
        self._store(known.withColumn("covered", F.coalesce("covered", F.lit(False))), "names", version)
        names = self._current(spark, "names", NAMES, version + 1, "ticker")
        members = staged(names.filter(F.col("covered") & (F.col("bars") >= MIN_LIVE_SESSIONS)))
        was = self._levels(self._current(spark, "sessions", SESSIONS, before, "d"), self._members(spark, before))
        moved = staged(self._moved(old, new))
        sums = self._current(spark, "sessions", SESSIONS, before, "d").unionByName(moved).groupBy("d").agg(*[F.sum(c).alias(c) for c in "swn"])
        self._store(sums.join(moved.select("d"), "d", "left_semi"), "sessions", version)
        sessions = staged(self._current(spark, "sessions", SESSIONS, version + 1, "d").filter("n > 0"))
        levels = staged(self._levels(sessions, members.count()))
        scored = staged(self._affected(changed, members, was, levels))
        axis = staged(date_axis(sessions))
        peers = self.peer_edges.join(broadcast_if_small(scored), "ticker", "left_semi").select(F.col("peer").alias("ticker"))
        read = staged(scored.union(peers).distinct().join(broadcast_if_small(members.select("ticker")), "ticker", "left_semi"))
        series = self._current(spark, "tails", BARS, version + 1, "ticker").drop("seq").join(broadcast_if_small(read), "ticker", "left_semi")
        sides = (self.overlay, self.profile, self.ratios, self.metrics, self.sector_pe)
        result = live.analyses_of(scored, series, axis, levels, self.peer_edges, *sides)
        result.write.mode("overwrite").parquet(f"{self.out}/batch={version:012d}")

    def _members(self, spark: SparkSession, before: int) -> int:
        names = self._current(spark, "names", NAMES, before, "ticker")
        return names.filter(F.col("covered") & (F.col("bars") >= MIN_LIVE_SESSIONS)).count()

    def _moved(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """(d, s, w, n): what the names of a batch add to the market's sums; sessions without a difference do not occur."""
        weights = live.market_caps(self.overlay, self.profile).select("ticker", member_weight("market_cap_b").alias("w"))

        def parts(tails: DataFrame, sign: int) -> DataFrame:
            shown = live.admitted(tails).join(weights, "ticker").select("ticker", "d", F.round("c", 2).alias("c"), "w")
            w, x = F.when(F.col("c") > 0, F.col("w")).otherwise(0.0), F.coalesce(F.ln("c"), F.lit(0.0))
            return shown.select("ticker", "d", "c", (sign * w).alias("w"), (sign * w * x).alias("s"), F.lit(sign).cast("bigint").alias("n"))

        both = parts(old, -1).unionByName(parts(new, 1))
        same = both.groupBy("ticker", "d").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.count_distinct("c").alias("closes"))
        differ = same.filter((F.col("n") != 0) | (F.col("closes") > 1))
        return differ.groupBy("d").agg(*[F.sum(c).alias(c) for c in "swn"])

    @staticmethod
    def _levels(sessions: DataFrame, members: int) -> DataFrame:
        """(d, market_level) on the sessions that all members' tails hold."""
        return sessions.filter((F.col("n") == members) & (F.col("w") > 0)).select("d", (F.col("s") / F.col("w")).alias("market_level"))

    def _affected(self, changed: DataFrame, members: DataFrame, was: DataFrame, levels: DataFrame) -> DataFrame:
        """(ticker): members whose analysis the batch can change."""
        both = was.withColumnRenamed("market_level", "before").join(levels, "d", "full")
        differs = F.coalesce(F.abs(F.col("before") - F.col("market_level")) > SAME_LEVEL, F.lit(True))
        last = both.filter(differs).agg(F.max("d")).first()[0]
        followers = self.peer_edges.join(broadcast_if_small(changed.withColumnRenamed("ticker", "peer")), "peer", "left_semi").select("ticker")
        names = changed.union(followers)
        if last is not None:
            # the level at a frame's edge is that of the last factor session up to it; edges are axis-sized
            one = F.lit(1).alias("all")
            base = as_of(members.select("edge", one).distinct(), levels.select("d", one), ["all"], "edge", "d", {"base": "d"})
            unmoved = staged(base.filter(F.col("base") > F.lit(last)).select("edge"))
            names = names.union(members.join(broadcast_if_small(unmoved), "edge", "left_anti").select("ticker"))
        return names.distinct().join(broadcast_if_small(members.select("ticker")), "ticker", "left_semi")


def rescore(new_bars: DataFrame, screen: Screen, checkpoint: str) -> StreamingQuery:
    """Runs every batch of ``new_bars(ticker, d, o, c, v, seq)`` through a started screen; the highest ``seq`` of a bar counts.

    The screen's ``out`` is read with ``jobs.newest_by_key``.
    """
    return (
        new_bars.writeStream.foreachBatch(screen.advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
