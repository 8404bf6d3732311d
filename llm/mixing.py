"""Mixing sources to target weights by temperature.

Source shares of all tokens are raised to an exponent between 0 (uniform) and 1 (as found) and normalised. The exponent
is narrowed in sixteenths to meet a target entropy and a limit on how often a source is repeated under the budget. The
weights are realised as epochs: whole passes over a source, then one partial pass that follows a permutation of the
source's blocks until its budget is used. The cut runs through at most one block, one of its sub-blocks and one run of
documents, so no window holds more than BLOCKS rows or the documents of one sub-block. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm.common import small

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS = 4096
ROUNDS = 8


def units(docs: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens, copies): rows of one source and doc_id are one unit. NULL text has no tokens, a NULL
    source reads as ''; a NULL doc_id is a unit of its source."""
    tokens = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("bigint"), tokens.alias("n"))
    return rows.groupBy("source", "doc_id").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("copies"))


def _measures(sizes: DataFrame, exponents: list[float], over: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest repetition) over all sources with tokens."""
    grid = F.explode(F.array(*[F.lit(float(e)) for e in exponents])).alias("e")
    ls = F.col("ls")
    at = sizes.select("ls", grid).groupBy("e").agg(
        F.sum(F.exp(F.col("e") * ls)).alias("z"), F.sum(F.exp(F.col("e") * ls) * ls).alias("a"), F.max((F.col("e") - 1) * ls).alias("m")
    )
    return sorted((r["e"], math.log(r["z"]) - r["e"] * r["a"] / r["z"], over * math.exp(r["m"]) / r["z"]) for r in at.collect())


def exponent(sizes: DataFrame, over: float, max_repeat: float, entropy: float | None) -> float:
    """sizes(ls): log shares. The largest exponent whose entropy reaches ``entropy`` (a fraction of the greatest), or
    0 without one; raised as far as needed to keep every source within ``max_repeat`` passes, at most to 1. ``over`` is
    the budget over all tokens; where it exceeds ``max_repeat`` itself, no exponent can keep the limit and 1 is used."""
    n = sizes.count()
    if n < 2:
        return 1.0

    def narrowed(fits) -> float:
        """Least exponent that fits, to 16**-ROUNDS; 1 if none does."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            step = (hi - lo) / 16
            found = _measures(sizes, [lo + step * i for i in range(17)], over)
            good = [i for i, (_, h, r) in enumerate(found) if fits(h, r)]
            first = good[0] if good else 16
            lo, hi = lo + step * max(0, first - 1), lo + step * first
            if not first:
                return lo
        return hi

    at = narrowed(lambda h, r: h <= entropy * math.log(n)) if entropy is not None else 0.0
    return round(max(at, narrowed(lambda h, r: r <= max_repeat)), 6)


def _cut(rows: DataFrame, by: list[str], order, room: str = "room") -> DataFrame:
    """Marks rows(n_tokens, room, …) in order: ``full`` while they fit, ``edge`` where the room ends; ``left`` before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_c", F.sum("n_tokens").over(w)).withColumn("left", F.col(room) - F.col("_c") + F.col("n_tokens"))
    return rows.withColumns({"full": F.col("_c") <= F.col(room), "edge": (F.col("_c") > F.col(room)) & (F.col("left") > 0)}).drop("_c")


def mixture(docs: DataFrame, budget: int | None = None, max_repeat: float = 4.0, entropy: float | None = None, seed: int = 11) -> DataFrame:
    """Rows of the mix of docs(doc_id, text, source): (doc_id, source, n_tokens, copies, weight, epoch, block,
    block_key, doc_key), one for each pass a unit takes part in; sorting by epoch, block_key, doc_key gives the order.

    ``budget`` is in tokens, by default as many as there are. A source's tokens in the mix are at most its share of the
    budget and fall short by less than one unit. Units without tokens are in every whole pass. Ties of a key are
    broken by doc_id. Empty tables give no rows; other columns are ignored.
    """
    u = units(docs)
    mark = F.xxhash64("doc_id", F.lit(seed))
    u = staged(u.withColumns({"b1": F.shiftrightunsigned(mark, 52).cast("int"), "b2": (F.shiftrightunsigned(mark, 40) % BLOCKS).cast("int")}))
    sizes = staged(u.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    shares = staged(sizes.where("tokens > 0").withColumn("ls", F.log(F.col("tokens") / F.lit(float(max(total, 1))))))
    e = exponent(shares.select("ls"), budget / max(total, 1), max_repeat, entropy)
    z = shares.agg(F.sum(F.exp(F.col("ls") * e))).first()[0] or 1.0
    plan = shares.withColumn("weight", F.round(F.exp(F.col("ls") * e) / F.lit(z), 9)).withColumn("share", F.floor(F.col("weight") * F.lit(float(budget))).cast("bigint"))
    plan = plan.withColumn("passes", F.floor(F.col("share") / F.col("tokens")).cast("int")).withColumn("room", F.col("share") - F.col("passes") * F.col("tokens"))
    plan = staged(plan.select("source", "weight", "passes", "room"))
    known = u.join(small(plan), "source")
    out = ["doc_id", "source", "n_tokens", "copies", "weight", "b1"]
    whole = known.where("passes > 0").select(*out, F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("epoch"))
    turn = lambda *c: F.xxhash64(*c, "source", "epoch", F.lit(seed))
    last = known.where("room > 0").withColumn("epoch", F.col("passes"))
    blocks = last.groupBy("source", "b1", "epoch", "room").agg(F.sum("n_tokens").alias("n_tokens"))
    blocks = staged(_cut(blocks, ["source"], [turn("b1"), "b1"]).where("full or edge").select("source", "b1", "full", "left"))
    taken = last.join(small(blocks), ["source", "b1"])
    edge = staged(taken.where("not full").drop("full", "room").withColumnRenamed("left", "room"))
    parts = edge.groupBy("source", "b1", "b2", "epoch", "room").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = staged(_cut(parts, ["source"], [turn("b1", "b2"), "b2"]).where("full or edge").select("source", "b1", "b2", "full", "left"))
    inner = edge.join(small(parts), ["source", "b1", "b2"])
    single = _cut(inner.where("not full").drop("full", "room").withColumnRenamed("left", "room"), ["source", "b1", "b2"], [turn("doc_id"), "doc_id"])
    rows = whole
    for part in (taken.where("full"), inner.where("full"), single.where("full")):
        rows = rows.union(part.select(*out, "epoch"))
    return rows.select(
        "doc_id", "source", "n_tokens", "copies", "weight", "epoch", F.col("b1").alias("block"),
        turn("b1").alias("block_key"), turn("doc_id").alias("doc_key"),
    )
