"""Chat formatting from event logs.

A conversation is a log of events: ``message`` (a new message), ``delta`` (more text), ``edit`` (new text) and
``regenerate`` (new text; all later messages go). Folding needs no gathered conversation: an event counts if no later
event regenerates an earlier message, and if its message's text was not replaced later. Both are grouped extremes, the
first over blocks of the log and then within a block. Messages become segments with control strings escaped; the
segments of a conversation, in order, are its formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template and its control strings.
OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(/?(?:s>|INST\]))"
BLOCK = 4096


def escaped(text: Column) -> Column:
    """One backslash more after the bracket of everything that reads as a control string or an escaped one."""
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1$2\\$3")


def unescaped(text: str) -> str:
    return re.sub(rf"([<\[])\\(\\*){_CONTROL}", r"\1\2\3", text)


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) after all of events(conv_id, seq, kind, message, role, text).

    ``message`` numbers a conversation's messages in order (any type that sorts). NULL text is empty, a NULL role is
    the message's other role or empty; unknown kinds and NULL kinds, messages or seq are ignored. Events of one seq
    count in the order message, regenerate, edit, delta, then by text. A NULL conv_id is a conversation of its own. A
    message's deltas meet in one task, as its text does.
    """
    kinds = ("message", "regenerate", "edit", "delta")
    e = events.select("conv_id", "seq", "kind", "message", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    e = e.where(F.col("kind").isin(*kinds) & F.col("message").isNotNull() & F.col("seq").isNotNull())
    e = e.withColumns({"block": F.floor(F.col("seq") / BLOCK), "again": F.when(F.col("kind") == "regenerate", F.col("message"))})
    later = lambda by, order: Window.partitionBy(*by).orderBy(order).rangeBetween(1, Window.unboundedFollowing)
    blocks = e.groupBy("conv_id", "block").agg(F.min("again").alias("m")).withColumn("after", F.min("m").over(later(["conv_id"], F.col("block"))))
    blocks = blocks.where("after is not null").select(F.col("conv_id").alias("bc"), F.col("block").alias("bb"), "after")
    inside = F.min("again").over(later(["conv_id", "block"], F.col("seq")))
    e = e.withColumn("within", inside).join(blocks, F.col("conv_id").eqNullSafe(F.col("bc")) & (F.col("block") == F.col("bb")), "left")
    least = F.least("within", "after")
    e = e.where(least.isNull() | (F.col("message") <= least))
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    of_message = e.groupBy("conv_id", "message").agg(
        F.max("role").alias("role"), F.array_sort(F.collect_list(F.struct("seq", rank.alias("r"), "text"))).alias("log")
    )
    return of_message.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), _latest().alias("text"))


def _latest() -> Column:
    """A message's text: what follows its last message, edit or regenerate event, that event included."""
    starts = F.transform("log", lambda x, i: F.when(x["r"] < 3, i + 1).otherwise(1))
    kept = F.slice("log", F.array_max(starts), F.size("log"))
    return F.array_join(F.transform(kept, lambda x: x["text"]), "")


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, message, segment, loss_start, loss_length): formatted text by message, and the code points of it that
    count for the loss (an assistant's text)."""
    head = F.concat(F.lit(OPEN + HEAD), escaped(F.col("role")), F.lit(BODY))
    body = escaped(F.col("text"))
    return messages.select(
        "conv_id", "message", F.concat(head, body, F.lit(CLOSE)).alias("segment"), F.length(head).alias("loss_start"),
        F.when(F.col("role") == "assistant", F.length(body)).otherwise(0).alias("loss_length"),
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose segments come in order; one conversation's state at a time."""
    shape = re.compile(re.escape(OPEN + HEAD) + "(.*?)" + re.escape(BODY) + "(.*)" + re.escape(CLOSE), re.S)
    done: list[tuple] = []
    held = None

    def closed():
        done.append((held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5]))

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length")]
        for conv, segment, start, length in zip(*cols, strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    closed()
                held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = (unescaped(x) for x in shape.fullmatch(segment).groups())
            held[1] += 1
            held[2].update(f"{role}\n{text}\n".encode())
            if length:
                loss = unescaped(segment[start : start + length])
                held[3] += len(loss)
                held[4].update(loss.encode())
            held[5] += len(segment)
        yield _digests(done)
        done.clear()
    if held is not None:
        closed()
    yield _digests(done)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation, from its formatted text alone: turns, digest of role and text of each, loss text.

    A digest runs over a conversation from its first to its last segment, so those go through one task, sorted on
    disk and read as a stream; memory holds one batch.
    """
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "message")
    return ordered.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(_read_back, DIGESTS)


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Finished conversations(conv_id, turn, role, text) as event logs. Every row is a message; rows of one turn keep
    the order role, text; NULL turns come first."""
    turns = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return turns.select(
        "conv_id", F.coalesce("turn", F.lit(-(1 << 62))).alias("seq"), F.lit("message").alias("kind"),
        F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.row_number().over(same).alias("n")).alias("message"), "role", "text",
    )
