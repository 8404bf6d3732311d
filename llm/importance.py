"""Importance resampling towards a target, over hashed word features.

A feature is a run of consecutive words; its bucket is the CRC-32 of its bytes modulo the bucket count. Features of the
raw documents and of the target are counted by bucket; a bucket's gain is the scaled log ratio of the smoothed shares, a
document's weight the sum of its features' gains. Adding Gumbel noise from a seeded hash and taking the highest scores
draws without replacement in proportion to exp(weight).

CRC-32 is affine over XOR: the checksum of a text is the XOR of one contribution per byte, which depends on the byte and
its distance from the end, and of a constant per length. So a batch's checksums are one table lookup per byte and one
``bitwise_xor.reduceat`` over the feature spans. Spans longer than the table are cut into blocks from their end on, and
neighbouring blocks are folded until one is left: a register is carried over zero bytes by four byte tables, as that is
linear too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm import words as W
from llm.common import Sent, slices

#: Distances from the end that the position table holds; longer spans are folded in blocks of this length.
SPAN = 64
#: Bytes that are looked up at once.
CHUNK = 1 << 20
_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)


def _positions(span: int) -> np.ndarray:
    """[d, b]: what byte b with d bytes after it adds to a register that starts at 0."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    rows = [x]
    while len(rows) < span:
        x = rows[-1]
        rows.append(rows[0][x & np.uint32(255)] ^ (x >> np.uint32(8)))
    return np.array(rows)


def _carried(x: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Registers x after a run of zero bytes, given what each of the four register bytes becomes."""
    x = np.asarray(x, np.uint32)
    return over[0][x & np.uint32(255)] ^ over[1][(x >> np.uint32(8)) & np.uint32(255)] ^ over[2][(x >> np.uint32(16)) & np.uint32(255)] ^ over[3][x >> np.uint32(24)]


_AT = _positions(SPAN)
#: [j]: the four tables of a run of SPAN * 2**j zero bytes. A register's low byte meets the next byte first.
_OVER = [_AT[SPAN - 1 : SPAN - 5 : -1]]
while len(_OVER) < 32:
    _OVER.append(_carried(_OVER[-1], _OVER[-1]))


def _length_constants(lengths: np.ndarray) -> np.ndarray:
    """Checksum of that many zero bytes: the start register carried over them, in powers of two of blocks and the rest."""
    short, x = np.full(SPAN, _ONES), _ONES
    for k in range(1, SPAN):
        x = _AT[0][x & np.uint32(255)] ^ (x >> np.uint32(8))
        short[k] = x
    blocks, rest = np.divmod(lengths, SPAN)
    out = short[rest]
    for j in range(int(blocks.max(initial=0)).bit_length()):
        out = np.where(blocks >> j & 1, _carried(out, _OVER[j]), out)
    return out ^ _ONES


def checksums(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span data[begin:end], begin < end; spans may overlap."""
    lengths = ends - begins
    many = -(-lengths // SPAN)
    first = np.cumsum(many) - many
    back = np.arange(int(many.sum())) - np.repeat(first, many)  # blocks are counted from a span's end
    stop = np.repeat(ends, many) - back * SPAN
    start = np.maximum(np.repeat(begins, many), stop - SPAN)
    x = np.zeros(len(stop), np.uint32)
    upto = np.cumsum(stop - start)
    at = 0
    while at < len(stop):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
        width = stop[at:to] - start[at:to]
        place = np.cumsum(width) - width
        byte = np.arange(int(width.sum())) + np.repeat(start[at:to] - place, width)
        x[at:to] = np.bitwise_xor.reduceat(_AT[np.repeat(stop[at:to] - 1, width) - byte, data[byte]], place)
        at = to
    for over in _OVER:
        if len(x) == len(lengths):
            break
        # every second block is carried over the one after it
        left = np.flatnonzero(back % 2 == 0)
        pair = np.flatnonzero(back % 2 == 1)
        x[pair - 1] ^= _carried(x[pair], over)
        x, back = x[left], back[left] // 2
    return x ^ _length_constants(lengths)


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words in a-z with one space between those of a text; begin and end of each word; n + 1 word offsets."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    word = W.ALNUM[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the separator after a word
    out = np.where(word, data, np.uint8(32))[keep]
    filled = np.flatnonzero(bounds[1:] > bounds[:-1])
    kept = np.zeros(n, np.int64)
    if len(filled):
        kept[filled] = np.add.reduceat(keep, bounds[filled], dtype=np.int64)
    bounds = np.r_[0, np.cumsum(kept)]
    capital = (out >= 65) & (out <= 90)
    out[capital] += np.uint8(32)
    inside = np.zeros(len(out) + 2, bool)
    inside[1:-1] = word = out != 32
    begins, ends = word & ~inside[:-2], word & ~inside[2:]
    cuts = bounds[(bounds > 0) & (bounds < len(out))]
    begins[cuts] |= word[cuts]
    ends[cuts - 1] |= word[cuts - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return out, begins, ends, np.searchsorted(begins, bounds).astype(np.int64)


def features(texts: pa.Array, buckets: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run length from low to high: buckets of all runs in text order, runs per text, words per text."""
    data, begins, ends, at = _joined(texts)
    words = np.diff(at)
    for k in range(low, high + 1):
        runs = np.maximum(words - k + 1, 0)
        first = np.arange(int(runs.sum())) + np.repeat(at[:-1] - (np.cumsum(runs) - runs), runs)
        sums = checksums(data, begins[first], ends[first + k - 1])
        yield (sums % np.uint32(buckets)).astype(np.int64), runs, words


def bucket_counts(texts: DataFrame, buckets: int, low: int, high: int) -> DataFrame:
    """(bucket, n) of the features of texts(text): each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for found, _, _ in features(part["text"], buckets, low, high):
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, low: int, high: int, smooth: int) -> np.ndarray:
    """The gain of each bucket. Its size is ``buckets``, whatever the tables' sizes; so it goes through the driver."""
    counts = [np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)]
    for side, table in enumerate((docs, target)):
        for row in staged(bucket_counts(table, buckets, low, high)).collect():
            counts[side][row.bucket] = row.n
    s, t = (c.astype(np.float64) for c in counts)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + smooth) / ((s + 1) * (t.sum() + smooth)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, low: int, high: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of docs(doc_id, text)."""
    sent, buckets = Sent(docs.sparkSession, gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                n, weight, words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for found, runs, words in features(part["text"], buckets, low, high):  # noqa: B007
                    n += runs
                    upto = np.r_[0, np.cumsum(gain[found])]
                    weight += np.array([upto[b] - upto[a] for a, b in pairwise(np.r_[0, np.cumsum(runs)].tolist())], np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with ``rank`` 1, 2, 3... in that order: a range exchange, a sort in each range and the ranges' offsets.

    A last random part of the order lets equal rows fall into several ranges. The sorted rows are stored with their place
    once, so a lost executor changes no rank; the offsets are one row for each range.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    sorted_rows = rows.withColumn("tie", tie).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    placed = staged(sorted_rows.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    ranges = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = staged(ranges.select("part", F.coalesce(before, F.lit(0)).alias("before")))
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "place")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, low: int = 1, high: int = 1, smooth: int = 10_000, seed: str = "2024",
    percent: int = 10, min_words: int = 20,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs(doc_id, text) against target(text).

    Features are the runs of low to high words. Of the N documents with min_words or more, the floor(percent * N / 100)
    highest scores are drawn and numbered, ties to the smaller doc_id; other ranks are NULL. A NULL text has no words, a
    document without features weight 0, a text of any length is taken whole. Rows that repeat a doc_id have the same
    noise and are drawn one by one; equal rows take their ranks in any order. A NULL doc_id counts as an empty string in
    the noise and comes before others in a tie. Other columns are ignored. An empty table gives no rows; an empty target
    makes every gain depend on the documents' own counts alone.
    """
    gain = gains(docs, target, buckets, low, high, smooth)
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((hashed.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = staged(weighed(docs, gain, low, high).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    ranked = _numbered(scored.where(able), [F.desc("score"), F.asc("doc_id")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
