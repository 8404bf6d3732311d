"""Benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of a benchmark item (a shorter item is one window). A document holds a window
only if it holds all of the window's shingles, so one necessary shingle is enough to find it: the rarest, by its count
over all documents. Document positions that hold such a shingle are joined with their windows; the shingle's place in
the window gives the only possible start, which must lie inside the document with the whole length, and the words
there are compared one by one.

The windows are dealt by hash into blocks of at most ``block_bytes``; documents are read twice a block (counts, join),
so a benchmark of any size never needs more than one block in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm import words as W
from llm.common import Sent, ragged, slices

GRAM = 4
BLOCK_BYTES = 32 << 20
MASK = np.uint64((1 << 22) - 1)
HITS = "doc_id bigint, key bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = W.words(part["text"], W.ALNUM)
                ids, keys, rows = [], [], []
                for item, a, b in zip(part["item_id"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    m = min(size, b - a)
                    for s in range(a, b - m + 1) if m else ():
                        ids.append(item)
                        rows.append(hashes[s : s + m].view(np.int64))
                        keys.append(int(W.short(hashes[s : s + m]).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), ragged(rows, np.int64), pa.array(ids, pa.string())], ["key", "words", "item"]
                )

    return run


class _Index:
    """One block of windows, ready to be looked up."""

    def __init__(self, rows: list, counts: dict[int, int] | None = None):
        self.words = [np.array(r["words"], np.int64).view(np.uint64) for r in rows]
        self.items = [sorted(r["items"]) for r in rows]
        self.grams: dict[int, list] = {}
        for w, x in enumerate(self.words):
            g = min(GRAM, len(x))
            self.grams.setdefault(g, []).append((w, W.windows(x, g)))
        self.tables = {}
        for g, entries in self.grams.items():
            if counts is None:
                found = np.unique(np.concatenate([s for _, s in entries]))
                self.tables[g] = (found, self._bits(found))
                continue
            token, window, place = [], [], []
            for w, s in entries:
                rank = [(counts.get(int(x.view(np.int64)), 0), int(x)) for x in s]
                j = rank.index(min(rank))
                token.append(s[j])
                window.append(w)
                place.append(j)
            order = np.argsort(np.array(token, np.uint64), kind="stable")
            token, window, place = (np.array(x)[order] for x in (np.array(token, np.uint64), window, place))
            found, first = np.unique(token, return_index=True)
            self.tables[g] = (found, self._bits(found), np.append(first, len(token)), window, place)

    @staticmethod
    def _bits(found: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(MASK) + 1, bool)
        bits[found & MASK] = True
        return bits

    def where(self, grams: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a text's shingles that the block has, and which of them."""
        found, bits = self.tables[g][:2]
        at = np.flatnonzero(bits[grams & MASK])
        k = np.searchsorted(found, grams[at])
        k[k == len(found)] = 0
        same = found[k] == grams[at]
        return at[same], k[same]


def _ends(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """End of the text that each position lies in."""
    return offsets[np.searchsorted(offsets, at, "right")]


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = shared.value, {}
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = W.words(part["text"], W.ALNUM)
                for g, (found, *_) in index.tables.items():
                    pos, k = index.where(W.windows(hashes, g), g)
                    k = k[pos + g <= _ends(at, pos)]
                    total[g] = total.get(g, 0) + np.bincount(k, minlength=len(found))
        for g, count in total.items():
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(index.tables[g][0][some].view(np.int64)), pa.array(count[some].astype(np.int64))], ["t", "c"])

    return run


def _matches(index: _Index, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows of all occurrences in a slice of texts."""
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g, (_, _, first, window, place) in index.tables.items():
        pos, k = index.where(W.windows(hashes, g), g)
        for a in range(0, len(pos), 1 << 18):
            p, t = pos[a : a + (1 << 18)], k[a : a + (1 << 18)]
            n = first[t + 1] - first[t]
            row = np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            p, w = np.repeat(p, n), window[row]
            start = p - place[row]
            size = np.array([len(x) for x in index.words])[w] if len(w) else np.zeros(0, np.int64)
            begin = at[np.searchsorted(at, p, "right") - 1]
            fits = (start >= begin) & (start + size <= _ends(at, p))
            start, w, size = start[fits], w[fits], size[fits]
            for m in np.unique(size).tolist():
                s, v = start[size == m], w[size == m]
                used, v_local = np.unique(v, return_inverse=True)
                grid = np.array([index.words[i] for i in used]).reshape(len(used), m)
                same = np.ones(len(s), bool)
                for j in range(m):
                    same &= hashes[s + j] == grid[v_local, j]
                starts.append(s[same])
                windows.append(v[same])
    return np.concatenate(starts), np.concatenate(windows)


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        size = np.array([len(x) for x in index.words], np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, at = W.words(part["text"], W.ALNUM)
                start, window = _matches(index, hashes, at)
                order = np.argsort(start, kind="stable")
                start, window = start[order], window[order]
                n = len(at) - 1
                doc = np.searchsorted(at, start, "right") - 1
                cut = np.searchsorted(doc, np.arange(n + 1))
                firsts, lasts, items = [], [], []
                for d in range(n):
                    s, w = start[cut[d] : cut[d + 1]] - at[d], window[cut[d] : cut[d + 1]]
                    if len(s):
                        e = np.maximum.accumulate(s + size[w])
                        new = np.r_[True, s[1:] > e[:-1]]
                        firsts.append(s[new])
                        lasts.append(e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]])
                        items.append(sorted({i for x in np.unique(w).tolist() for i in index.items[x]}))
                    else:
                        firsts.append(s)
                        lasts.append(s)
                        items.append([])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["key"], pa.array(np.diff(at)), ragged(firsts, np.int64), ragged(lasts, np.int64), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "key", "n_words", "starts", "ends", "items"],
                )

    return run


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, n_words, starts, ends, items) of each row of docs(doc_id, text) against benchmark(item_id, text).

    starts and ends are the disjoint word spans covered by occurring windows, items the ids of their items as strings.
    ``key`` is a hash of the text. NULL texts have no words; items without words have no windows; a NULL item_id reads
    as ''; rows of one item_id count as one item. Repeated document rows come back as often as they came, each with
    the same hits. Empty tables give no rows or no hits. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("key", F.xxhash64("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))
    windows = items.mapInArrow(_item_windows(size), "key bigint, words array<bigint>, item string")
    windows = staged(windows.groupBy("key", "words").agg(F.collect_set("item").alias("items")))
    weight = windows.agg(F.sum(400 + F.size("words") * 24 + F.size("items") * 60)).first()[0] or 0
    blocks = max(1, -(-int(weight) // block_bytes))
    parts = []
    for b in range(blocks):
        rows = windows.where(F.pmod("key", F.lit(blocks)) == b).collect()
        counted = Sent(spark, _Index(rows))
        seen = docs.select("text").mapInArrow(_counter(counted), "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c"))
        counts = {r["t"]: r["c"] for r in seen.collect()}
        index = Sent(spark, _Index(rows, counts))
        parts.append(docs.mapInArrow(_finder(index), HITS))
    if blocks == 1:
        return parts[0]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.union(p)
    list_all = lambda c: F.flatten(F.collect_list(c))
    spans = F.array_sort(F.arrays_zip(list_all("starts").alias("starts"), list_all("ends").alias("ends")))
    merged = joined.groupBy("doc_id", "key", "n_words").agg(
        spans.alias("spans"), F.array_sort(F.array_distinct(list_all("items"))).alias("items"), (F.count("*") / blocks).cast("int").alias("copies")
    )
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, F.lit(-1))["ends"] >= x["starts"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, F.lit(-1))["starts"].alias("starts"), F.greatest(F.element_at(acc, F.lit(-1))["ends"], x["ends"]).alias("ends")))),
    ).otherwise(F.concat(acc, F.array(x)))
    empty = F.array().cast("array<struct<starts:bigint,ends:bigint>>")
    merged = merged.withColumn("spans", F.aggregate("spans", empty, step))
    return merged.select(
        "doc_id", "key", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items",
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")


def judged(found: DataFrame) -> DataFrame:
    """The result of :func:`hits` as counts: n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )
