"""Repeated passages by a sparse suffix array.

Suffixes start only at minimisers: positions whose hash of GRAM words is the least of SPAN consecutive ones. That depends
on the words alone, and every run of LEAST words holds one, so a passage of LEAST words that occurs twice has a suffix at
the same place in both. Suffixes whose first GRAM words occur once go. The rest are sorted by the words that follow; each
is compared with its neighbours, and matches are extended to the right and to the left. One suffix of each
context is sorted again by the words before it, where neighbours share the longest left side.

Where more than NEAR + 1 suffixes share their GRAM words, neighbours need not hold the longest match. There every window
of LEAST words is counted by its hash as well. Each window belongs to one minimiser, its leftmost least gram.

Texts of equal words are one class, represented once. The sorts are range-partitioned by whole keys down to class and
position, so a passage in a third of all documents fills as many tasks as it needs; the first and last NEAR suffixes of
every range are compared in a second, small pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ebbline.staging import staged
from llm import words as W
from llm.common import ragged, slices, small

LEAST = 50
GRAM = 8
SPAN = LEAST - GRAM + 1
LEFT = LEAST - GRAM
#: Neighbours on either side that a suffix is compared with; larger groups are settled by their windows.
NEAR = 6
SEEN = "doc_id bigint, key bigint, class bigint, n_words bigint, grams array<bigint>, places array<bigint>, first array<tinyint>, last array<tinyint>"
SUFFIX = "class bigint, pos bigint, ahead binary, behind binary, start bigint, windows array<bigint>"
MATCH = "class bigint, lo bigint, hi bigint, across boolean, part int, pos bigint, ahead binary, behind binary"


def minimisers(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Places of the least value (the first of equal ones) of all runs of ``span`` values."""
    return np.unique(_least(grams, span))


def _least(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the least value (the first of equal ones) of each run of ``span`` values; never falls."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    rows = -(-len(grams) // span)
    x = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    x[: len(grams)] = grams
    x = x.reshape(rows, span)
    place = np.arange(rows * span).reshape(rows, span)
    ahead = np.minimum.accumulate(x, 1)
    new = np.ones_like(x, bool)
    new[:, 1:] = x[:, 1:] < ahead[:, :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), 1)
    behind = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1]
    new = np.ones_like(x, bool)
    new[:, :-1] = x[:, :-1] <= behind[:, 1:]
    last = np.minimum.accumulate(np.where(new, place, rows * span)[:, ::-1], 1)[:, ::-1]
    a, b = behind.ravel()[:n], ahead.ravel()[span - 1 : span - 1 + n]
    return np.where(a <= b, last.ravel()[:n], first.ravel()[span - 1 : span - 1 + n])


def _class(hashes: np.ndarray) -> int:
    """A hash of a text's words in order."""
    x = W.mix(hashes + np.arange(1, len(hashes) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)
    return int(W.mix(np.array([x + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, at = W.words(part["text"])
            every = W.windows(hashes, GRAM)
            classes, grams, places, first, last = [], [], [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                classes.append(_class(hashes[a:b]))
                own = every[a : max(a, b - GRAM + 1)]
                p, at_first, times = np.unique(_least(own, SPAN), return_index=True, return_counts=True)
                places.append(p)
                first.append(p - at_first)
                last.append(p - at_first - times + 1)
                grams.append(own[p].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"], part["key"], pa.array(classes, pa.int64()), pa.array(np.diff(at)), ragged(grams, np.int64),
                    ragged(places, np.int64), ragged(first, np.int8), ragged(last, np.int8),
                ],
                ["doc_id", "key", "class", "n_words", "grams", "places", "first", "last"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, at = W.words(part["text"])
            short = (hashes >> np.uint64(32)).astype(">u4")
            back = short[::-1].tobytes()
            raw, size = short.tobytes(), len(short)
            every = W.windows(hashes, LEAST).view(np.int64)
            out, windows = [[], [], [], [], []], []
            for i, (places, first, last, cls) in enumerate(zip(*(part[c].to_pylist() for c in ("places", "first", "last", "class")), strict=True)):
                a, b = int(at[i]), int(at[i + 1])
                if _class(hashes[a:b]) != cls:
                    continue
                for p, f, z in zip(places, first, last, strict=True):
                    q = a + p
                    out[0].append(cls)
                    out[1].append(p)
                    out[2].append(raw[4 * q : 4 * min(b, q + LEAST)])
                    out[3].append(back[4 * (size - q) : 4 * (size - max(a, q - LEFT))])
                    out[4].append(None if f is None else p - f)
                    windows.append(every[:0] if f is None else every[q - f : q - z + 1])
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(out, types, strict=True)), ragged(windows, np.int64)],
                ["class", "pos", "ahead", "behind", "start", "windows"],
            )


def _matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each context, and how many there are."""
    values = values.cast(pa.large_binary())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint32)
    n = (np.diff(at) // 4).astype(np.int64)
    out = np.zeros((len(values), width), np.uint32)
    inside = np.arange(width) < n[:, None]
    out[inside] = data[at[0] // 4 : at[-1] // 4]
    return out, n


def _common(m: np.ndarray, n: np.ndarray, d: int) -> np.ndarray:
    """Equal leading words of each row and the d-th after it."""
    same = (m[d:] == m[:-d]) & (np.arange(m.shape[1]) < np.minimum(n[d:], n[:-d])[:, None])
    return np.where(same.all(1), m.shape[1], np.argmin(same, 1))


def _neighbours(edges: bool, again: bool):
    """Spans of sorted suffixes that match a neighbour in LEAST words or more; with ``edges`` the ends of the range,
    with ``again`` one suffix of each whole context, to be compared in another order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        held, full, opened = None, np.zeros(0, bool), 0 if edges else NEAR

        def judged(rows: pa.Table, full: np.ndarray, free: int) -> pa.RecordBatch:
            """Matches of each row with the next NEAR; of the first ``free`` rows those that go on."""
            cls, pos, ahead, behind = (pa.concat_arrays(rows[c].chunks) for c in ("class", "pos", "ahead", "behind"))
            cls, pos, right, left = np.asarray(cls), np.asarray(pos), _matrix(ahead, LEAST), _matrix(behind, LEFT)
            out = [[], [], [], []]
            for d in range(1, min(NEAR, len(cls) - 1) + 1):
                r, l = _common(*right, d), _common(*left, d)  # noqa: E741
                good = np.flatnonzero((r >= GRAM) & (l + r >= LEAST) & ((cls[d:] != cls[:-d]) | (pos[d:] != pos[:-d])))
                full[good[(l[good] == LEFT) & (r[good] == LEAST)] + d] = True
                for shift in (0, d):
                    at = good + shift
                    for x, v in zip(out, (cls[at], pos[at] - l[good], pos[at] + r[good], cls[good] != cls[good + d]), strict=True):
                        x.append(v)
            spans = [np.concatenate(x) for x in out] if out[0] else None
            on = rows.take(pa.array(np.flatnonzero(~full[:free]))) if again else rows.slice(0, 0)
            return _spans(spans, len(spans[0]) if spans else 0, on, None)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch.select(["class", "pos", "ahead", "behind"])])
            if opened < NEAR:
                yield _spans(None, 0, rows.slice(0, NEAR - opened), part)
                opened = min(NEAR, opened + rows.num_rows)
            full = np.r_[full, np.zeros(rows.num_rows, bool)]
            rows = rows if held is None else pa.concat_tables([held, rows])
            free = max(0, rows.num_rows - NEAR)
            yield judged(rows, full, free)
            held, full = rows.slice(free), full[free:]
        if held is not None:
            if again:
                yield _spans(None, 0, held.take(pa.array(np.flatnonzero(~full))), None)
            if edges:
                yield _spans(None, 0, held, part)

    return run


def _spans(spans, m: int, rows: pa.Table, part: int | None) -> pa.RecordBatch:
    """Spans, then suffixes that go on (part -1) or stand at the edge of a range."""
    k = rows.num_rows
    cols = [pa.array(x) for x in spans] if m else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_())]
    rest = [pa.concat_arrays([c.cast(t), pa.nulls(k, t)]) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.bool_()), strict=True)]
    flat = lambda c: pa.concat_arrays(rows[c].chunks) if rows[c].num_chunks else pa.array([], rows[c].type)
    wide = lambda c, t: pa.concat_arrays([pa.nulls(m, t), flat(c).cast(t)])
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([cols[0].cast(pa.int64()), flat("class").cast(pa.int64())]), *rest,
            pa.array([None] * m + [-1 if part is None else part] * k, pa.int32()),
            wide("pos", pa.int64()), wide("ahead", pa.binary()), wide("behind", pa.binary()),
        ],
        [x.split()[0] for x in MATCH.split(", ")],
    )


def _compared(suffixes: DataFrame, order: list, again: bool) -> DataFrame:
    order = [*order, "class", "pos"]
    ranged = suffixes.select("class", "pos", "ahead", "behind").repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(ranged.mapInArrow(_neighbours(True, again), MATCH))
    ends = found.where("part >= 0").select("class", "pos", "ahead", "behind", "part").coalesce(1).sortWithinPartitions("part", *order)
    return found.where("part is null or part < 0").union(ends.mapInArrow(_neighbours(False, False), MATCH))


#: Two places or more, of the least and largest ones that _ends gives.
REPEATED = "c0 <> c1 or p0 <> p1"


def _ends(place: str) -> list:
    return [f(c).alias(a) for c, a0, a1 in (("class", "c0", "c1"), (place, "p0", "p1")) for f, a in ((F.min, a0), (F.max, a1))]


def _counted(suffixes: DataFrame) -> DataFrame:
    """Spans of the stored windows that occur at two places or more."""
    windows = suffixes.select("class", "start", F.posexplode("windows").alias("k", "h")).select("class", "h", (F.col("start") + F.col("k")).alias("lo"))
    again = staged(windows.groupBy("h").agg(*_ends("lo")).where(REPEATED).select("h", F.expr("c0 <> c1").alias("across")))
    return windows.join(small(again), "h").select("class", "lo", (F.col("lo") + LEAST).alias("hi"), "across")


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, across): word spans of docs(doc_id, text) covered by passages of LEAST words or more that
    occur twice; ``across`` tells whether in another document (or only in this one).

    Words are compared with A-Z lower-cased. Overlapping spans of a document are one. NULL and short texts have none.
    Repeated rows (same doc_id and text) are one document; texts of equal words under several ids are repeated as a
    whole. A NULL doc_id is a document of its own text. Empty tables give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    seen = staged(docs.mapInArrow(_seen, SEEN).where(F.col("n_words") >= LEAST))
    texts = seen.select("doc_id", "key", "class", "n_words").distinct()
    starts = seen.select("class", F.explode(F.arrays_zip("grams", "places", "first", "last")).alias("x"))
    starts = starts.select("class", F.col("x.grams").alias("gram"), F.col("x.places").alias("pos"), "x.first", "x.last")
    counted = starts.groupBy("gram").agg(*_ends("pos"), F.count("*").alias("n"))
    twice = staged(counted.where(REPEATED).select("gram", (F.col("n") > NEAR + 1).alias("many")))
    own = F.struct("pos", *(F.when(F.col("many"), F.col(c)).alias(c) for c in ("first", "last")))
    wanted = starts.join(small(twice), "gram").groupBy("class").agg(F.collect_set(own).alias("x"))
    wanted = wanted.select("class", F.col("x.pos").alias("places"), "x.first", "x.last")
    one = seen.groupBy("class").agg(F.min(F.struct("key", "doc_id")).alias("o")).select("class", F.col("o.key").alias("key"), F.col("o.doc_id").alias("o_id"))
    wanted = staged(wanted.join(one, "class"))
    fetched = docs.join(small(wanted), "key").where(F.col("doc_id").eqNullSafe(F.col("o_id"))).select("text", "class", "places", "first", "last")
    suffixes = staged(fetched.mapInArrow(_contexts, SUFFIX))
    found = staged(_compared(suffixes, ["ahead", "behind"], True))
    rest = staged(_compared(found.where("part = -1"), [F.substring("ahead", 1, 4 * GRAM), "behind", "ahead"], False))
    spans = found.where("part is null").union(rest.where("part is null")).select("class", "lo", "hi", "across").union(_counted(suffixes))
    ids = texts.groupBy("class").agg(F.count_distinct(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("ids"), F.max("n_words").alias("n"))
    whole = ids.where("ids > 1").select("class", F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi"), F.lit(True).alias("across"))
    merged = spans.union(whole).groupBy("class").agg(F.array_sort(F.collect_set(F.struct("lo", "hi", "across"))).alias("s"))
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, F.lit(-1))["hi"] >= x["lo"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(
                F.element_at(acc, F.lit(-1))["lo"].alias("lo"), F.greatest(F.element_at(acc, F.lit(-1))["hi"], x["hi"]).alias("hi"),
                (F.element_at(acc, F.lit(-1))["across"] | x["across"]).alias("across"),
            )),
        ),
    ).otherwise(F.concat(acc, F.array(x)))
    merged = merged.select("class", F.aggregate("s", F.array().cast("array<struct<lo:bigint,hi:bigint,across:boolean>>"), step).alias("s"))
    out = texts.select("doc_id", "class").distinct().join(merged, "class").select("doc_id", F.explode("s").alias("x"))
    return out.select("doc_id", F.col("x.lo").alias("start"), F.col("x.hi").alias("end"), F.col("x.across").alias("across"))
