"""Product codes of vectors: Lloyd rounds over partition-local cover trees.

Each task packs its vectors in blocks and builds, once, a cover tree per block and part position: the points in such an
order that every subtree is a range, and per node its centre, its range, its radius and its children, which are a net of
half that radius. The trees are stored. A round reads them with the codebook and descends level by level: by the
triangle inequality an entry can be nearest to some point of a subtree only if its distance to the centre is within two
radii of the least one. Where one entry is left, the whole subtree is assigned and adds its range of the cumulative sums;
ambiguous nodes hand the entries that are left to their children, and single points are compared exactly in integers.
Equal parts of a block are one point with a weight. What tasks send is one sum per codebook entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm.common import Sent, looked_up

#: Vectors of one block; a block's distances are held at once.
BLOCK = 512
#: A child's net is this part of its parent's radius.
SHRINK = 0.5
_LISTS = ("points", "weight", "place", "center", "low", "high", "kids_at", "kids")


class CoverTree:
    """Points in subtree order with weights, and nodes; ``place`` tells where each given row's point stands."""

    def __init__(self, **arrays: np.ndarray):
        self.__dict__ |= arrays

    @classmethod
    def of(cls, rows: np.ndarray) -> CoverTree:
        points, place, weight = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        apart = np.sqrt(_squares(points, points).astype(np.float64))
        order: list[int] = []
        center, low, high, radius, kids = [], [], [], [], []
        todo = [(np.arange(len(points)), -1)]  # the first of a set is its centre; a set's first child holds the centre
        while todo:
            inside, parent = todo.pop()
            node, c = len(center), int(inside[0])
            if parent >= 0:
                kids[parent].append(node)
            near = apart[c, inside]
            center.append(c)
            low.append(len(order))
            high.append(len(order) + len(inside))
            radius.append(float(near.max()))
            kids.append([])
            if len(inside) == 1:
                order.append(c)
                continue
            net, owner = radius[node] * SHRINK, np.zeros(len(inside), np.int64)
            centers = [0]
            while near.max() > net:
                far = int(near.argmax())
                there = apart[inside[far], inside]
                owner[there < near] = len(centers)
                near = np.minimum(near, there)
                centers.append(far)
            for k in range(len(centers) - 1, -1, -1):
                members = np.flatnonzero(owner == k)
                todo.append((inside[np.r_[centers[k], members[members != centers[k]]]], node))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        return cls(
            points=points[order], weight=weight[order], place=at[place.ravel()], center=at[center], low=np.array(low), high=np.array(high),
            radius=np.array(radius), kids_at=np.cumsum([0, *map(len, kids)]), kids=np.array([x for k in kids for x in k], np.int64),
        )

    def assigned(self, codebook: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(low, high, entry) arrays of subtrees whose points all have that nearest entry, ties to the lower one.

        A node's centre is its first child's, so that child takes over the parent's distances.
        """
        nodes, allowed = np.zeros(1, np.int64), np.ones((1, len(codebook)), bool)
        squares = _squares(self.points[self.center[nodes]], codebook)
        while len(nodes):
            radius, bounded = self.radius[nodes], np.where(allowed, squares, np.iinfo(np.int64).max)
            best = bounded.argmin(axis=1)
            distance = np.sqrt(squares.astype(np.float64))
            least = distance[np.arange(len(nodes)), best]
            allowed &= distance <= (least + 2 * radius)[:, None] * (1 + 1e-9) + 1e-6
            sure = (allowed.sum(axis=1) == 1) | (radius == 0)
            yield self.low[nodes[sure]], self.high[nodes[sure]], best[sure]
            parent = np.flatnonzero(~sure)
            begin, end = self.kids_at[nodes[parent]], self.kids_at[nodes[parent] + 1]
            many = end - begin
            first = np.cumsum(many) - many
            of = np.repeat(parent, many)
            nodes = self.kids[np.arange(int(many.sum())) + np.repeat(begin - first, many)]
            allowed, fresh = allowed[of], np.ones(len(nodes), bool)
            fresh[first] = False
            below = squares[of]
            below[fresh] = _squares(self.points[self.center[nodes[fresh]]], codebook)
            squares = below

    def sums(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and component sums of the rows of each entry."""
        upto = np.zeros((len(self.points) + 1, self.points.shape[1] + 1), np.int64)
        np.cumsum(np.c_[self.weight, self.points * self.weight[:, None]], axis=0, out=upto[1:])
        out = np.zeros((len(codebook), upto.shape[1]), np.int64)
        for low, high, entry in self.assigned(codebook):
            np.add.at(out, entry, upto[high] - upto[low])
        return out[:, 0], out[:, 1:]

    def codes(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance to it of each given row."""
        entry = np.zeros(len(self.points), np.int64)
        for low, high, found in self.assigned(codebook):
            width = high - low
            entry[np.arange(int(width.sum())) + np.repeat(low - (np.cumsum(width) - width), width)] = np.repeat(found, width)
        error = ((self.points - codebook[entry]) ** 2).sum(axis=1)
        return entry[self.place], error[self.place]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all of b: in doubles while every sum is under 2**53, else in integers."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    kind = np.float64 if 4 * top * top * a.shape[1] < 1 << 53 else np.int64
    a, b = a.astype(kind), b.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)


def _nested(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One row with a list of lists."""
    flat = pa.array(np.concatenate([a.ravel() for a in arrays]), kind)
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(a.size for a in arrays)]), pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array([0, len(arrays)], pa.int32()), inner)


def _blocks(parts: int, block: int):
    names = ["vec_id", "label", *_LISTS, "radius"]

    def packed(held: pa.RecordBatch) -> pa.RecordBatch:
        n = held.num_rows
        v = held["v"].flatten().to_numpy().reshape(n, -1)
        trees = [CoverTree.of(x) for x in np.split(v, parts, axis=1)]
        one = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held[c]) for c in ("vec_id", "label")]
        lists = [_nested([getattr(t, c) for t in trees], pa.int32()) for c in _LISTS]
        return pa.RecordBatch.from_arrays([*one, *lists, _nested([t.radius for t in trees], pa.float64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block - sum(b.num_rows for b in held)))
                at += held[-1].num_rows
                if sum(b.num_rows for b in held) == block:
                    yield packed(pa.concat_batches(held))
                    held = []
        if held:
            yield packed(pa.concat_batches(held))

    return run


def _trees(batch: pa.RecordBatch, row: int) -> list[CoverTree]:
    columns = {c: batch[c][row].values for c in (*_LISTS, "radius")}
    out = []
    for k in range(len(columns["points"])):
        arrays = {c: x[k].values.to_numpy() for c, x in columns.items()}
        arrays = {c: x if c == "radius" else x.astype(np.int64) for c, x in arrays.items()}
        out.append(CoverTree(**arrays | {"points": arrays["points"].reshape(len(arrays["weight"]), -1)}))
    return out


def _summed(trees: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(part, entry, n, s0, s1, ...): count and component sums of the parts assigned to each entry."""
    sent, width = Sent(trees.sparkSession, codebooks), codebooks[0].shape[1]
    names = ["part", "entry", "n", *(f"s{j}" for j in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        total = np.zeros((len(books), len(books[0]), width + 1), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for k, tree in enumerate(_trees(batch, row)):
                    n, sums = tree.sums(books[k])
                    total[k] += np.c_[n, sums]
        part, entry = np.nonzero(total[..., 0])
        met = total[part, entry]
        columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), *(pa.array(c) for c in met.T.copy())]
        yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"{c} {'int' if c in ('part', 'entry') else 'bigint'}" for c in names)
    return trees.mapInArrow(run, kinds).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:]))


def _coded(trees: DataFrame, codebooks: list[np.ndarray], label: str) -> DataFrame:
    """(vec_id, label, code, error) of each vector."""
    sent = Sent(trees.sparkSession, codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                found = [t.codes(b) for t, b in zip(_trees(batch, row), books, strict=True)]
                digits = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
                step, text = 2 * len(books), digits.tobytes().hex()
                codes = pa.array([text[i : i + step] for i in range(0, len(text), step)])
                error = pa.array(np.sum([x for _, x in found], axis=0))
                yield pa.RecordBatch.from_arrays([batch["vec_id"][row].values, batch["label"][row].values, codes, error], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint")


def integers(rows: DataFrame, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, v) of the usable rows, v the components floor(scale * x).

    Rows go whose vector is NULL or has a NULL, NaN or infinite component. The dimension of the table is the length that
    most of the others have, the greater of two; it is taken down to a multiple of ``parts``, and vectors of another
    length, which no codebook entry can be compared with, go too, as do those whose errors would not fit 64 bits.
    """
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & finite)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = sizes.n if sizes else 0
    if size < parts:
        return rows.where(F.lit(False)).withColumn("v", F.col("v").cast("array<bigint>"))
    fits = math.isqrt(2**62 // size) // 2 / scale
    rows = rows.where((F.size("v") == size) & F.forall("v", lambda x: F.abs(x) < min(fits, 2**30 / scale)))
    return rows.withColumn("v", F.transform(F.slice("v", 1, size // parts * parts), lambda x: F.floor(scale * x)))


def codebooks_text(codebooks: list[np.ndarray]) -> str:
    return ",".join(str(x) for book in codebooks for x in book.ravel().tolist())


def compress(
    rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block: int = BLOCK,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of each usable row of rows(vec_id, embedding, label), and the codebooks by part.

    ``integers`` tells which rows are usable. The codebooks start as the parts of the ``entries`` (256 at most) rows of
    least vec_id, ties by their components, NULL ids last; with fewer rows they have fewer entries. Each of ``rounds``
    rounds moves every entry to the floored mean of the parts nearest to it; an entry without parts stays. Repeated rows
    count as often as they come; a NULL label is a label of its own; other columns are ignored. Without a usable row
    there are no rows and no codebooks. A codebook has entries * dimension / parts numbers, so it goes through the
    driver; vectors, trees and codes do not.
    """
    kind = rows.schema["label"].dataType.simpleString()
    kept = integers(rows, scale, parts)
    start = [r.v for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    if not start:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), []
    books = np.split(np.array(start, np.int64), parts, axis=1)
    schema = ", ".join([f"vec_id array<bigint>, label array<{kind}>", *(f"{c} array<array<int>>" for c in _LISTS), "radius array<array<double>>"])
    trees = staged(kept.mapInArrow(_blocks(parts, block), schema))
    for _ in range(rounds):
        books = [b.copy() for b in books]
        for r in staged(_summed(trees, books)).collect():
            books[r.part][r.entry] = [x // r.n for x in r[3:]]
    return _coded(trees, books, kind), books


def coded(rows: DataFrame, **settings) -> DataFrame:
    """``compress`` with each label's summed error and the digest of the codebooks, as columns."""
    codes, books = compress(rows, **settings)
    codes = staged(codes.withColumn("of", F.struct("label")))
    labels = staged(codes.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")))
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return looked_up(codes, labels, "of").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
