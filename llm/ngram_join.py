"""N-gram Jaccard join by a token-group matrix.

A document's tokens are the 64-bit hashes of its distinct word shingles. Documents with equal sets form a class. Then

1. *Tokens met nowhere else.* All (token, class) entries are dealt by token range in compressed form; a token met within
   one task's buffer by several classes is sent once as "shared", so a token of a third of all documents is a few
   entries. A class can only have links if enough of its tokens are shared (75 % at similarity 0.75); the rest go.
2. *Groups.* The others are put together with the most typical document of each min-hash key, and true links make
   groups of similar documents.
3. *Matrix.* Groups are cut by size into parts of at most about MEMBERS documents, and (token, part) rows hold each
   part's token union. Documents of the smaller of two components ask: those with too few tokens in greater components
   are done; of the others the rarest tokens that a link must share find parts, the overlap with a part's union bounds
   what any member can have, and only parts over the bound are opened and their members compared.

All steps are exact: bounds only drop what cannot link. Links inside a group change no component and are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm import words as W
from llm.common import input_bytes, looked_up, ragged, slices, small
from llm.components import components

FLUSH = 1_000_000
COUNTS = "doc_id bigint, n bigint, d1 bigint, d2 bigint, name bigint, shared bigint"
FACTS = "piece int, blob binary, " + COUNTS
SETS = "doc_id bigint, n bigint, shared bigint, keys array<bigint>, tokens array<bigint>"
KEYS = 3
#: Documents of a group of the matrix, on average at most.
MEMBERS = 32
#: Token ranges, at least; more where the input has over 10 MB for each.
PIECES = 128


def _digest(u: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums over a set, as signed numbers."""
    a, b = int(u.sum(dtype=np.uint64)), int(W.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _class_hash(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return W.mix(d1.astype(np.uint64) ^ W.mix(d2.astype(np.uint64)))


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(b: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * width).reshape(width, n).T).view(dtype).ravel()


def _place(tokens: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece of each token and 32 further bits of it; both keep the tokens' order."""
    x = (tokens >> np.uint64(24)) * np.uint64(pieces)
    return (x >> np.uint64(40)).astype(np.int64), ((x >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class _Buffer:
    """Sets of one task until they are sent on. Copies within the buffer are sent once."""

    def __init__(self, pieces: int):
        self.pieces, self.pack = pieces, pa.Codec("zstd", 1)
        self.clear()

    def clear(self):
        self.docs, self.sets, self.index, self.size = [], [], {}, 0

    def add(self, doc_id, u: np.ndarray):
        key = (len(u), *_digest(u))
        if key not in self.index:
            self.index[key] = len(self.sets)
            self.sets.append(u)
            self.size += len(u)
        self.docs.append((doc_id, key))

    def rows(self) -> Iterator[pa.RecordBatch]:
        keys = list(self.index)
        names = _class_hash(*(np.array([k[i] for k in keys], np.int64) for i in (1, 2)))
        shared = np.zeros(len(keys), np.int64)
        if self.size:
            tokens = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets), dtype=np.uint32), [len(s) for s in self.sets])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            many = np.diff(np.r_[first, len(tokens)]) > 1
            shared += np.bincount(owner[np.repeat(many, np.diff(np.r_[first, len(tokens)]))], minlength=len(keys))
            tokens, owner = tokens[first], owner[first] + np.uint32(1)
            owner[many] = 0
            piece, rest = _place(tokens, self.pieces)
            cut = np.searchsorted(piece, np.arange(self.pieces + 1))
            ids, blobs = [], []
            for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                a, b = cut[p], cut[p + 1]
                own, local = np.unique(owner[a:b], return_inverse=True)
                named = names[own[own > 0] - 1]
                flag = int(own[0] == 0)
                raw = b"".join((
                    np.array([b - a, len(named), flag], np.int64).tobytes(), named.tobytes(),
                    _planes(np.diff(rest[a:b], prepend=np.uint32(0))), _planes(local.astype(np.uint32)),
                ))
                ids.append(p)
                blobs.append(len(raw).to_bytes(8, "little") + self.pack.compress(raw, asbytes=True))
            none = pa.nulls(len(ids), pa.int64())
            yield _facts(pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), *[none] * 6)
        n = len(self.docs)
        if n:
            at = [self.index[k] for _, k in self.docs]
            told = set()
            local = [0 if i in told or told.add(i) else int(shared[i]) for i in at]
            cols = [[d for d, _ in self.docs], *([k[j] for _, k in self.docs] for j in range(3)), names.view(np.int64)[at], local]
            spread = pa.array([-1 - i % self.pieces for i in range(n)], pa.int32())
            yield _facts(spread, pa.nulls(n, pa.binary()), *(pa.array(c, pa.int64()) for c in cols))
        self.clear()


def _facts(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["piece", "blob", "doc_id", "n", "d1", "d2", "name", "shared"])


def _entries(pieces: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Buffer(pieces)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, s in zip(part["doc_id"].to_pylist(), W.shingles(part["text"], k), strict=True):
                    held.add(doc_id, np.unique(s))
                    if held.size > FLUSH:
                        yield from held.rows()
        yield from held.rows()

    return run


def _met(group: pa.Table) -> pa.Table:
    """One piece: how many of each class's tokens other classes have too. Document rows pass."""
    names = ["doc_id", "n", "d1", "d2", "name", "shared"]
    if not group.num_rows or group["piece"][0].as_py() < 0:
        return group.select(names)
    pack, rests, owners = pa.Codec("zstd"), [], []
    for blob in group["blob"]:
        b = memoryview(blob.as_buffer())
        raw = pack.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)
        n, m, flag = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24 + 8 * m
        named = np.concatenate([np.zeros(flag, np.uint64), np.frombuffer(raw, np.uint64, m, 24)])
        rests.append(np.cumsum(_unplanes(raw[at : at + 4 * n], n, np.uint32), dtype=np.uint32))
        owners.append(named[_unplanes(raw[at + 4 * n :], n, np.uint32)])
    rest, owner = np.concatenate(rests), np.concatenate(owners)
    order = np.argsort(rest, kind="stable")
    rest, owner = rest[order], owner[order]
    first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
    apart = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    marked = np.minimum.reduceat(owner, first) == 0
    shared = owner[np.repeat(apart | marked, np.diff(np.r_[first, len(rest)]))]
    found, count = np.unique(shared[shared > 0], return_counts=True)
    none = pa.nulls(len(found), pa.int64())
    return pa.table([none] * 4 + [pa.array(found.view(np.int64)), pa.array(count.astype(np.int64))], names=names)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = [np.uint64(0x1000193 * (2 * j + 1)) for j in range(KEYS)]
        for batch in batches:
            for part in slices(batch, "text"):
                rows = {c: part[c].to_pylist() for c in ("doc_id", "d1", "d2", "shared")}
                out = [[] for _ in range(5)]
                for i, s in enumerate(W.shingles(part["text"], k)):
                    u = np.unique(s)
                    if _digest(u) == (rows["d1"][i], rows["d2"][i]):
                        keys = np.array([W.mix(u ^ seed).min() for seed in seeds], np.uint64)
                        for col, v in zip(out, (rows["doc_id"][i], len(u), rows["shared"][i], keys.view(np.int64), u.view(np.int64)), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in out[:3]), *(ragged(c, np.int64) for c in out[3:])],
                    ["doc_id", "n", "shared", "keys", "tokens"],
                )

    return run


def similar(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text); other columns are ignored.

    Rows link when den * |intersection| >= num * |union| of their distinct k-word shingles (a shorter text is one
    shingle). component_id is the least doc_id reachable. NULL and wordless texts have no shingles and no links.
    Repeated rows come back as often as they came; rows with the same doc_id are one node. A NULL doc_id is kept and
    gets its component's id if other rows of it have ids, else NULL. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    pieces = min(1 << 16, max(PIECES, input_bytes(docs) // (10 << 20)))
    met = docs.mapInArrow(_entries(pieces, k), FACTS).groupBy("piece").applyInArrow(_met, COUNTS)
    facts = staged(met)
    named = F.col("n").isNotNull()
    rows = facts.where(named)
    classes = staged(rows.where("n > 0").groupBy("n", "d1", "d2", "name").agg(F.min("doc_id").alias("doc_id"), F.sum("shared").alias("near")))
    far = facts.where(~named).groupBy("name").agg(F.sum("shared").alias("far"))
    enough = lambda have, n: F.col(have) * den >= num * F.col(n)
    alive = classes.where("doc_id is not null").join(far, "name", "left").withColumn("shared", F.col("near") + F.coalesce("far", F.lit(0)))
    alive = staged(alive.where(enough("shared", "n")).select("doc_id", "d1", "d2", "shared"))
    fetched = docs.where("doc_id is not null").join(small(alive), "doc_id")
    sets = staged(fetched.mapInArrow(_sets(k), SETS))
    group = _groups(sets, num, den)
    of = classes.select("n", "d1", "d2", F.col("doc_id").alias("node")).join(group.select(F.col("doc_id").alias("node"), "component"), "node", "left")
    of = of.select("n", "d1", "d2", F.coalesce("component", "node").alias("c"))
    linked = rows.where("n > 0").join(of, ["n", "d1", "d2"], "left").select("doc_id", "n", F.col("c").alias("component_id"))
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of pairs(a, b) that link."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
    return both.where((den + num) * F.col("both") >= num * (F.col("na") + F.col("nb"))).select("a", "b")


def _groups(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, component) of sets(doc_id, n, shared, keys, tokens).

    Every document meets the most typical one of each of its keys; the matrix finds whatever is left.
    """
    sets = sets.withColumn("shared", F.least("shared", "n"))
    meta = sets.select("doc_id", "n", "shared", F.posexplode("keys").alias("j", "key"))
    best = F.max(F.struct(F.col("shared") / F.col("n"), (-F.col("doc_id")).alias("o"), "n", "shared")).alias("top")
    tops = meta.groupBy("j", "key").agg(F.count("*").alias("c"), best).where("c > 1")
    tops = staged(tops.select("j", "key", (-F.col("top.o")).alias("top"), F.col("top.n").alias("top_n"), F.col("top.shared").alias("top_shared")))
    pairs = meta.join(small(tops), ["j", "key"]).where(F.col("doc_id") != F.col("top"))
    pairs = pairs.where(_may_link("n", "shared", "top_n", "top_shared", num, den)).select(F.col("doc_id").alias("a"), F.col("top").alias("b"))
    links = staged(_linked(staged(pairs.distinct()), sets, num, den))
    member = _placed(sets, components(links))
    more = _across(sets, member, num, den)
    if more is not None:
        member = _placed(sets, components(links.union(more)))
    return member.select("doc_id", "component").distinct()


def _placed(sets: DataFrame, group: DataFrame) -> DataFrame:
    """(doc_id, n, shared, key, component) of each set."""
    docs = sets.select("doc_id", "n", "shared", F.get("keys", F.lit(0)).alias("key")).distinct()
    g = docs.join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return staged(g.withColumn("component", F.coalesce("component", "doc_id")))


def _may_link(n: str, c: str, other_n: str, other_c: str, num: int, den: int):
    """Two sets of n tokens, of which at most c can be in the other: sizes and overlap allow a link."""
    sized = den * F.least(n, other_n) >= num * F.greatest(n, other_n)
    return sized & (num * (F.col(n) + F.col(other_n)) <= (den + num) * F.least(c, other_c))


def _across(sets: DataFrame, member: DataFrame, num: int, den: int) -> DataFrame | None:
    """Links (a, b) between different components, one for each two that link, or None where no document can have one.

    Components are ordered by the power of two of their size, then by id, in one number ``rank`` (the id's low 57 bits).
    Only the lesser one asks: ``c`` of a document is how many of its tokens a greater component holds. So a large family
    of near copies is there to be found, but asks nothing. A partner of size m needs an overlap of num * (n + m) /
    (den + num), so c limits the partner's size, and a token counts only if some document has it whose size is within it. The least size among those gives the least overlap ``need``; with c below it a
    document is done.

    A matrix group is a part of one component, or of the unlinked documents of one min-hash key, of nearly one size.
    """
    band = F.floor(F.log("n") * 50).cast("int")
    sizes = staged(member.groupBy("component").agg(F.count("*").alias("size"), F.count("*").alias("rows")))
    family = F.when(F.col("size") > 1, F.col("component")).otherwise(F.xxhash64(band, "key"))
    member = staged(looked_up(member, sizes, "component").withColumn("family", family))
    many = staged(member.groupBy("family").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"), F.count("*").alias("rows")))
    order = F.shiftleft(F.floor(F.log2("size")).cast("bigint"), 57).bitwiseOR(F.col("component").bitwiseAND((1 << 57) - 1))
    member = looked_up(member, many, "family").withColumn("rank", order)
    group = F.xxhash64("family", band, F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    place = staged(member.withColumn("g", group).select("doc_id", "n", "shared", "rank", "g"))
    limit = F.floor(F.col("shared") * (den + num) / num) - F.col("n")
    tokens = sets.select("doc_id", "n", "tokens").join(small(place), ["doc_id", "n"])
    tokens = tokens.select("doc_id", "n", "shared", "rank", "g", F.explode("tokens").alias("t"))
    matrix = staged(
        tokens.groupBy("t").agg(
            F.min("rank").alias("low"), F.max("rank").alias("top"), F.min("n").alias("least"), F.max(limit).alias("most"), F.count("*").alias("df")
        ).where("low <> top").drop("low")
    )
    met = tokens.drop("g").join(small(matrix), "t").where((F.col("top") > F.col("rank")) & (F.col("least") <= limit) & (F.col("n") <= F.col("most")))
    own = Window.partitionBy("doc_id", "n", "rank")
    need = F.ceil(num * (F.col("n") + F.greatest(F.min("least").over(own), F.ceil(F.col("n") * num / den))) / (den + num))
    asked = met.withColumns({"c": F.count("*").over(own), "need": need}).where("c >= need")
    first = asked.withColumn("r", F.row_number().over(own.orderBy("df", "t"))).where("r <= c - need + 1")
    first = staged(first.select("doc_id", "n", "rank", "c", "need", "t"))
    if first.isEmpty():
        return None
    wanted = staged(first.select("t").distinct())
    union = staged(
        tokens.join(small(wanted), "t", "left_semi").groupBy("t", "g").agg(F.min("n").alias("n_g"), F.max("n").alias("n_top"), F.max("shared").alias("c_g"), F.max("rank").alias("top"))
    )
    floor = F.ceil(F.col("n") * num / den)
    fits = (F.col("n_g") <= F.floor(F.col("n") * den / num)) & (F.col("n_top") >= floor)
    fits = fits & (num * (F.col("n") + F.greatest("n_g", floor)) <= (den + num) * F.least("c", "c_g")) & (F.col("top") > F.col("rank"))
    found = first.join(union, "t").where(fits).groupBy("doc_id", "rank", "n", "c", "need", "g").agg(F.count("*").alias("both"), F.min("n_g").alias("n_g"))
    overlap = F.ceil(num * (F.col("n") + F.greatest("n_g", floor)) / (den + num))
    opened = staged(found.where(F.col("both") + F.col("need") - 1 >= overlap).select("doc_id", "rank", "n", "c", "g"))
    some = staged(opened.select("g").distinct())
    inside = place.join(small(some), "g", "left_semi").join(sets.select("doc_id", "n", "tokens"), ["doc_id", "n"])
    inside = inside.groupBy("g").agg(F.collect_list(F.struct("doc_id", "n", "rank", "shared", "tokens")).alias("members"))
    rows = opened.join(sets.select("doc_id", "n", "tokens"), ["doc_id", "n"]).join(inside, "g")

    def links(m):
        both = num * (F.col("n") + m["n"])
        sized = den * F.least(F.col("n"), m["n"]) >= num * F.greatest(F.col("n"), m["n"])
        able = sized & (both <= (den + num) * F.least(F.col("c"), m["shared"]))
        return (m["rank"] > F.col("rank")) & able & (F.size(F.array_intersect("tokens", m["tokens"])) * (den + num) >= both)

    found = rows.select("doc_id", "rank", F.filter("members", links).alias("x")).where(F.size("x") > 0)
    found = found.select("doc_id", F.col("rank").alias("asks"), F.explode("x").alias("x")).groupBy("asks", "x.rank")
    return staged(found.agg(F.min(F.struct(F.col("doc_id").alias("a"), F.col("x.doc_id").alias("b"))).alias("l")).select("l.a", "l.b"))
