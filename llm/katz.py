"""Language-model scoring by a Katz back-off trigram model over all words.

* Word counts are grouped sums, stored as a table. The CACHED most frequent words are held by every task; that only
  shortens codes and saves joins: a word outside them is carried by its hash and finds its count in the table.
* Trigram instances are dealt, in compressed pieces, by their middle word, or, where that is one of the HOT most frequent
  words, by the history, and where both its words are hot, by the trigram. So a piece holds all instances of a trigram
  and, but for hot histories, all that follows a history and all that follows its second word. Bigrams after a hot word
  are counted before (at most HOT times CACHED, held by every task, and a table for other words).
* A piece counts trigrams, bigrams and histories, and evaluates every instance recursively: trigram, else back-off weight
  and bigram, else back-off weight and unigram. It returns sums per document, and rows for what needs the Good-Turing
  discounts of the whole corpus, a back-off weight or a rare word's count. Those are joined and summed per document.
* A history's back-off weight is the mass its seen successors leave over the lower-order mass of the words not seen after
  it, both exact, so that the probabilities after any history sum to 1 over all words and one unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm import words as W
from llm.common import Sent, input_bytes, slices, small

#: Words whose counts every task holds.
CACHED = (1 << 18) - 1
#: Most frequent words whose instances are dealt by more than one word; the start symbol is always one of them.
HOT = 16
DISCOUNTED = 5
FLUSH = 1_000_000
PIECES = 32
#: Instances that a piece evaluates at once.
AT_ONCE = 400_000
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
_R = [f"n{r}" for r in range(1, DISCOUNTED + 1)]
_M = [f"m{r}" for r in range(1, DISCOUNTED + 1)]
_COLUMNS = ["kind", "key", "h", "w", "n", "x", *_R, *_M, "a", "b"]
FACTS = ", ".join(f"{c} {'int' if c == 'kind' else 'double' if c == 'x' else 'bigint'}" for c in _COLUMNS)
READ = "kind int, key bigint, doc_id bigint, held boolean, w bigint, n bigint, known bigint, base double"


def discounts(counts: dict[int, int]) -> np.ndarray:
    """Good-Turing discounts of counts 0 to DISCOUNTED from counts of counts; where those give no proper fraction, half
    a count is taken off."""
    k, out = DISCOUNTED, np.ones(DISCOUNTED + 1)
    n = [counts.get(r, 0) for r in range(k + 2)]
    share = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class _Found:
    """Places of hashes among some sorted ones; the first bits of a hash tell where to look from."""

    def __init__(self, hashes: np.ndarray):
        bits = max(4, len(hashes).bit_length())
        self.size, self.shift = len(hashes), np.uint64(64 - bits)
        self.hashes = np.append(hashes, np.uint64(2**64 - 1))
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each one, -1 where it is none of them."""
        at = self.first[hashes >> self.shift]
        after = np.flatnonzero(self.hashes[at] < hashes)
        while len(after):
            at[after] += 1
            after = after[self.hashes[at[after]] < hashes[after]]
        at[(self.hashes[at] != hashes) | (at == self.size)] = -1
        return at


class _Model:
    """What every task holds: the cached words' counts, unigram probabilities, bigram counts after hot words. Bounded by
    CACHED and HOT."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, types: int, texts: int, nr: dict[int, int], hot: int):
        order = np.argsort(words)
        self.counts, self.total, self.types = counts[order].astype(np.int64), total, types
        self.size = self.start = len(words)
        self.radix = self.size + 1
        self.hashes, self.found = np.append(words[order], START), _Found(words[order])
        self.history = np.append(self.counts, texts)
        self.d1 = discounts(nr)
        freed = sum(nr.get(r, 0) * r * (1 - self.d1[r]) for r in range(1, DISCOUNTED + 1)) / total if total else 1.0
        self.unknown, self.scale = (freed, 1.0) if freed > 1e-12 else (1 / (total + 1), total / (total + 1))
        self.p1 = np.append(self.scale * self.d1[np.where(self.counts <= DISCOUNTED, self.counts, 0)] * self.counts / max(total, 1), 0.0)
        self.hot = np.zeros(self.size + 1, bool)
        self.hot[np.argsort(-self.counts, kind="stable")[:hot]] = True
        self.hot[self.start] = True
        self.pairs, self.pair_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def after_hot(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        """Codes and counts of the bigrams of a hot word and a cached one; the start comes twice before every text."""
        pairs, counts = np.append(pairs, self.start * self.radix + self.start), np.append(counts, self.history[self.start])
        order = np.argsort(pairs)
        self.pairs, self.pair_counts = pairs[order], counts[order]

    def pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of bigrams of a hot and a cached word."""
        code = first * self.radix + second
        at = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
        return np.where(self.pairs[at] == code, self.pair_counts[at], 0) if len(self.pairs) else np.zeros(len(code), np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places of cached words, -1 for others."""
        return np.where(hashes == START, self.start, self.found.places(hashes))

    def is_hot(self, ids: np.ndarray) -> np.ndarray:
        return (ids >= 0) & (ids < self.radix) & self.hot[np.clip(ids, 0, self.size)]

    def base(self, count):
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.types + 1)))


def _middle(hashes: np.ndarray) -> np.ndarray:
    return W.mix(hashes + np.uint64(1))


def _dealt_by(hashes: np.ndarray, middle: np.ndarray, hot: np.ndarray, b: np.ndarray, a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of what each instance is dealt by; b, a, w are places in the word hashes, whose ``_middle``
    is taken before; hot tells which of them are."""
    by = middle[b]
    at = np.flatnonzero(hot[b])
    by[at] = W.mix(by[at] * W._STEP + hashes[a[at]])
    at = at[hot[a[at]]]
    by[at] = W.mix(by[at] * W._STEP + hashes[w[at]])
    return by


def _with_ends(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = W.words(part["text"])
    n = len(at) - 1
    return np.insert(hashes, at[1:], END), at + np.arange(n + 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        w, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])

    for batch in batches:
        for part in slices(batch, "text"):
            tokens, at = _with_ends(part)
            held.append(tokens[np.repeat(~np.asarray(part["held"].to_numpy(zero_copy_only=False), bool), np.diff(at))])
            size += len(held[-1])
            if size > FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        w, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])

    for batch in batches:
        for part in slices(batch, "text"):
            tokens, at = _with_ends(part)
            held.append(tokens[np.repeat(~_held(part), np.diff(at))])
            size += len(held[-1])
            if size > FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _held(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part["held"].to_numpy(zero_copy_only=False), bool)


def _before(x: np.ndarray, at: np.ndarray, start) -> np.ndarray:
    """The element before each one of its text, ``start`` before the first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1]] = start
    return out


def _reader(shared):
    """Document rows (kind 0), rare words by document (1), training bigrams of a hot and a cached (2) or rare (3) word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        base = np.append(model.base(model.counts), 0.0)
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, at = _with_ends(part)
                ids, held, n, size = model.ids(tokens), _held(part), len(at) - 1, np.diff(at)
                known = np.add.reduceat((ids >= 0).astype(np.int64), at[:-1])
                yield _read(0, n, part["key"], doc_id=part["doc_id"], held=pa.array(held), n=size, known=known, base=np.add.reduceat(base[ids], at[:-1]))
                rare = np.flatnonzero(ids < 0)
                doc, word, count = _runs(np.repeat(np.arange(n), size)[rare], tokens[rare].view(np.int64))
                yield _read(1, len(doc), pa.array(np.asarray(part["key"])[doc]), w=word, n=count)
                first = _before(ids, at, model.start)
                train = ~np.repeat(held, size) & model.is_hot(first)
                pair, count = np.unique(first[train & (ids >= 0)] * model.radix + ids[train & (ids >= 0)], return_counts=True)
                yield _read(2, len(pair), pa.nulls(len(pair), pa.int64()), w=pair, n=count)
                far = train & (ids < 0)
                hot, word, count = _runs(model.hashes[first[far]].view(np.int64), tokens[far].view(np.int64))
                yield _read(3, len(hot), pa.array(hot), w=word, n=count)

    return run


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of two columns and how often each occurs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.diff(np.r_[first, len(a)])


def _read(kind: int, rows: int, key, **given) -> pa.RecordBatch:
    types = {"doc_id": pa.int64(), "held": pa.bool_(), "w": pa.int64(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64()}
    cols = [pa.array(given[c]).cast(t) if c in given else pa.nulls(rows, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays([pa.array([kind] * rows, pa.int32()), key, *cols], ["kind", "key", *types])


def _planes(x: np.ndarray) -> bytes:
    return b"".join((x >> x.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(x.itemsize))


def _unplanes(b: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(dtype).itemsize, n).T).view(dtype).ravel()


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _in_order(b: np.ndarray, a: np.ndarray, w: np.ndarray, owner: np.ndarray, words: int, docs: int) -> list[np.ndarray]:
    """Numbers below words (b, a, w) and docs (owner, ascending) sorted by (b, a, w, owner): as one number where that fits."""
    if words**3 * docs >= 1 << 64:
        order = np.lexsort((w, a, b))
        return [x[order] for x in (b, a, w, owner)]
    code, out = b.astype(np.uint64), []
    for x, radix in ((a, words), (w, words), (owner, docs)):
        code *= np.uint64(radix)
        code += x.astype(np.uint64)
    code.sort()
    for radix in (docs, words, words):
        left = code // np.uint64(radix)
        code -= left * np.uint64(radix)
        out.append(code.astype(np.int64))
        code = left
    return [code.astype(np.int64), *out[::-1]]


def _dealer(shared, pieces: int):
    """Blobs of one piece each: distinct (trigram, document) with their number, cached trigrams as codes, others as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pack = shared.value, pa.Codec("zstd", 1)
        radix, held, size = np.uint64(model.radix), [], 0

        def flush():
            tokens, length, keys, train = (np.concatenate(x) for x in zip(*held, strict=True))
            # words by their places among those of this block, in order of hashes and so of codes; the start comes last
            hashes = _distinct(tokens)
            w = _Found(hashes).places(tokens)
            hashes, n, docs = np.append(hashes, START), len(hashes) + 1, len(length)
            at = np.r_[0, np.cumsum(length)]
            b = _before(w, at, n - 1)
            b, a, w, owner = _in_order(b, _before(b, at, n - 1), w, np.repeat(np.arange(docs), length), n, docs)
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.r_[first, len(w)]).astype(np.uint32)
            b, a, w, owner = b[first], a[first], w[first], owner[first]
            ids = model.ids(hashes)
            by = _dealt_by(hashes, _middle(hashes), model.is_hot(ids), b, a, w)
            side = ((by >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.uint16) * np.uint16(2)
            known = ids >= 0
            side += ~(known[b] & known[a] & known[w])
            order = np.argsort(side, kind="stable")
            cut = np.searchsorted(side[order], np.arange(2 * pieces + 1))
            b, a, w, owner, times = b[order], a[order], w[order], owner[order], times[order]
            place, local = ids.astype(np.uint64), np.empty(docs, np.uint32)
            at_pieces, blobs = [], []
            for p in range(pieces):
                near, far = slice(cut[2 * p], cut[2 * p + 1]), slice(cut[2 * p + 1], cut[2 * p + 2])
                n1, n2 = near.stop - near.start, far.stop - far.start
                if not n1 + n2:
                    continue
                code = (place[b[near]] * radix + place[a[near]]) * radix + place[w[near]]
                own = _distinct(owner[near.start : far.stop])
                local[own] = np.arange(len(own), dtype=np.uint32)
                raw = b"".join((
                    np.array([n1, n2, len(own)], np.int64).tobytes(), keys[own].tobytes(), train[own].astype(np.uint8).tobytes(),
                    _planes(np.diff(code, prepend=np.uint64(0))), *(hashes[v[far]].tobytes() for v in (b, a, w)), _planes(local[owner[near.start : far.stop]]),
                    _planes(times[near.start : far.stop]),
                ))
                at_pieces.append(p)
                blobs.append(len(raw).to_bytes(8, "little") + pack.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(at_pieces, pa.int32()), pa.array(blobs, pa.binary())], ["piece", "blob"])

        for batch in batches:
            for part in slices(batch, "text"):
                tokens, at = _with_ends(part)
                held.append((tokens, np.diff(at), np.asarray(part["key"]), ~_held(part)))
                size += len(tokens)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


class _Piece:
    """Instances of one piece: cached trigrams by places, others by hashes, in this order. Blobs are decoded one at a
    time; what is kept takes 24 bytes an instance, and 24 more where a word is not cached."""

    def __init__(self, blobs, model: _Model):
        pack, radix, middle = pa.Codec("zstd"), np.uint64(model.radix), _middle(model.hashes)
        # b, a, w, owner, times and the hash of what an instance is dealt by
        sides, keys, trains, docs, hashes = ([[] for _ in range(6)], [[] for _ in range(6)]), [], [], 0, []
        for blob in blobs:
            v = memoryview(blob.as_buffer())
            raw = pack.decompress(v[8:], int.from_bytes(v[:8], "little"), asbytes=True)
            n1, n2, m = np.frombuffer(raw, np.int64, 3).tolist()
            keys.append(np.frombuffer(raw, np.int64, m, 24).copy())
            trains.append(np.frombuffer(raw, np.uint8, m, 24 + 8 * m).astype(bool))
            at = 24 + 9 * m
            code = np.cumsum(_unplanes(raw[at : at + 8 * n1], n1, np.uint64), dtype=np.uint64)
            at += 8 * n1
            far = np.frombuffer(raw, np.uint64, 3 * n2, at).reshape(3, n2).copy()
            at += 24 * n2
            local = _unplanes(raw[at : at + 4 * (n1 + n2)], n1 + n2, np.uint32) + np.uint32(docs)
            number = _unplanes(raw[at + 4 * (n1 + n2) :], n1 + n2, np.uint32)
            history = code // radix
            near = [p.astype(np.int32) for p in (history // radix, history % radix, code % radix)]
            words = far.ravel()
            far_ids = model.ids(words).astype(np.int32)
            for side, ids, part, by in (
                (sides[0], near, slice(0, n1), _dealt_by(model.hashes, middle, model.hot, *near)),
                (sides[1], far_ids.reshape(3, n2), slice(n1, None), _dealt_by(words, _middle(words), model.is_hot(far_ids), *np.arange(3 * n2).reshape(3, n2))),
            ):
                for held, x in zip(side, (*ids, local[part].copy(), number[part].copy(), by.astype(np.uint32)), strict=True):
                    held.append(x)
            hashes.append(far)
            docs += m

        def whole(k: int) -> np.ndarray:
            out = np.concatenate([*sides[0][k], *sides[1][k]])
            sides[0][k] = sides[1][k] = None
            return out

        self.near, self.hashes = sum(map(len, sides[0][0])), np.concatenate(hashes, axis=1)
        self.keys, self.doc = np.unique(np.concatenate(keys), return_inverse=True)
        self.train = np.concatenate(trains)
        self.places, self.owner, self.times, by = [whole(k) for k in range(3)], whole(3), whole(4), whole(5)
        self.parts = -(-len(self.owner) // AT_ONCE)
        by = by.astype(np.uint64)
        by *= np.uint64(self.parts)
        by >>= np.uint64(32)
        self.part = by.astype(np.int32)

    def select(self, k: int, model: _Model):
        """(b, a, w, hashes of all ids, owner, times) of one part; ids of rare words follow those of cached ones."""
        at = np.flatnonzero(self.part == k)
        rare = at[at >= self.near] - self.near
        ids = [p[at].astype(np.int64) for p in self.places]
        shift = len(at) - len(rare)
        lost = [i[shift:] < 0 for i in ids]
        words = np.unique(np.concatenate([h[rare][x] for h, x in zip(self.hashes, lost, strict=True)]))
        for i, h, x in zip(ids, self.hashes, lost, strict=True):
            tail = i[shift:]
            tail[x] = model.radix + np.searchsorted(words, h[rare][x])
        return (*ids, np.concatenate([model.hashes, words]), self.owner[at], self.times[at].astype(np.int64))


def _facts(kind: int, rows: int, /, **given) -> pa.RecordBatch:
    cols = []
    for c in _COLUMNS[1:]:
        kind_of = pa.float64() if c == "x" else pa.int64()
        cols.append(pa.array(given[c]).cast(kind_of) if c in given else pa.nulls(rows, kind_of))
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), *cols], _COLUMNS)


def _low(group: np.ndarray, count: np.ndarray, n: int) -> list[np.ndarray]:
    """Per group, how many members have count 1, 2, ... DISCOUNTED."""
    return [np.bincount(group[count == r], minlength=n) for r in range(1, DISCOUNTED + 1)]


def _of_counts(level: int, count: np.ndarray) -> pa.RecordBatch:
    low = [int((count == r).sum()) for r in range(1, DISCOUNTED + 2)]
    return _facts(3, 1, h=[level], n=[low[-1]], **{c: [v] for c, v in zip(_R, low, strict=False)})


def history_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(second + np.uint64(3)) * W._STEP + first).view(np.int64)


def _evaluated(shared):
    """The facts of one piece, by kind.

    0: sums of a document (n: trigrams of low counts, m: backed-off bigrams of low counts). 1: backed-off instances by
    document and history. 2: histories of two words, with the bigram counts of their successors in m, a. 3: counts of
    counts by order. 4: instances backed off twice by document and middle word. 5: histories of one word. 6: their rare
    successors. 7: rare unigrams by document. 8: rare words backed off after a hot one. 9: rare successors of a history
    that ends hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        piece = _Piece((blob for batch in batches for blob in batch["blob"]), model)
        n = len(piece.keys)
        x, low, met = np.zeros(n), np.zeros((2 * DISCOUNTED, n), np.int32), np.zeros(n, bool)
        for k in range(piece.parts):
            yield from _part(model, piece, *piece.select(k, model), x, low, met)
        low = {c: v[met] for c, v in zip([*_R, *_M], low, strict=True)}
        yield _facts(0, int(met.sum()), key=piece.keys[met], x=x[met], **low)

    return run


def _part(model: _Model, piece: _Piece, b, a, w, hashes, owner, times, x, low, met) -> list[pa.RecordBatch]:
    radix = len(hashes)
    code = (b * radix + a) * radix + w
    order = np.argsort(code, kind="stable")
    code, owner, times = code[order], owner[order], times[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    doc, train = piece.doc[owner], piece.train[owner]
    met[doc] = True
    # trigrams
    tri = code[first]
    b, a, w = tri // radix // radix, tri // radix % radix, tri % radix
    c3 = np.add.reduceat(times * train, first)
    hot_a, hot_b = model.is_hot(a), model.is_hot(b)
    rare = w >= model.radix
    lw = np.minimum(w, model.size)
    # histories of two words
    hs, h = np.unique(tri // radix, return_inverse=True)
    both = np.zeros(len(hs), bool)
    both[h] = hot_a & hot_b
    c_h = np.bincount(h, c3, len(hs)).astype(np.int64)
    c_h[both] = model.pair(hs[both] % radix, hs[both] // radix)
    n3 = _low(h, c3, len(hs))
    plus3 = (both | (sum(n3) == 0)).astype(np.int64)
    # bigrams and histories of one word: here for cold middle words, held by every task for hot ones
    bis, bi = np.unique(b * radix + w, return_inverse=True)
    c2s = np.bincount(bi, c3, len(bis)).astype(np.int64)
    mids, mid = np.unique(bis // radix, return_inverse=True)
    hot_mid = model.is_hot(mids)
    c_mid = np.bincount(mid, c2s, len(mids)).astype(np.int64)
    c_mid[hot_mid] = model.history[mids[hot_mid]]
    n2 = _low(mid, c2s, len(mids))
    plus2 = (hot_mid | (sum(n2) == 0)).astype(np.int64)
    c2 = np.where(hot_b, 0, c2s[bi])
    c2[hot_b & ~rare] = model.pair(b[hot_b & ~rare], w[hot_b & ~rare])
    m = mid[bi]
    c_b, plus_b = c_mid[m], plus2[m]
    # an instance's level: trigram, bigram, unigram, or one that needs the table of rare words after hot ones
    level = np.where(c3 > 0, 3, np.where(hot_b & rare, 0, np.where(c2 > 0, 2, 1)))
    with np.errstate(divide="ignore", invalid="ignore"):
        p1 = np.log10(model.p1[lw])
        value = np.select([level == 3, level == 2], [np.log10(c3 / (c_h + plus3)[h]), np.log10(c2 / (c_b + plus_b))], 0.0)
    alone = (level == 1) & (c_b == 0) & ~rare  # an unknown middle word: the unigram alone
    value[alone] = p1[alone]
    size = np.diff(np.r_[first, len(code)])
    each = np.repeat(np.arange(len(tri)), size)
    docs = len(x)
    x += np.bincount(doc, value[each] * times, docs)
    row = np.full(len(tri), -1)
    for count, lower, of in ((c3, 0, level == 3), (c2, DISCOUNTED, level == 2)):
        of &= count <= DISCOUNTED
        row[of] = lower + count[of] - 1
    row = row[each]
    some = np.flatnonzero(row >= 0)
    np.add.at(low.reshape(-1), row[some] * docs + doc[some], times[some].astype(np.int32))
    out = []

    def by_document(kind: int, where: np.ndarray, group: np.ndarray, weigh: np.ndarray | None = None, **named) -> None:
        """Sums by document and group of the instances of some trigrams."""
        some = where[each]
        if not some.any():
            return
        t, d, g = times[some], doc[some], group[each][some]
        o = np.lexsort((g, d))
        t, d, g = t[o], d[o], g[o]
        at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])])
        given = {c: f(g[at]) for c, f in named.items()} | {"key": piece.keys[d[at]], "n": np.add.reduceat(t, at)}
        if weigh is not None:
            given["x"] = np.add.reduceat(weigh[each][some][o] * t, at)
        out.append(_facts(kind, len(at), **given))

    signed = hashes.view(np.int64)
    keys = history_key(hashes[hs % radix], hashes[hs // radix])
    backed = level < 3
    by_document(1, backed & (c_h[h] > 0), h, h=lambda g: keys[g])
    uni = level == 1
    by_document(4, uni & (c_b > 0), b, weigh=np.where(rare, 0.0, p1), h=lambda g: signed[g])
    by_document(7, uni & rare, w, w=lambda g: signed[g])
    by_document(8, level == 0, b * radix + w, h=lambda g: signed[g // radix], w=lambda g: signed[g % radix])
    # histories that were backed off from; a hot one may be so in another piece
    asked = both & (c_h > 0)
    asked[h[backed & (c_h[h] > 0)]] = True
    seen = (c3 > 0) & asked[h]
    known = seen & ~(hot_b & rare)
    m_h = _low(h[known], c2[known], len(hs))
    high = known & (c2 > DISCOUNTED)
    rest = np.bincount(h[high], c2[high], len(hs)).astype(np.int64)
    below = np.zeros(len(hs), np.int64)
    below[h] = c_b + plus_b
    low = {c: v[asked] for c, v in zip([*_R, *_M], [*n3, *m_h], strict=True)}
    out.append(_facts(2, int(asked.sum()), h=keys[asked], n=c_h[asked], key=plus3[asked], a=rest[asked], b=below[asked], **low))
    lost = seen & hot_b & rare
    out.append(_facts(9, int(lost.sum()), h=keys[h[lost]], key=signed[b[lost]], w=signed[w[lost]]))
    twice = np.zeros(len(mids), bool)
    twice[m[uni & (c_b > 0) & ~hot_b]] = True
    follows = (c2s > 0) & twice[mid]
    far = bis % radix >= model.radix
    mass = np.bincount(mid[follows & ~far], model.p1[(bis % radix)[follows & ~far]], len(mids)).astype(np.float64)
    low = {c: v[twice] for c, v in zip(_R, n2, strict=True)}
    out.append(_facts(5, int(twice.sum()), h=signed[mids[twice]], n=c_mid[twice], key=plus2[twice], x=mass[twice], **low))
    some = follows & far
    out.append(_facts(6, int(some.sum()), h=signed[(bis // radix)[some]], w=signed[(bis % radix)[some]]))
    out += [_of_counts(3, c3), _of_counts(2, c2s[~model.is_hot(bis // radix)])]
    return out


def score(docs: DataFrame, cached: int = CACHED, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs(doc_id, text).

    The model learns from rows whose crc32 of doc_id as text is not divisible by 10; a NULL doc_id counts as '' (held
    out). Every text ends with one end token; NULL reads as empty; a text of any length is taken whole, a few MB of a
    batch at a time. Repeated rows count as often as they come and get equal scores. Without training rows every
    probability is 1. Empty tables give no rows; other columns are ignored. ``cached`` changes no result; ``hot`` only
    the histories that leave one count more to unseen words: the hot ones, and those without a count to discount.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    docs = docs.select("doc_id", "text", held.alias("held"), F.xxhash64("doc_id", "text").alias("key"))
    words = staged(docs.select("text", "held").mapInArrow(_counted, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c")))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = docs.where("not held").count()
    nr = {r["c"]: r["n"] for r in words.where(F.col("c") <= DISCOUNTED + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    top = words.orderBy(F.desc("c"), "w").limit(cached).toArrow()
    kept, counts = (np.asarray(top[c].combine_chunks()).astype(np.int64) for c in ("w", "c"))
    model = _Model(kept.view(np.uint64), counts, int(total["n"]), int(total["v"]), texts, nr, hot)
    read = staged(docs.mapInArrow(_reader(Sent(spark, model)), READ))
    pairs = read.where("kind = 2").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    model.after_hot(*(np.asarray(pairs[c].combine_chunks()).astype(np.int64) for c in ("w", "n")))
    far = staged(read.where("kind = 3").groupBy(F.col("key").alias("h"), "w").agg(F.sum("n").alias("c2")))
    full = Sent(spark, model)
    pieces = min(1 << 12, max(PIECES, input_bytes(docs) // (16 << 20)))
    dealt = docs.mapInArrow(_dealer(full, pieces), "piece int, blob binary")
    facts = staged(dealt.groupBy("piece").applyInArrow(_evaluated(full), FACTS))
    return _assembled(read, facts, words, far, model)


def _lows(names: list[str], weight) -> Column:
    return sum((F.col(c) * float(weight(r)) for r, c in enumerate(names, 1)), F.lit(0.0))


def _hot_histories(model: _Model) -> list[tuple]:
    """(h, n, plus, mass, n1, ...) of each hot word, from its cached successors."""
    out = []
    real = model.pairs % model.radix != model.start
    pairs, counts = model.pairs[real], model.pair_counts[real]
    for i in np.flatnonzero(model.hot).tolist():
        some = pairs // model.radix == i
        low = [int((counts[some] == r).sum()) for r in range(1, DISCOUNTED + 1)]
        mass = float(model.p1[pairs[some] % model.radix].sum())
        out.append((int(model.hashes[i].view(np.int64)), int(model.history[i]), 1, mass, *low))
    return out


def _assembled(read: DataFrame, facts: DataFrame, words: DataFrame, far: DataFrame, model: _Model) -> DataFrame:
    spark, at = read.sparkSession, lambda k: facts.where(F.col("kind") == k)
    real = model.pairs % model.radix != model.start
    given = {3: {}, 2: {r: int((model.pair_counts[real] == r).sum()) for r in range(1, DISCOUNTED + 2)}}
    for row in at(3).groupBy("h").agg(*[F.sum(c).alias(c) for c in [*_R, "n"]]).collect():
        for r, c in enumerate([*_R, "n"], 1):
            given[row.h][r] = given[row.h].get(r, 0) + row[c]
    for row in far.where(F.col("c2") <= DISCOUNTED + 1).groupBy("c2").count().collect():
        given[2][row.c2] = given[2].get(row.c2, 0) + row["count"]
    d3, d2 = discounts(given[3]), discounts(given[2])
    plain = lambda d, c: sum((F.when(F.col(c) == r, float(d[r])).otherwise(0.0) for r in range(1, DISCOUNTED + 1)), F.when(F.col(c) > DISCOUNTED, 1.0).otherwise(0.0))
    unigram = F.when(F.coalesce("c", F.lit(0)) == 0, model.unknown).otherwise(model.scale * plain(model.d1, "c") * F.col("c") / float(max(model.total, 1)))
    freed = lambda d: _lows(_R, lambda r: r * (1 - d[r]))
    # back-off weights of histories of one word
    hot = spark.createDataFrame(_hot_histories(model), ", ".join(["h bigint", "n bigint", "key bigint", "x double", *(f"{c} bigint" for c in _R)]))
    ones = at(5).select("h", "n", "key", "x", *_R).union(hot)
    after_hot = far.select("h", "w", *[F.when(F.col("c2") == r, 1).otherwise(0).cast("bigint").alias(c) for r, c in enumerate(_R, 1)])
    later = at(6).select("h", "w", *[F.lit(0).cast("bigint").alias(c) for c in _R]).union(after_hot).join(words, "w")
    later = later.groupBy("h").agg(F.sum(unigram).alias("x"), *[F.sum(c).alias(c) for c in _R])
    zero = F.lit(None).cast("bigint")
    ones = ones.union(later.select("h", zero.alias("n"), zero.alias("key"), "x", *_R)).groupBy("h")
    ones = ones.agg(F.max("n").alias("n"), F.max("key").alias("key"), F.sum("x").alias("x"), *[F.sum(c).alias(c) for c in _R]).where("n > 0")
    left = (freed(d2) + F.col("key")) / (F.col("n") + F.col("key"))
    ones = staged(ones.select("h", (F.col("n") + F.col("key")).alias("below"), F.log10(left / F.greatest(1 - F.col("x"), F.lit(1e-15))).alias("alpha")))
    # back-off weights of histories of two words
    twos = at(2).select("h", "n", "key", "a", "b", *_R, *_M)
    met = at(9).select("h", F.col("key").alias("mid"), "w").join(small(far.withColumnRenamed("h", "mid")), ["mid", "w"])
    met = met.select("h", zero.alias("n"), zero.alias("key"), F.when(F.col("c2") > DISCOUNTED, F.col("c2")).otherwise(0).alias("a"), zero.alias("b"),
                     *[F.lit(0).cast("bigint").alias(c) for c in _R], *[F.when(F.col("c2") == r, 1).otherwise(0).cast("bigint").alias(c) for r, c in enumerate(_M, 1)])
    most, sums = [F.max(c).alias(c) for c in ("n", "key", "b")], [F.sum(c).alias(c) for c in ("a", *_R, *_M)]
    twos = twos.union(met).groupBy("h").agg(*most, *sums)
    left = (freed(d3) + F.col("key")) / (F.col("n") + F.col("key"))
    lower = (F.col("a") + _lows(_M, lambda r: r * d2[r])) / F.col("b")
    twos = staged(twos.select("h", F.log10(left / F.greatest(1 - lower, F.lit(1e-15))).alias("alpha")))
    # sums by document
    none, no = F.lit(0.0), F.lit(0).cast("bigint")
    part = lambda df, s, b=none, k=no: df.select("key", s.alias("s"), b.alias("b"), k.alias("k"))
    base = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / float(model.total + 0.1 * (model.types + 1))) * F.col("n")
    rare = read.where("kind = 1").select("key", "w", "n").join(words, "w", "left")
    backed = at(8).select("key", "h", "w", "n").join(small(far), ["h", "w"], "left").join(words, "w", "left").join(small(ones), "h", "left")
    bigram = F.log10(F.col("c2") * plain(d2, "c2") / F.col("below"))
    backed = backed.withColumn("s", F.col("n") * F.when(F.col("c2").isNotNull(), bigram).otherwise(F.coalesce("alpha", F.lit(0.0)) + F.log10(unigram)))
    rows = [
        part(at(0), F.col("x") + _lows(_R, lambda r: np.log10(d3[r])) + _lows(_M, lambda r: np.log10(d2[r]))),
        part(at(1).select("key", "h", "n").join(small(twos), "h"), F.col("n") * F.col("alpha")),
        part(at(4).select("key", "h", "n", "x").join(small(ones), "h"), F.col("x") + F.col("n") * F.col("alpha")),
        part(at(7).select("key", "w", "n").join(words, "w", "left"), F.col("n") * F.log10(unigram)),
        part(backed, F.col("s")),
        part(rare, none, base, F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)),
    ]
    total = rows[0]
    for more in rows[1:]:
        total = total.union(more)
    sums = total.groupBy("key").agg(F.sum("s").alias("s"), F.sum("b").alias("b"), F.sum("k").alias("k"))
    texts = read.where("kind = 0")
    copies = texts.groupBy("key").agg(F.count("*").alias("copies"))
    out = texts.drop("w").join(sums.join(copies, "key"), "key")
    return out.select(
        "doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.col("k") / F.col("copies")).cast("bigint").alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"), (F.col("base") + F.col("b") / F.col("copies")).alias("base_score"),
        (F.col("s") / F.col("copies")).alias("score"),
    )
