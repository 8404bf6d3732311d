"""Words and word shingles of Arrow string batches as 64-bit hashes, in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, read off running sums, so a batch costs a few passes over its
bytes and no Python object per word. Memory is bounded by the block size plus eight bytes a word; a text of any length
is cut into blocks at separators, where no word is split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 5
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _is_word(separators: range | list[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words are runs of anything but ASCII white space.
SPACED = _is_word([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, letters a-z in either case, and non-ASCII characters.
ALNUM = _is_word([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


_POW: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        _POW[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray):
    """(from, to) ranges of about BLOCK bytes that end at text bounds or separators."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:
            bound = bounds[np.searchsorted(bounds, to, "right") - 1]
            if bound > at:
                to = int(bound)
            else:
                gaps = np.flatnonzero(~is_word[data[at:to]])
                while not len(gaps) and to < n:
                    to = min(n, to + BLOCK)
                    gaps = np.flatnonzero(~is_word[data[to - BLOCK : to]]) + (to - BLOCK - at)
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                to = min(to, int(bounds[np.searchsorted(bounds, at, "right")]))
        yield at, to
        at = to


def words(texts: pa.Array, is_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for n texts n + 1 offsets into them. Null texts have no words."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    hashes, starts = [], []
    for at, to in _blocks(data, bounds, is_word):
        part = data[at:to]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = is_word[part]
        cuts = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, to)] - at
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        begins[cuts] |= inside[1:-1][cuts]
        ends[cuts - 1] |= inside[1:-1][cuts - 1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64)))
        starts.append(begins + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds).astype(np.int64)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the caller leaves out those that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out)


def short(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole text of fewer words than a shingle has; differs from every full shingle's form."""
    out = 0
    for h in hashes.tolist():
        out = (out * int(_STEP) + h) % 2**64
    return mix(np.array([(out ^ (len(hashes) * 0xD6E8FEB86659FD93)) % 2**64], np.uint64))[0]


def shingles(texts: pa.Array, k: int = 5, is_word: np.ndarray = SPACED):
    """Yields each text's shingle hashes in order, with repeats."""
    hashes, at = words(texts, is_word)
    every = windows(hashes, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield every[a : b - k + 1]
        elif b > a:
            yield np.array([short(hashes[a:b])], np.uint64)
        else:
            yield every[:0]
