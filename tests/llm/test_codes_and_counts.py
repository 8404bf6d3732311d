"""Vector codes, importance resampling and token counts against brute force, with hard rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks.compare import difference, duck
from llm import common, importance, token_cache, vector_codes
from tests.llm.cases import DIR, hard_documents, lowered


@pytest.fixture(scope="module")
def docs(spark):
    return hard_documents(spark).repartition(3).cache()


@pytest.mark.parametrize("name", ["op11_cover_tree_codes", "op12_importance_resampling"])
def test_queries_equal_sql(spark, name):
    got = contract.queries()[name](spark, DIR).toPandas()
    assert difference(got, duck(DIR).sql(contract.oracle_sql()[name]).df()) is None


def lloyd(rows, parts, entries, rounds, scale):
    """Plain product Lloyd over (vec_id, vector) rows in Python integers."""
    v = [(i, [math.floor(scale * x) for x in vec]) for i, vec in rows]
    first = sorted(v, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(v[0][1]) // parts
    cut = lambda x, p: x[w * p : w * (p + 1)]
    books = [[cut(x, p) for _, x in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            found = collections.defaultdict(list)
            for _, x in v:
                found[near(cut(x, p), books[p])[1]].append(cut(x, p))
            books[p] = [[sum(c) // len(c) for c in zip(*found[k], strict=True)] if k in found else c for k, c in enumerate(books[p])]
    out = []
    for i, x in v:
        best = [near(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


@pytest.mark.parametrize("kind", ["plain", "clusters", "few", "large"])
def test_vector_codes(spark, kind):
    rng = np.random.default_rng(7)
    n, parts, entries = (9, 2, 12) if kind == "few" else (180, 2, 12)
    base = rng.normal(size=(n, 6))
    if kind == "clusters":
        base = base * 0.01 + rng.integers(0, 4, (n, 1)) * 5
    if kind == "large":
        base = base * 100_000
    rows = [(int(k), [float(x) for x in base[k]], int(k) % 3 if k % 5 else None) for k in range(n)]
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], None), *[(500 + k, rows[0][1], 9) for k in range(40)]]
    bad = [(600, None, 1), (601, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (602, [1.0] * 5 + [math.nan], 1), (603, [math.inf] + [1.0] * 5, 1),
           (604, [], 1), (605, [1.0] * 4, 1), (0, [1.0] * 7, 1)]
    table = spark.createDataFrame([(*r, 0, "x", 1) for r in rows + bad], "vec_id long, embedding array<double>, label int, error int, code string, of int").repartition(3)
    codes, books = vector_codes.compress(table, parts=parts, entries=entries, block=64)
    expected, want = lloyd([r[:2] for r in rows], parts, entries, 4, 1024)
    assert [b.tolist() for b in books] == want
    key = lambda r: (r[0] is None, *(str(x) for x in r))
    assert sorted(((r.vec_id, r.code, r.error) for r in codes.collect()), key=key) == sorted(expected, key=key)
    got = vector_codes.coded(table, parts=parts, entries=entries, block=64).collect()
    by = collections.Counter()
    for (_, _, label), (_, _, e) in zip(rows, expected, strict=True):
        by[label] += e
    assert collections.Counter(r.label_error for r in got) == collections.Counter(by[r[2]] for r in rows)
    digest = hashlib.sha256(",".join(str(x) for b in want for c in b for x in c).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_vector_codes_of_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1), (2, [], 1)], [(1, [1.0, 2.0], 1)]):
        assert vector_codes.coded(spark.createDataFrame(rows, schema)).collect() == []


def test_cover_trees_assign_subtrees_whole():
    rng = np.random.default_rng(3)
    centers = rng.integers(-4000, 4000, (12, 5))
    x = centers[rng.integers(0, 12, 600)] + rng.integers(-20, 21, (600, 5))
    tree = vector_codes.CoverTree.of(x)
    spans = list(tree.assigned(centers))
    assert sum(int((h - lo).sum()) for lo, h, _ in spans) == len(tree.points)
    assert sum(len(lo) for lo, _, _ in spans) < 40
    entry, error = tree.codes(centers)
    apart = ((x[:, None] - centers[None]) ** 2).sum(-1)
    assert (entry == apart.argmin(1)).all() and (error == apart.min(1)).all()
    ends = tree.points[tree.center]
    for k in range(len(ends)):
        inside = tree.points[tree.low[k] : tree.high[k]]
        assert ((inside - ends[k]) ** 2).sum(1).max() <= tree.radius[k] ** 2 + 1e-6


def test_position_table_checksums(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (1, 5, 63, 64, 65, 128, 129, 1000, 70_000):
        data = rng.integers(0, 256, n + 3).astype(np.uint8)
        begins = np.r_[0, rng.integers(0, n, 20)]
        ends = np.r_[n + 3, [rng.integers(b + 1, n + 4) for b in begins[1:]]]
        expected = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        for chunk in (1, 1000, 1 << 20):
            monkeypatch.setattr(importance, "CHUNK", chunk)
            assert importance.checksums(data, begins, ends).tolist() == expected


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2)])
def test_resampling(spark, docs, low, high):
    target = spark.read.parquet(f"{DIR}/benchmark.parquet").select("text").union(spark.createDataFrame([(None,), ("...",), ("x" * 300,)], "text string"))
    runs = lambda t: [zlib.crc32(" ".join(w[i : i + k]).encode()) % 500 for w in [words_of(t)] for k in range(low, high + 1) for i in range(len(w) - k + 1)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    s, t = (collections.Counter(b for x in texts for b in runs(x)) for texts in ([x for _, x in rows], [r.text for r in target.collect()]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 500) / ((s[b] + 1) * (t.total() + 500)))) for b in s}
    expected = []
    for i, text in rows:
        found = runs(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        expected.append((i, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in expected if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    drawn = collections.Counter(order[: len(order) * 10 // 100])
    got = importance.resample(docs, target, buckets=500, low=low, high=high, smooth=500).collect()
    assert collections.Counter(tuple(r[:5]) for r in got) == collections.Counter(expected)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, drawn.total() + 1))
    assert [tuple(r[:5]) for r in ranked] == order[: drawn.total()]


def test_resampling_of_equal_rows_and_empty_tables(spark):
    rows = spark.range(0, 900, 1, 9).select(F.lit(4).alias("doc_id"), F.lit("a b " * 15).alias("text"))
    rows = rows.union(spark.createDataFrame([(None, "a b " * 15), (None, None)], "doc_id int, text string"))
    target = spark.createDataFrame([], "text string")
    got = importance.resample(rows, target).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 91)) and len(got) == 902
    assert importance.resample(rows.limit(0), rows).collect() == []


def counts(tokenizer, texts):
    return dict(zip(texts, tokenizer.counter()([t or "" for t in texts]), strict=True))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, tmp_path, name, monkeypatch):
    path = public_tokenizers.path(name)
    tokenizer = token_cache.Tokenizer(path)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    special = ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "A  b", "a b", "café", "café", "</s> <s>"]
    more = spark.createDataFrame([(20_000 + k, t) for k, t in enumerate(special)] + [(None, "a b"), (None, None)], "doc_id bigint, text string")
    table = docs.select("doc_id", "text", "n_chars").unionByName(more.withColumn("n_chars", F.lit(1).cast("bigint")))
    rows = [(r.doc_id, r.text or "") for r in table.collect()]
    expected = collections.Counter((i, len(t.encode()), count(t), count(t) > 1024) for i, t in rows)
    cache = str(tmp_path / "cache")
    assert collections.Counter(map(tuple, token_cache.counted(table, tokenizer, cache).collect())) == expected
    store = token_cache.Cache(spark, cache, tokenizer.version())
    stored = store.entries().count()
    assert stored == spark.read.parquet(store.path).count() == len({_form(tokenizer, t) for _, t in rows})
    monkeypatch.setattr(common, "HOT", 8)
    monkeypatch.setattr(token_cache, "is_small", lambda _: False)
    monkeypatch.setattr(common, "is_small", lambda _: False)
    again = table.union(spark.createDataFrame([(30_000, "a text that is new", 1), (30_001, "a text that is new", 1)], table.schema))
    got = collections.Counter(map(tuple, token_cache.counted(again, tokenizer, cache).collect()))
    assert got == expected + collections.Counter([(i, 18, count("a text that is new"), False) for i in (30_000, 30_001)])
    assert spark.read.parquet(store.path).count() == stored + 1


def _form(tokenizer, text):
    form = tokenizer.normaliser()
    return form(text) if form else text


def test_token_cache_misses_only(spark, tmp_path):
    """Stored counts are taken as they are, so texts in the cache are not encoded; an empty table adds none."""
    tokenizer = token_cache.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    store = token_cache.Cache(spark, str(tmp_path), tokenizer.version())
    store.append(spark.createDataFrame([(hashlib.sha256(b"known").digest(), 77)], token_cache.ENTRY))
    rows = spark.createDataFrame([(1, "known"), (2, "unknown words")], "doc_id int, text string")
    got = {r.doc_id: r.n_tokens for r in token_cache.counted(rows, tokenizer, str(tmp_path)).collect()}
    assert got == {1: 77, 2: 2}
    assert token_cache.counted(rows.limit(0), tokenizer, str(tmp_path)).collect() == [] and store.entries().count() == 2
    assert token_cache.Tokenizer(public_tokenizers.path("word_bpe_49k.json")).version() != tokenizer.version()


def test_features_of_sliced_batches():
    texts = ["Hello  World, foo", None, "", "é東 A-b", "...", "x", "Yz" * 300, "w" * 500 + " q"] * 3
    for k, (found, runs, words) in enumerate(importance.features(pa.array(texts).slice(2), 10_000, 1, 3), 1):
        expected = [[zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for i in range(len(w) - k + 1)] for w in map(words_of, texts[2:])]
        assert found.tolist() == sum(expected, []) and runs.tolist() == list(map(len, expected)) and words.tolist() == [len(words_of(t)) for t in texts[2:]]
