"""The pipeline: each stage's decisions on its own input."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from ebbline.staging import staged
from llm import decontaminate, ngram_join, quality, secrets
from tests.llm.cases import DIR, hard_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def inputs(spark):
    """The input of every stage, and the result."""
    docs = staged(hard_documents(spark).select(*COLUMNS))
    out = [docs]
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, DIR))
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(inputs):
    assert [set(df.columns) for df in inputs[:-1]] == [set(COLUMNS)] * 5
    assert inputs[0].count() > inputs[1].count() > inputs[2].count() > inputs[3].count() >= inputs[4].count() > 0


def test_each_stage_does_what_its_operator_says(spark, inputs):
    a, b, c, d, e, mix = inputs
    assert ids(b) == ids(quality.assess(a).where("kept"))
    assert b.where("n_chars <> length(text)").count() == 0
    group = {r.doc_id: r.component_id for r in ngram_join.similar(b).collect()}
    assert ids(c) == sorted({i for i, g in group.items() if i == g})
    dirty = {r.doc_id for r in decontaminate.judged(decontaminate.hits(c, spark.read.parquet(f"{DIR}/benchmark.parquet"))).where("contaminated").collect()}
    assert ids(d) == [i for i in ids(c) if i not in dirty]
    told = {r.doc_id for r in secrets.scan(d).where("secret").collect()}
    assert ids(e) == [i for i in ids(d) if i not in told]
    assert set(ids(mix)) <= set(ids(e))


def test_empty_documents(spark):
    docs = hard_documents(spark).select(*COLUMNS).limit(0)
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, DIR))
        assert docs.count() == 0


def test_nulls_pass(spark):
    text = ". ".join(f"Word{k} and another{k} make a sentence" for k in range(30)) + "."
    docs = spark.createDataFrame([(None, text, None, None, None), (None, text + " More.", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, DIR))
    assert docs.where(F.col("doc_id").isNull()).count() == 2


def test_further_columns_and_repeated_ids(spark):
    """Columns that the operators name inside, and documents that repeat an id, pass every stage."""
    text = ". ".join(f"Word{k} and another{k} make a sentence" for k in range(30)) + "."
    rows = [(1, text, "en", "a", 1, 5, "x"), (1, text + " More of it.", "en", "a", 1, 6, "y"), (2, text.replace("Word", "Term"), "en", "b", 1, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, key string")
    for stage in (pipeline.near_duplicates, pipeline.decontamination, pipeline.secret_scans):
        out = stage(spark, docs, DIR)
        assert set(out.columns) == set(docs.columns) and sorted(r.doc_id for r in out.collect()) in ([1, 2], [1, 1, 2])
    assert sorted((r.doc_id, r.row) for r in pipeline.near_duplicates(spark, docs, DIR).collect()) == [(1, 5), (2, 7)]


def test_registered():
    queries = contract.queries()
    assert "pipeline" in queries and sum(k.startswith("op") and k[2].isdigit() for k in queries) == 13
