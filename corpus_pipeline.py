"""A training corpus from raw documents: quality rules, near duplicates, decontamination, secrets, mixing.

Each stage takes the documents that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm import decontaminate, mixing, ngram_join, quality, secrets
from llm.common import small, table
from llm.queries import ENTROPY, MAX_REPEAT

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their failing and repeated lines removed and n_chars counted anew.

    A NULL, empty or wordless text is rejected. Texts are taken whole whatever their length; repeated rows are judged one
    by one, whatever their doc_id. Further columns go. An empty table gives no rows."""
    judged = quality.accepted(docs.drop("n_chars"))
    return judged.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of linked ones.

    Rows without shingles or doc_id stay, as nothing links them; of rows that repeat a doc_id the one with the least text
    stays, equal texts by their other columns. Texts are compared whole. Further columns stay. An empty table gives no
    rows."""
    group = ngram_join.similar(docs)
    gone = staged(group.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(small(gone), "doc_id", "left_anti")
    again = staged(group.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    several = kept.join(small(again), "doc_id", "left_semi")
    others = sorted((c for c in docs.columns if c != "doc_id"), key=lambda c: (c != "text", c))
    one = several.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("x"))
    return kept.join(small(again), "doc_id", "left_anti").unionByName(one.select("doc_id", "x.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. A NULL or empty text has none and stays; rows that repeat a doc_id are judged
    by their own text, whole; further columns stay. Without benchmark items all rows stay."""
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).where(F.size("items") > 0)
    return _without(docs, staged(found.select("doc_id", "key").distinct()))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a confirmed secret. A NULL or empty text has none and stays; rows that repeat a doc_id are judged
    by their own text, whole; further columns stay. An empty table gives no rows."""
    found = secrets.scan(docs).where("secret")
    return _without(docs, staged(found.select("doc_id", "key").distinct()))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and hash of the text are in gone(doc_id, key)."""
    gone = small(gone.select(F.struct("doc_id", "key").alias("__gone")))
    mine = F.struct(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("key"))
    return docs.join(gone, mine == F.col("__gone"), "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each pass of each document. A NULL source is a source of its own; a NULL or empty
    text counts no tokens; repeated rows are units of their own. An empty table gives no rows."""
    return mixing.mixture(docs, max_repeat=MAX_REPEAT, entropy=ENTROPY)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]

#: A component search, a trained forest and seeded hashes of Spark are not SQL that both engines share.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
