"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ebbline.staging import shared_folder
from llm import chat, decontaminate, html_text, importance, katz, mixing, ngram_join, quality, repeats, secrets, token_cache, url_filters, vector_codes
from llm.common import table
from llm.oracles import ORACLES  # noqa: F401


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.rule_table(spark), url_filters.link_targets(pages))


ENTROPY, MAX_REPEAT = 0.97, 4.0


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), max_repeat=MAX_REPEAT, entropy=ENTROPY)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op5_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op6_sparse_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.passages(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


CONTROL = "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.rendered(chat.fold(chat.events_of_turns(turns.union(added)))))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


def op11_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty, so that every distinct text is encoded."""
    cache = f"{shared_folder(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    tokenizer = token_cache.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return token_cache.counted(table(spark, sf_dir, "documents"), tokenizer, cache)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_source_mixing, op3_benchmark_decontamination, op4_ngram_jaccard_join, op5_katz_scoring,
        op6_sparse_suffix_arrays, op7_html_extraction,
        op8_chat_formatting, op9_secret_scans, op10_quality_rules, op11_cover_tree_codes, op12_importance_resampling, op13_token_counts,
    )
}