"""Token counts through a cache of digests.

The cache is a folder of Parquet files, one subfolder per tokenizer version, of (digest, n_tokens) rows. A version is the
digest of the vocabulary file, the library with its version, and the options. A text's digest is that of its normalised
content: the form the tokenizer's own normaliser gives it, so spellings that it unifies share a row. Digests are joined
to the stored counts; only distinct texts without one are encoded, and their counts are appended for the next run.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm.common import Sent, is_small, looked_up, slices

ENTRY = "digest binary, n_tokens bigint"
#: Bytes of text that are encoded at once.
SLICE = 1 << 20


class Tokenizer:
    """A vocabulary file of ``tokenizers`` (.json) or ``sentencepiece`` (.model), sent to tasks by its bytes.

    Counts have no begin, end or added special tokens, no truncation and no padding; special strings inside texts are
    handled as the library does by default.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.library = "sentencepiece" if path.endswith(".model") else "tokenizers"

    def version(self) -> str:
        """Digest of everything that a count depends on besides the text."""
        name = f"{self.library} {__import__(self.library).__version__} counts-1 "
        return hashlib.sha256(name.encode() + self.data).hexdigest()

    def _loaded(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if self.library == "sentencepiece":
            from sentencepiece import SentencePieceProcessor

            return SentencePieceProcessor(model_proto=self.data)
        from tokenizers import Tokenizer as Library

        model = Library.from_buffer(self.data)
        model.no_truncation()
        model.no_padding()
        return model

    def normaliser(self):
        """A function from a text to a form with the same token count, or None where a text is its own form."""
        model = self._loaded()
        if self.library == "sentencepiece":
            return None
        if model.normalizer is None:
            return None
        special = [t.content for t in model.get_added_tokens_decoder().values()]

        def form(text: str) -> str:
            """A text in whose raw or normal form a special string occurs stays as it is: it is cut there before."""
            out = model.normalizer.normalize_str(text)
            return f"\x01{text}" if any(s in text or s in out for s in special) else f"\x00{out}"

        return form

    def counter(self):
        """A function from a list of texts to their token counts."""
        model = self._loaded()
        if self.library == "sentencepiece":
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def digested(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """docs(doc_id, text) with NULL texts empty, and the digest of the normalised text."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if tokenizer.normaliser() is None:
        return docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    sent = Sent(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = sent.value.normaliser()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                digests = [hashlib.sha256(form(t).encode()).digest() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], pa.array(digests, pa.binary())], ["doc_id", "text", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text string, digest binary")


def _encoded(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of each row of texts(digest, text)."""
    sent = Sent(texts.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value.counter()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part["digest"], pa.array(count(part["text"].to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, ENTRY)


class Cache:
    """The stored counts of one tokenizer version under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{version}"

    def entries(self) -> DataFrame:
        """One (digest, n_tokens) row per digest; two runs that met the same new text stored the same count twice."""
        try:
            stored = self.spark.read.schema(ENTRY).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = self.spark.createDataFrame([], ENTRY)
        return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, entries: DataFrame) -> None:
        entries.write.mode("append").parquet(self.path)


def counted(docs: DataFrame, tokenizer: Tokenizer, folder: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs(doc_id, text); other columns are ignored.

    ``folder`` holds the cache and gets the counts of new texts. n_bytes is the UTF-8 length, over_limit is n_tokens >
    limit. A NULL text counts as empty and has no tokens; a text of any length is encoded whole, a few MB at a time
    otherwise. Repeated rows, and rows that repeat a doc_id or have none, come back as often as they came. An empty
    table gives no rows and leaves the cache as it is.

    Texts move once, after copies have been reduced within each task, and only those of digests without a count.
    """
    spark = docs.sparkSession
    store = Cache(spark, folder, tokenizer.version())
    texts = digested(docs, tokenizer)
    listed = staged(texts.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest"))
    facts = staged(listed.groupBy("digest").agg(F.count("*").alias("rows")))
    missing = staged(facts.join(store.entries(), "digest", "left_anti").select("digest"))
    if not missing.isEmpty():
        few = is_small(missing)
        wanted = texts.join(F.broadcast(missing), "digest", "left_semi") if few else texts
        distinct = wanted.select("digest", "text").dropDuplicates(["digest"])
        store.append(_encoded(distinct if few else distinct.join(missing, "digest", "left_semi"), tokenizer))
    known = staged(facts.join(store.entries(), "digest"))
    return looked_up(listed, known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
