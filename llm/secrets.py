"""Secret scans: candidate strings, then a random forest that removes false positives.

Candidates are private-key headers, key formats with a fixed prefix, values of any length and alphabet assigned to a
credential word, and runs of 16 or more key characters with a digit. The forest sees a candidate's
length, character transitions, coverage by words of the corpus, path signs and neighbouring words, and is trained from
labelled findings; it decides on every candidate. DataFrame functions and the JVM's ML library only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.staging import staged
from llm import findings
from llm.common import looked_up, small

_KEY = "[A-Za-z0-9+/_-]"
PEM = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
CONTEXT = 40
#: At most so many labelled findings train the forest: those with the least hashes.
TRAIN_ROWS = 20_000
TREES, DEPTH = 32, 9
#: Words that stand before secrets, and plain words that keys do not hold.
CREDENTIAL = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)"
#: Key formats with a fixed prefix.
PREFIXED = (
    r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_\w{30,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeoprs]-[\w-]{10,}|AIza[\w-]{35}"
    r"|[rs]k_(?:live|test)_[0-9A-Za-z]{16,}|npm_[0-9A-Za-z]{36})"
)
#: A credential word and the sign of assignment; with a quote at most CONTEXT characters.
ASSIGN = rf"(?i:{CREDENTIAL})s?(?:[_.-]\w{{1,9}}|[A-Z0-9]\w{{0,9}})?[\\\"'\]]{{0,3}}\s{{0,4}}[=:]{{1,2}}>?\s{{0,4}}"
_QUOTED = "|".join(rf"(?<={ASSIGN}[bruf]?\\?{q})[^{q}\r\n]+(?={q})" for q in "\"'`")
VALUE = (
    r"(?<=[=:>\s\"'`])(?<=[=:]>?\s{0,4}[bruf]?\\?[\"'`]?)"
    rf"(?:{_QUOTED}|(?<={ASSIGN}[bruf]?\\?[\"'`]?)(?![bruf]?\\?[\"'`])[^\s\"'`]*[^\s\"'`,;.)\]}}])"
)
CANDIDATE = f"{PEM}|(?<!{_KEY}){PREFIXED}(?!{_KEY})|{VALUE}|(?<!{_KEY})(?={_KEY}{{16}})(?=[A-Za-z+/_-]*+[0-9]){_KEY}++={{0,2}}"
#: Assigned values that are no secrets: placeholders, calls and look-ups.
PLACEHOLDER = (
    r"(?i)^(?:true|false|null|nil|none|undefined|required|optional|string|str|[*x.-]+|<.*|\$[({\w].*|\{\{.*|%[sd]|(?:your|my)[ _-].*|[a-z_][\w.]*[(\[].*)$"
)
#: A dictionary word stands in one document of so many, and in two different texts.
DICTIONARY_PART = 50_000
#: Planted lines that train the forest where no reviewed findings are given (``llm/findings.py``).
PLANTED = 12_000
_WORD = r"(?<![\w/+=@-])\p{L}{4,30}(?![\w/+=@-])"
_PIECE = "[A-Z]?[a-z]{3,}|[A-Z]{4,}"
FEATURES = [
    "length", "transitions", "case_turns", "digit_share", "upper_share", "lower_share", "other_share", "hex", "digits_only",
    "distinct_share", "dictionary_share", "path_signs", "credential_before", "credential_assigned", "assigned", "quoted", "words_before",
    "words_after", "colon", "format", "placeholder",
]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, ordinal, start, candidate, before, after): all candidates of docs(doc_id, text).

    ``key`` is a hash of the text, ``ordinal`` counts within the row, ``start`` is in code points. NULL and empty texts
    have none; repeated rows give theirs each; a NULL doc_id is kept; other columns are ignored.
    """
    df = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    df = df.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    df = df.withColumns({"key": F.xxhash64("text"), "parts": F.split("text", CANDIDATE), "row": F.monotonically_increasing_id()})
    df = df.select("doc_id", "key", "row", F.posexplode(F.arrays_zip(
        "found", F.slice("parts", 1, F.size("found")).alias("b"), F.slice("parts", 2, F.size("found")).alias("a"),
        F.concat(F.array(F.lit("")), F.slice("found", 1, F.size("found") - 1)).alias("p"),
    )).alias("ordinal", "x"))
    before = Window.partitionBy("doc_id", "key", "row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("x.found") + F.length("x.b")
    df = df.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("x.b"))
    return df.select(
        "doc_id", "key", "ordinal", "start", F.col("x.found").alias("candidate"),
        F.right(F.concat("x.p", "x.b"), F.lit(CONTEXT)).alias("before"), F.left("x.a", F.lit(CONTEXT)).alias("after"),
    )


def dictionary(docs: DataFrame) -> DataFrame:
    """(word): words of four letters or more that stand alone in one document of DICTIONARY_PART, and in two different
    texts, in lower case; counted over all documents. The words of ``findings.WORDS`` belong to it."""
    key = F.xxhash64("text")
    texts = docs.select(F.lower(F.col("text").cast("string")).alias("text")).where("text is not null")
    words = texts.select(key.alias("key"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
    own = docs.sparkSession.createDataFrame([(w,) for w in findings.WORDS], "word string")
    often = counts.where((F.col("first") < F.col("last")) & (F.col("n") * DICTIONARY_PART >= docs.count())).select("word")
    return staged(often.union(own).distinct())


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the characters of each candidate that dictionary words cover, as ``covered``.

    Found once per distinct candidate; candidates and words that fill a large part of the rows are joined by broadcast."""
    each = staged(found.groupBy("candidate").agg(F.count("*").alias("rows")))
    pieces = staged(each.select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit(_PIECE), F.lit(0))).alias("word")).withColumn("word", F.lower("word")))
    known = staged(pieces.groupBy("word").agg(F.count("*").alias("rows")).join(small(words), "word", "left_semi"))
    sums = looked_up(pieces, known, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    facts = staged(each.join(sums, "candidate", "left").withColumn("covered", F.coalesce("covered", F.lit(0))))
    return looked_up(found, facts, "candidate")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    c, b, a = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(c)
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    features: dict[str, Column] = {
        "length": n.cast("double"),
        "transitions": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / n,
        "case_turns": count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "digit_share": count("[0-9]") / n,
        "upper_share": count("[A-Z]") / n,
        "lower_share": count("[a-z]") / n,
        "other_share": count("[^A-Za-z0-9]") / n,
        "hex": flag(F.rlike(c, F.lit("^[0-9a-f]+$")) | F.rlike(c, F.lit("^[0-9A-F]+$"))),
        "digits_only": flag(F.rlike(c, F.lit("^[0-9]+$"))),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary_share": F.col("covered") / n,
        "path_signs": count("/") + flag(F.rlike(b, F.lit(r"[/\\.]$"))) + flag(F.rlike(a, F.lit(r"^[/\\.]\w"))),
        "credential_before": flag(F.rlike(b, F.lit(rf"(?i)\b{CREDENTIAL}\W{{0,6}}$"))),
        "credential_assigned": flag(F.rlike(b, F.lit(rf"{ASSIGN}[bruf]?\\?[\"'`]?$"))),
        "assigned": flag(F.rlike(b, F.lit(r"[=:]\s*[\"']?$"))),
        "quoted": flag(F.rlike(b, F.lit("[\"'`]$")) & F.rlike(a, F.lit("^[\"'`]"))),
        "words_before": F.regexp_count(b, F.lit(r"\p{L}{2,}")).cast("double"),
        "words_after": F.regexp_count(a, F.lit(r"^[,;]?\s+\p{L}+")).cast("double"),
        "colon": flag(F.rlike(b, F.lit(r":\s+$"))),
        "format": flag(F.rlike(c, F.lit(rf"^(?:{PREFIXED}|{PEM})$"))),
        "placeholder": flag(F.rlike(c, F.lit(PLACEHOLDER))),
    }
    return covered(found, words).withColumns({k: F.coalesce(v, F.lit(0.0)).cast("double") for k, v in features.items()})


def planted(spark: SparkSession, rows: int = PLANTED) -> DataFrame:
    """Labelled findings in the form of :func:`candidates`: all candidates of the planted lines."""
    lines = staged(findings.lines(spark, rows))
    return candidates(lines).join(lines.select("doc_id", "label"), "doc_id")


def trained(labelled: DataFrame, words: DataFrame, rows: int = TRAIN_ROWS):
    """A forest from labelled(doc_id, key, ordinal, candidate, before, after, label); None unless both labels occur."""
    known = staged(labelled.where("label is not null").orderBy(F.xxhash64("key", "ordinal", "doc_id"), "key", "ordinal", "doc_id").limit(rows))
    if known.select("label").distinct().count() < 2:
        return None
    # One order for every run: the forest draws its samples by place.
    data = with_features(known, words).select("doc_id", "ordinal", "key", "label", *FEATURES).orderBy("key", "ordinal", "doc_id").coalesce(1)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(staged(data))
    return RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7).fit(data)


def scored(found: DataFrame, model, words: DataFrame) -> DataFrame:
    """``found`` with the forest's probability of a secret as ``score``."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found, words))
    return model.transform(data).withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, key, ordinal, start, length, score, secret): every candidate with the forest's score, which alone decides.

    ``labelled`` are reviewed findings with label 0 or 1 in the form of :func:`candidates`; without them the planted ones
    train the forest. Where reviewed findings have one label or none, no candidate is removed: score 1. NULL and empty
    texts have no candidates; repeated rows give theirs each; texts and candidates are taken whole; empty tables give no
    rows.
    """
    found = staged(candidates(docs))
    words = dictionary(docs)
    model = trained(labelled if labelled is not None else planted(docs.sparkSession), words)
    out = found.withColumn("score", F.lit(1.0)) if model is None else scored(found, model, words)
    return out.select(
        "doc_id", "key", "ordinal", "start", F.length("candidate").cast("bigint").alias("length"), F.round("score", 6).alias("score"),
        (F.col("score") >= threshold).alias("secret"),
    )
