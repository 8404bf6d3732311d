"""Quality rules, line first: every line is judged on its own, failing lines go, and a document that loses too much
text goes with them. DataFrame functions only; one pass without an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 40
#: Phrases of notices and page furniture.
NOTICES = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "log in",
    "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to", "terms of use",
)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; NULL and blank texts have none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _failing(line: Column, words: Column) -> Column:
    """A line with words fails as shouting, symbol noise, navigation, a notice, unfinished text or repetition."""
    n, symbols = F.size(words), F.regexp_count(line, F.lit(SYMBOLS))
    noise = (symbols > 0) & (symbols * 100 > F.length(F.regexp_replace(line, SPACE, "")) * 10)
    navigation = F.regexp_count(line, F.lit(r"(?:^|\s)[|»›•·/](?=\s|$)")) * 100 > n * 15
    upper, lower = F.regexp_count(line, F.lit(r"\p{Lu}")), F.regexp_count(line, F.lit(r"\p{Ll}"))
    shouting = (n >= 5) & F.rlike(line, F.lit(r"\p{Lu}\p{Lu}")) & (upper * 100 > (upper + lower) * 70)
    unfinished = (n >= 8) & ~F.rlike(line, F.lit(r"[\p{L}\p{N}][.!?…:;][\"'”’»)\]]*(?:\s|$)|[。！？]"))
    notice = (n <= 12) & F.rlike(F.lower(line), F.lit(r"\b(?:" + "|".join(NOTICES) + r")\b"))
    repetition = (n >= 10) & (F.size(F.array_distinct(words)) * 100 < n * 35)
    return noise | navigation | shouting | unfinished | notice | repetition


def assess(docs: DataFrame) -> DataFrame:
    """docs(…, text) with measures, ``cleaned`` (the text without failing and repeated lines) and ``kept``.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint), base_failed, lost_chars,
    cleaned, kept. Columns of docs with these names are replaced. Every row is judged by itself, so ties and repeated
    rows get equal verdicts. NULL and blank texts have no words and fail. Work and memory are linear in a text's size,
    save for sorting its windows where some of them repeat. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "cleaned", "kept"]
    df = docs.drop(*made).withColumns({"_t": text})
    df = df.withColumns({"_words": words_of(F.col("_t")), "_lines": F.split("_t", "\n")})
    df = df.withColumns({"_h": F.transform("_words", lambda w: F.xxhash64(w)), "_full": F.filter("_lines", lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))})
    spots = F.sequence(F.lit(0), F.size("_h") - WINDOW)
    window = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(WINDOW)])
    df = df.withColumns({
        "_win": F.when(F.size("_h") >= WINDOW, F.transform(spots, window)).otherwise(F.array().cast("array<bigint>")),
        "_once": F.array_distinct("_full"),
    })
    df = df.withColumn("_repeats", F.size(F.array_distinct("_win")) < F.size("_win"))
    placed = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), placed))
    near = lambda x, i, d: F.coalesce(F.get(F.col("_sorted"), i + d)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: near(x, i, -1) | near(x, i, 1))
    df = df.withColumn("_starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    cover = F.aggregate("_starts", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size("_full") - F.size("_once")).cast("bigint"),
        "n_repeat_words": F.coalesce(cover, F.lit(0)).cast("bigint"),
        "_cells": F.transform("_once", lambda x: F.struct(x.alias("x"), F.split(F.btrim(x, F.lit(SPACES)), SPACE).alias("w"))),
    })
    df = df.withColumn("_good", F.transform(F.filter("_cells", lambda c: ~_failing(c["x"], c["w"])), lambda c: c["x"]))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    df = df.withColumn("cleaned", F.array_join("_good", "\n"))
    lost = F.col("word_chars") - F.length(F.regexp_replace("cleaned", SPACE, ""))
    df = df.withColumn("lost_chars", F.when(F.size("_good") == F.size("_full"), F.lit(0).cast("bigint")).otherwise(lost))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))
    # the row number keeps the optimizer from moving a condition on a verdict below the measures, which would repeat them
    here = F.monotonically_increasing_id() >= 0
    df = df.withColumns({"base_failed": F.col("base_failed") & here, "kept": F.col("kept") & here})
    return df.drop("_t", "_words", "_lines", "_h", "_full", "_win", "_once", "_repeats", "_sorted", "_starts", "_cells", "_good")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of :func:`assess` that are kept."""
    return assess(docs).where("kept")
