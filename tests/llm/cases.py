"""Shared tables of the tests: whole small tables with hard rows added."""

import re

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, key string, t string, component string, row int"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def hard_documents(spark):
    """Every document of the smallest folder, and rows with NULLs, no words, few words, a very long text, repeats and
    links just over and under the limit; with columns whose names the operators use inside."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    base = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join([*base[:k], *(f"x{k}{j}" for j in range(60 - k))])
    rows += [
        (10_000, None, None, None), (10_001, "", "en", "a"), (10_002, " \t\n\x0b\x0c\r ", "en", "a"), (10_003, "One two", "en", "a"),
        (10_004, "oNE  TWO", "en", "b"), (10_005, "one two three four five", "en", "b"), (10_006, " ".join(base), "en", "b"),
        (10_007, near(54), "en", None), (10_008, near(52), "en", "c"), (10_009, near(51), "en", "c"), (10_010, near(30), "en", "c"),
        (10_011, ("Zwölf Boxkämpfer jagen 東京   Eva. " * 9000) + "end", "de", "long"), (10_012, "éé 東京 A", "fr", "c"),
        (10_006, " ".join(base), "en", "b"), (10_013, "same words here again. " * 30, "en", "c"), (10_013, "same words here again. " * 30, "en", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "k", "t", "c", 1) for r in rows], SCHEMA)
