"""Small document tables with the rows that go wrong most easily."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A clashing name for a result or helper column of every operator.
CLASH = ("score", "shard", "slot", "size", "key", "block", "group", "rejected", "digest", "bucket", "kept", "length", "term")


def documents(spark, rows, extra=True):
    """``rows``: (doc_id, text, lang, source); with columns that clash with helpers' names."""
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in CLASH if extra else ():
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def prose(seed: int, words: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    parts = {"en": ["the", "and", "ing", "er", "th", "on"], "de": ["der", "und", "ung", "sch", "ä", "ei"]}[lang]
    made = ("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))
    return " ".join(made)


def odd_rows():
    """Null and empty texts, nulls in every column, repeated rows, ties, a long text."""
    long = prose(99, 30_000)
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, prose(4, 80), None, "b"),
        (5, prose(5, 80), "en", None), (5, prose(5, 80), "en", None), (None, prose(6, 70), "en", "a"), (7, prose(5, 80), "de", "b"),
        (8, long, "en", "a"), (9, "12 34 !!", "en", "b"), (10, prose(10, 60, "de"), "de", "a"),
    ]
