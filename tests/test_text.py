import pytest
from pyspark.sql import functions as F

from querent.functions.text import WHITESPACE, extract_sql, strip, tokenize


def column(spark, texts, function):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [row.v for row in df.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_tokens_are_lower_words_between_white_space(spark):
    texts = ["", "  ", "One two  ONE", "a\x1cb c d\ne", "it's (ok), Ünder!", "x\x85y"]
    assert column(spark, texts, tokenize) == [text.lower().split() for text in texts]
    assert column(spark, [None], tokenize) == [None]


def test_strip_is_pythons(spark):
    texts = ["  a b\x1f\n", "", " ", "a"]
    assert column(spark, texts, strip) == [text.strip() for text in texts]


CASES = [
    ("SELECT 1", "SELECT 1"),
    ("```sql\nSELECT a FROM t;\n```", "SELECT a FROM t"),
    ("```SQL\nselect a\n```", "select a"),
    ("Sure:\n```sql\nSELECT a\n```\nThis query reads a.", "SELECT a"),
    ("SELECT a\nFROM t\nNote: all rows", "SELECT a\nFROM t"),
    ("SELECT a\nFROM t\nnote: all rows", "SELECT a\nFROM t"),
    ("SELECT a\nThe answer", "SELECT a"),
    ("SELECT a -- keep\nFROM t\n-- drop\nWHERE x", "SELECT a -- keep\nFROM t"),
    ("SELECT a;;;  ", "SELECT a"),
    ("SELECT a; ;", "SELECT a;"),
    ("SELECT a\r\nFROM t;\r\nThis is it", "SELECT a\r\nFROM t"),
    ("", ""),
    ("   \n ", ""),
    ("no statement here", "no statement here"),
    ("first\n\n second \nThis explains\nthird", "first\nsecond"),
    ("This explains only", "This explains only"),
    ("The query is nice\nmore", "The query is nice\nmore"),
    ("The result\nof it\nNote: x", "The result\nof it"),
    ("begin with the end", "with the end"),
    ("preselect x", "select x"),
    ("SELECT\n\nThis is data", "SELECT\n\nThis is data"),
    ("UPDATE t SET a = 1\nExplanation: sets a", "UPDATE t SET a = 1"),
    ("select", "select"),
    (None, None),
]


@pytest.mark.parametrize("text,sql", CASES)
def test_extraction(spark, text, sql):
    assert column(spark, [text], extract_sql) == [sql]


def test_strict_extraction_needs_a_word_boundary(spark):
    strict = lambda c: extract_sql(c, strict=True)
    assert column(spark, ["preselect x", "SELECT x"], strict) == ["preselect x", "SELECT x"]


def test_long_texts_are_read_whole(spark):
    text = "SELECT " + "a, " * 200_000 + "b\nThis ends it"
    assert column(spark, [text], extract_sql) == [text.removesuffix("\nThis ends it")]
