"""Column functions over text: tokens and SQL extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.split() and str.strip() treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f]"

# What starts a statement, and what ends it on a new line.
STATEMENT_WORDS = ("WITH", "SELECT", "INSERT", "UPDATE", "DELETE")
STATEMENT_ENDS = ("This ", "The ", "Note:", "Explanation:", "--")
# Line starts that end a text without a statement.
EXPLANATION_STARTS = ("This query", "The query", "This ", "Note:", "Explanation:")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def tokenize(text: Column) -> Column:
    """Lower-cased words between runs of white space, in order."""
    return F.array_remove(F.split(F.lower(text), f"(?U){SPACE}+"), "")


def strip_code_fences(text: Column) -> Column:
    without_sql = F.regexp_replace(text, f"(?U)```sql{SPACE}*", "")
    return F.regexp_replace(without_sql, f"(?U)```{SPACE}*", "")


def _statement_pattern(strict: bool) -> str:
    words, ends = "|".join(STATEMENT_WORDS), "|".join(STATEMENT_ENDS)
    boundary = r"\b" if strict else ""
    return rf"(?isU){boundary}((?:{words}){SPACE}+.*?)(?=\n(?:{ends})|\z)"


def first_statement(text: Column, strict: bool = False) -> Column:
    """The first statement in a text, NULL if there is none.

    By default a keyword counts even inside a word; ``strict`` asks for a word
    boundary before it.
    """
    return F.nullif(strip(F.regexp_extract(text, _statement_pattern(strict), 1)), F.lit(""))


def lines_before_explanation(text: Column) -> Column:
    """Trimmed, non-empty lines before the first explaining line, else the text."""
    lines = F.transform(F.split(strip(text), "\n"), strip)
    explains = F.transform(
        lines, lambda line: reduce(Column.__or__, [line.startswith(s) for s in EXPLANATION_STARTS])
    )
    stop = F.array_position(explains, True)
    kept = F.when(stop > 0, F.slice(lines, 1, (stop - 1).cast("int"))).otherwise(lines)
    joined = F.array_join(F.array_remove(kept, ""), "\n")
    return F.coalesce(F.nullif(joined, F.lit("")), strip(text))


def extract_sql(text: Column, strict: bool = False) -> Column:
    """SQL of a generated answer: no fences, prose or closing semicolons."""
    bare = strip_code_fences(text)
    sql = F.coalesce(first_statement(bare, strict), lines_before_explanation(bare))
    return strip(F.rtrim(sql, F.lit(";")))
