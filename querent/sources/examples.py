"""Example sets: question, gold SQL and database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.sources.files import STRICT, require_sources, required

EXAMPLE_FIELDS = "db_id string, question string, query string"


def read_examples(
    spark: SparkSession, path: str, split: str, layout: str = "array", idx_col: str = "idx"
) -> DataFrame:
    """Rows ``(split, idx, db_id, question, query)``.

    ``layout="array"``: one JSON array, whose positions become ``idx``.
    ``layout="lines"``: JSON lines that carry their own position in ``idx_col``;
    this form is splittable and the one for large sets. Malformed JSON and missing
    keys are errors.
    """
    require_sources(spark, [path])
    if layout == "lines":
        rows = spark.read.schema(f"{EXAMPLE_FIELDS}, {idx_col} bigint").json(path, **STRICT)
        rows = rows.withColumnRenamed(idx_col, "idx")
    elif layout == "array":
        document = spark.read.text(path, wholetext=True)
        kind = f"array<struct<{_struct_fields(EXAMPLE_FIELDS)}>>"
        entries = F.from_json("value", kind, STRICT)
        rows = document.select(F.posexplode(entries).alias("pos", "e")).select(
            F.col("pos").cast("bigint").alias("idx"), "e.*"
        )
    else:
        raise ValueError(f"unknown layout: {layout}")
    rows = required(rows, path, "idx", "db_id", "question", "query")
    return rows.select(F.lit(split).alias("split"), "idx", "db_id", "question", "query")


def _struct_fields(ddl: str) -> str:
    return ", ".join(":".join(field.strip().split(" ", 1)) for field in ddl.split(","))
