"""Stored method results and summary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.sources.files import STRICT, exists, read_partitioned, require_sources, required

DETAIL_STRUCT = (
    "struct<index:bigint,question:string,db_id:string,gold_sql:string,"
    "generated_sql:string,execution_match:boolean,gold_success:boolean,gen_success:boolean>"
)
DOCUMENT_SCHEMA = (
    "method string, k bigint, num_examples bigint, correct bigint, accuracy double, "
    f"time_seconds double, results array<{DETAIL_STRUCT}>"
)


def write_method_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Save the rows by method; only the methods present are replaced."""
    (
        results.hint("rebalance", "method")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("method")
        .format(fmt)
        .save(path)
    )


def read_method_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_partitioned(spark, path, "method", fmt)


def read_method_documents(
    spark: SparkSession,
    needed: dict[str, str],
    optional: dict[str, str] | None = None,
    layout: str = "document",
) -> DataFrame:
    """Rows of one JSON document per method, ``{method name: path}``.

    A missing needed document is an error, and so are malformed JSON and rows
    without index. An optional document is left out when the file is missing or
    holds no ``results``. ``layout="lines"``: JSON lines of the rows themselves,
    the splittable form for large results.
    """
    if layout not in ("document", "lines"):
        raise ValueError(f"unknown layout: {layout}")
    require_sources(spark, needed.values())
    present = dict(needed)
    present.update(
        {name: path for name, path in (optional or {}).items() if exists(spark, path)}
    )
    tables = [_document(spark, name, path, layout) for name, path in present.items()]
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    return rows


def _document(spark: SparkSession, name: str, path: str, layout: str) -> DataFrame:
    if layout == "lines":
        rows = spark.read.schema(DETAIL_STRUCT.removeprefix("struct<").removesuffix(">").replace(":", " ")).json(path, **STRICT)
    else:
        document = spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True, **STRICT)
        rows = document.select(F.explode("results").alias("r")).select("r.*")
    rows = required(rows.withColumnRenamed("index", "idx"), path, "idx")
    details = [column for column in rows.columns if column != "idx"]
    return rows.select(F.lit(name).alias("method"), "idx", *details)


def write_summary(summary: DataFrame, path: str) -> None:
    """Write a one-row summary as a JSON document."""
    summary.write.mode("overwrite").json(path)
