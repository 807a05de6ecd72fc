"""Schema catalogs: one row per database, with parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.sources.files import STRICT, require_sources, required

CATALOG_STRUCT = (
    "struct<db_id:string,table_names_original:array<string>,"
    "column_names_original:array<array<string>>,column_types:array<string>,"
    "foreign_keys:array<array<bigint>>,primary_keys:array<bigint>>"
)


def read_catalog(
    spark: SparkSession, path: str, layout: str = "array", ord_col: str = "ord"
) -> DataFrame:
    """One row per database; the last duplicate wins.

    ``layout="array"``: one JSON array, ordered by position. ``layout="lines"``:
    JSON lines ordered by ``ord_col``; this form is splittable. Malformed JSON,
    missing keys and column types fewer than the columns are errors.
    """
    require_sources(spark, [path])
    if layout == "lines":
        row = f"{CATALOG_STRUCT.removesuffix('>')},{ord_col}:bigint>"
        rows = spark.read.text(path).select(F.from_json("value", row, STRICT).alias("e"))
        return last_by_database(_complete(rows.select("e.*"), path, ord_col), ord_col)
    if layout != "array":
        raise ValueError(f"unknown layout: {layout}")
    document = spark.read.text(path, wholetext=True)
    entries = document.select(
        F.posexplode(F.from_json("value", f"array<{CATALOG_STRUCT}>", STRICT)).alias("pos", "e")
    )
    rows = entries.select(F.col("pos").cast("bigint").alias("ord"), "e.*")
    return last_by_database(_complete(rows, path, "ord"))


def _complete(catalog: DataFrame, path: str, ord_col: str) -> DataFrame:
    columns = ("table_names_original", "column_names_original", "column_types")
    rows = required(catalog, path, ord_col, "db_id", *columns)
    short = F.size("column_types") < F.size("column_names_original")
    message = F.concat(F.lit(f"{path}: column_types too short in "), F.col("db_id"))
    return rows.withColumn(
        "column_types",
        F.when(short, F.raise_error(message).cast("array<string>")).otherwise(F.col("column_types")),
    )


def last_by_database(catalog: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Keep, per database, the row with the largest ``ord_col``.

    ``max_by`` combines on the map side, so a database that was registered
    very often sends one row per task.
    """
    fields = [name for name in catalog.columns if name not in ("db_id", ord_col)]
    last = F.max_by(F.struct(*fields), F.col(ord_col))
    return catalog.groupBy("db_id").agg(last.alias("last")).select("db_id", "last.*")
