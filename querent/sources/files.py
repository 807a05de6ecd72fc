"""Checks and scans over Hadoop paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


#: Malformed input is an error, never a null row.
STRICT = {"mode": "FAILFAST"}


def required(df: DataFrame, where: str, *names: str) -> DataFrame:
    """``df``, failing where one of the columns is null."""
    checked = {
        name: F.coalesce(F.col(name), F.raise_error(F.lit(f"{where}: {name} is missing")).cast(df.schema[name].dataType))
        for name in names
    }
    return df.withColumns(checked)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def list_names(spark: SparkSession, directory: str) -> list[str]:
    """Names of the visible entries of a directory, sorted."""
    hadoop_path, fs = _path(spark, directory)
    names = [status.getPath().getName() for status in fs.listStatus(hadoop_path)]
    return sorted(name for name in names if not name.startswith(("_", ".")))


def require_sources(spark: SparkSession, paths: Iterable[str]) -> None:
    """Fail before any work if an input is missing."""
    missing = [path for path in paths if not exists(spark, path)]
    if missing:
        raise FileNotFoundError("missing input: " + ", ".join(missing))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet; spread the rows when the files alone give too few tasks.

    A table of many files keeps its scan partitions and is not shuffled.
    """
    table = spark.read.parquet(path)
    slots = spark.sparkContext.defaultParallelism
    return table.repartition(slots) if table.rdd.getNumPartitions() < slots else table


def read_partitioned(spark: SparkSession, path: str, key: str, fmt: str = "parquet") -> DataFrame:
    """Read a table with folders by ``key``, the key as the text it was.

    Without a schema Spark would guess a type for it and turn ``007`` into 7.
    """
    require_sources(spark, [path])
    found = spark.read.format(fmt).load(path).schema
    fields = [T.StructField(key, T.StringType()) if f.name == key else f for f in found.fields]
    return spark.read.format(fmt).schema(T.StructType(fields)).load(path)
