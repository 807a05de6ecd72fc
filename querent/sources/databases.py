"""Databases as folders of Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from querent.sources.files import exists, list_names


#: Functions that call any static method of the JVM.
REFLECTIVE = ("reflect", "java_method", "try_reflect")


def register_database(
    spark: SparkSession, db_id: str, root: str, settings: dict[str, str] | None = None
) -> SparkSession:
    """A session whose temp views are the tables of ``root/db_id``.

    Temp views belong to one session, so statements for one database never see
    the tables of another, and databases can be used at the same time.
    ``settings`` are SQL settings of that session: with
    ``spark.sql.ansi.enabled=false``, a division by zero is NULL, not a failure.
    """
    directory = f"{root.rstrip('/')}/{db_id}"
    if not exists(spark, directory):
        raise FileNotFoundError(f"no database {db_id} under {root}")
    paths = {
        name.removesuffix(".parquet"): f"{directory}/{name}"
        for name in list_names(spark, directory)
    }
    return register_tables(spark, paths, settings)


def register_tables(
    spark: SparkSession, paths: dict[str, str], settings: dict[str, str] | None = None
) -> SparkSession:
    """A new session with one temp view per named Parquet path.

    Its statements cannot name files or call methods of the JVM.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    functions = session._jsparkSession.sessionState().functionRegistry()
    for name in REFLECTIVE:
        functions.dropFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    for key, value in (settings or {}).items():
        session.conf.set(key, value)
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(key, spark.conf.get(key))
    for name, path in paths.items():
        session.read.parquet(path).createOrReplaceTempView(name)
    return session


def list_tables(session: SparkSession) -> list[str]:
    return sorted(table.name for table in session.catalog.listTables() if table.isTemporary)
