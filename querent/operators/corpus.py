"""Example sets and the corpora built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.operators.schema import render_schema_text, require_databases


def examples_for_split(examples: DataFrame, split: str) -> DataFrame:
    return examples.filter(F.col("split") == split)


def examples_by_database(examples: DataFrame, db_id: str, split: str = "train") -> DataFrame:
    """Examples of one database; any split but ``train`` means ``dev``."""
    wanted = "train" if split == "train" else "dev"
    return examples_for_split(examples, wanted).filter(F.col("db_id") == db_id)


def take_first(examples: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` by position; None or 0 keeps all."""
    return examples.orderBy("idx").limit(n) if n else examples


def build_index_corpus(examples: DataFrame) -> DataFrame:
    """Index items; the text to index is the question alone."""
    return examples.select(
        F.col("idx").alias("item_id"),
        F.col("idx").alias("corpus_idx"),
        F.lit("example").alias("type"),
        "db_id",
        "question",
        "query",
        F.col("question").alias("text"),
    )


def drop_index_text(corpus: DataFrame) -> DataFrame:
    return corpus.drop("text")


def build_retrieval_corpus(examples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Training examples with their schema, then one schema item per database.

    The schema text is rendered once per database. The join names no strategy:
    a catalog under the broadcast threshold is broadcast, a larger one is
    shuffled, and adaptive execution splits a database that holds most examples.
    """
    train = examples_for_split(examples, "train")
    require_databases(catalog, train)
    schemas = render_schema_text(catalog).withColumnRenamed("schema_text", "schema")
    example_items = train.join(schemas, "db_id").select(
        F.lit("example").alias("type"),
        "idx",
        "db_id",
        "question",
        "query",
        "schema",
        F.concat("question", F.lit("\n\nDatabase: "), "db_id").alias("text"),
    )
    schema_items = schemas.select(
        F.lit("schema").alias("type"),
        "db_id",
        "schema",
        F.concat(F.lit("Database: "), "db_id", F.lit("\n"), "schema").alias("text"),
    )
    return example_items.unionByName(schema_items, allowMissingColumns=True)
