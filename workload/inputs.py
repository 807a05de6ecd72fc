"""Inputs of the registered queries, derived by Spark from the given tables.

All of them grow with the tables; none is filtered down or made up.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.encoders import hashing_encoder
from querent.operators.bm25 import Bm25Index, build_bm25_index
from querent.operators.corpus import build_index_corpus, examples_for_split
from querent.operators.dense import embed, read_vector_index, write_vector_index
from querent.operators.metrics import align_methods
from querent.operators.postings import Postings, build_postings
from querent.plans.answering import as_questions
from querent.session import new_run_dir
from querent.sources.databases import register_tables
from querent.sources.files import scan_parquet

METHODS = ("baseline", "schema_only", "examples_only", "dense_rag", "bm25_rag", "cot_rag")
KS = (5, 10, 15, 20, 25, 30, 35, 40, 45, 50)
CONVERSATIONS_PER_DATABASE = 12
COLUMNS_PER_DATABASE = 20
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ENCODER = hashing_encoder(384)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf_dir}/{name}.parquet")


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.col("doc_id").alias("corpus_idx"),
        F.col("lang").alias("db_id"),
        "text",
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    languages = F.array(*[F.lit(name) for name in ("de", "en", "es", "fr")])
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.element_at(languages, (F.col("item_id") % 4 + 1).cast("int")).alias("db_id"),
        "text",
    )


def _once_per_application(make):
    """Keep what a function wrote for a data directory as long as the session lives."""
    kept = {}

    def cached(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in kept:
            kept[key] = make(spark, sf_dir)
        return kept[key]

    return cached


@_once_per_application
def documents_index(spark: SparkSession, sf_dir: str) -> Bm25Index:
    return build_bm25_index(documents_corpus(spark, sf_dir))


@_once_per_application
def documents_postings(spark: SparkSession, sf_dir: str) -> Postings:
    return build_postings(documents_index(spark, sf_dir))


@_once_per_application
def examples_index(spark: SparkSession, sf_dir: str) -> Bm25Index:
    # databases are as many as conversations: a folder each would be too many files
    return build_bm25_index(build_index_corpus(train_examples(spark, sf_dir)), partition_by=())


@_once_per_application
def examples_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = build_index_corpus(train_examples(spark, sf_dir))
    return _stored_vectors(embed(corpus, "text", ENCODER), partition_by=())


@_once_per_application
def documents_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_vectors(embed(documents_corpus(spark, sf_dir), "text", ENCODER))


@_once_per_application
def embeddings_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("vec_id").alias("corpus_idx"),
        F.col("label").cast("string").alias("db_id"),
        F.col("embedding").alias("v"),
    )
    return _stored_vectors(items)


def vectors_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of the vectors, every 50th replaced by zeros."""
    kept = F.when(F.col("vec_id") % 50 == 0, 0.0).otherwise(1.0)
    items = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("vec_id").alias("corpus_idx"),
        F.col("label").cast("string").alias("db_id"),
        F.transform("embedding", lambda x: x * kept).alias("v"),
    )
    return _stored_vectors(items)


def _stored_vectors(items: DataFrame, **options) -> DataFrame:
    path = new_run_dir(items.sparkSession, "vectors")
    write_vector_index(items, path, **options)
    return read_vector_index(items.sparkSession, path)


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean of all its vectors, looked for in its label.

    Odd labels are looked for in the next one, where little or nothing is near.
    """
    values = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("query_id"),
        F.posexplode("embedding").alias("pos", "x"),
    )
    means = values.groupBy("query_id", "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("query_id").agg(ordered.alias("px")).select(
        "query_id",
        F.when(F.col("query_id") % 2 == 0, F.col("query_id"))
        .otherwise((F.col("query_id") + 1) % 10)
        .cast("string")
        .alias("db_id"),
        F.col("px.x").alias("v"),
    )


def turn_id() -> Column:
    """A number for conversation and turn, unique for any number of either."""
    return F.expr("((conv_id + turn) * (conv_id + turn + 1)) div 2 + turn")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns: ``(idx, conv_id, turn, split, db_id, question)``."""
    said = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return said.select(
        turn_id().alias("idx"),
        "conv_id",
        "turn",
        F.when(F.col("conv_id") % 5 == 0, "dev").otherwise("train").alias("split"),
        F.concat(F.lit("db"), F.expr(f"conv_id div {CONVERSATIONS_PER_DATABASE}")).alias("db_id"),
        F.col("text").alias("question"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, keyed by the turn they answer: ``(conv_id, turn, query)``."""
    said = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("query"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turns(spark, sf_dir).join(answers(spark, sf_dir), ["conv_id", "turn"])
    return pairs.select("split", "idx", "db_id", "question", "query")


def train_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples_for_split(examples(spark, sf_dir), "train")


def dev_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_questions(examples_for_split(examples(spark, sf_dir), "dev"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of databases whose columns are the parts, 20 parts each.

    Part keys are unique, so a database never collects more than 20 of them.
    """
    pos = F.col("p_partkey") % COLUMNS_PER_DATABASE
    parts = table(spark, sf_dir, "part").select(
        F.expr(f"p_partkey div {COLUMNS_PER_DATABASE}").alias("n"),
        pos.alias("pos"),
        F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), pos).alias("name"),
        F.lower("p_type").alias("type"),
        "p_size",
    )
    gathered = parts.groupBy("n").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", "type", "p_size"))).alias("c")
    )
    first_of_table = lambda c: (c["pos"] - c["pos"] % 5 + 1).cast("bigint")
    links = F.filter("c", lambda c: (c["pos"] % 5 != 0) & (c["p_size"] > 25))
    keys = F.filter("c", lambda c: c["pos"] % 5 == 0)
    return gathered.select(
        F.concat(F.lit("db"), "n").alias("db_id"),
        F.array(*[F.lit(f"table_{i}") for i in range(4)], F.lit("unused")).alias(
            "table_names_original"
        ),
        F.concat(
            F.array(F.array(F.lit("-1"), F.lit("*"))),
            F.transform(
                "c", lambda c: F.array(F.floor(c["pos"] / 5).cast("string"), c["name"])
            ),
        ).alias("column_names_original"),
        F.concat(F.array(F.lit("text")), F.col("c.type")).alias("column_types"),
        F.when(
            F.col("n") % 3 != 0,
            F.transform(links, lambda c: F.array(c["pos"] + 1, first_of_table(c))),
        ).alias("foreign_keys"),
        F.when(
            F.col("n") % 4 != 1, F.transform(keys, lambda c: (c["pos"] + 1).cast("bigint"))
        ).otherwise(F.array().cast("array<bigint>")).alias("primary_keys"),
    )


def wanted_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database ids asked for by the orders; some are in no catalog."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("db"), F.expr("o_custkey div 12")).alias("db_id")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts: every document, whole, as a model might have wrapped it."""
    text = F.col("text")
    forms = [
        text,
        F.concat(
            F.lit("```sql\nSELECT doc FROM corpus WHERE note = "),
            text,
            F.lit("\n```\nThis query finds it."),
        ),
        F.concat(F.lit("Here it is:\n```SQL\nselect 1;\n```\n"), text),
        F.concat(text, F.lit("\nSELECT a, b FROM t;;\nExplanation: "), text),
        F.concat(F.lit("This query is explained first.\n"), text),
        F.concat(F.lit("The result\n"), text, F.lit("\nNote: done")),
        F.concat(F.lit("SELECT x\r\nFROM y;\n-- "), text),
        F.lit("  \n "),
    ]
    chosen = F.coalesce(
        *[F.when(F.col("doc_id") % len(forms) == i, form) for i, form in enumerate(forms)]
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"), chosen.alias("response")
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id").withColumns(
        {
            "idx": F.col("doc_id"),
            "question": F.concat_ws("/", "source", "doc_id"),
            "db_id": F.col("lang"),
        }
    )


def method_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six outcomes per labelled document, one for each method."""
    right = {
        "baseline": F.col("quality") == 1,
        "schema_only": (F.col("toxic") == 0) & (F.col("doc_id") % 5 != 0),
        "examples_only": F.col("n_chars") > 500,
        "dense_rag": F.col("lang") == "en",
        "bm25_rag": F.col("n_chars") % 2 == 0,
        "cot_rag": F.col("doc_id") % 3 == 0,
    }
    rows = [
        F.struct(F.lit(name).alias("method"), match.alias("execution_match"))
        for name, match in right.items()
    ]
    return _outcomes(spark, sf_dir).select("idx", "question", "db_id", F.inline(F.array(*rows)))


def aligned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_methods(method_results(spark, sf_dir), METHODS)


def k_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.lit(k).cast("bigint") for k in KS]))
    rows = _outcomes(spark, sf_dir).withColumn("k", each)
    return rows.select(
        "k", "idx", ((F.col("n_chars") + F.col("doc_id")) % 50 >= F.col("k")).alias("execution_match")
    )


# Pairs of gold and generated statements over the given tables; {r} is a region key.
IN_REGION = "FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = {r}"
REGION_PAIRS = {
    "reordered": (
        "SELECT n_name FROM nation WHERE n_regionkey = {r}",
        "SELECT n_name FROM nation WHERE n_regionkey = {r} ORDER BY n_name DESC",
    ),
    "duplicated": (
        f"SELECT DISTINCT c_mktsegment {IN_REGION}",
        f"SELECT c_mktsegment {IN_REGION}",
    ),
    "unfiltered": (f"SELECT count(*) {IN_REGION}", "SELECT count(*) FROM customer"),
    "retyped": (
        f"SELECT n_name, count(*) {IN_REGION} GROUP BY n_name",
        f"SELECT n_name, CAST(count(*) AS DOUBLE) {IN_REGION} GROUP BY n_name",
    ),
}
PLAIN_PAIRS = {
    "subquery": (
        "SELECT l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag",
        "WITH f AS (SELECT l_returnflag AS a FROM lineitem) SELECT a, count(*) FROM f GROUP BY a;",
    ),
    "swapped": (
        "SELECT l_returnflag, l_linestatus FROM lineitem",
        "SELECT l_linestatus, l_returnflag FROM lineitem",
    ),
    "double_keys": (
        "SELECT o_orderkey FROM orders",
        "SELECT CAST(o_orderkey AS DOUBLE) FROM orders",
    ),
    "ordered_keys": ("SELECT o_orderkey FROM orders", "SELECT l_orderkey FROM lineitem"),
    "nulls": (
        "SELECT NULL FROM supplier",
        "SELECT nullif(s_suppkey, s_suppkey) FROM supplier",
    ),
    "empty": (
        "SELECT o_orderkey FROM orders WHERE o_totalprice < 0",
        "SELECT c_name FROM customer WHERE c_custkey < 0",
    ),
    "dates": (
        "SELECT o_orderdate FROM orders",
        "SELECT o_orderdate FROM orders WHERE o_orderstatus = 'F'",
    ),
    "text_keys": (
        "SELECT c_custkey FROM customer",
        "SELECT CAST(c_custkey AS STRING) FROM customer",
    ),
    "more_columns": ("SELECT p_partkey FROM part", "SELECT p_partkey, p_size FROM part"),
    "unknown_column": ("SELECT p_partkey FROM part", "SELECT p_weight FROM part"),
    "unknown_table": ("SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM suppliers"),
    "bad_cast": ("SELECT p_size FROM part", "SELECT CAST(p_name AS INT) FROM part"),
    "write": ("SELECT o_orderkey FROM orders", "DROP VIEW orders"),
    "absent": ("SELECT r_name FROM region", None),
    "bad_gold": ("SELECT r_size FROM region", "SELECT r_name FROM region"),
}


def statement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, db_id, gold_sql, generated_sql)``, some for every region."""

    def structs(pairs: dict, tag):
        return F.array(
            *[
                F.struct(
                    tag(name).alias("pair_id"),
                    F.lit(gold).alias("gold_sql"),
                    F.lit(generated).cast("string").alias("generated_sql"),
                )
                for name, (gold, generated) in pairs.items()
            ]
        )

    key = F.col("r_regionkey").cast("string")
    regions = table(spark, sf_dir, "region").select(key.alias("r"))
    per_region = regions.select(
        "r", F.inline(structs(REGION_PAIRS, lambda name: F.concat_ws("_", F.lit(name), F.col("r"))))
    ).select(
        "pair_id",
        F.replace("gold_sql", F.lit("{r}"), F.col("r")).alias("gold_sql"),
        F.replace("generated_sql", F.lit("{r}"), F.col("r")).alias("generated_sql"),
    )
    plain = spark.range(1).select(F.inline(structs(PLAIN_PAIRS, F.lit)))
    return per_region.unionByName(plain).select(
        "pair_id", F.lit("tpch").alias("db_id"), "gold_sql", "generated_sql"
    )


def databases(spark: SparkSession, sf_dir: str):
    """Sessions by database id, opened when first used."""

    @lru_cache(maxsize=None)
    def database(db_id: str) -> SparkSession:
        if db_id != "tpch":
            raise FileNotFoundError(f"no database {db_id}")
        paths = {name: f"{sf_dir}/{name}.parquet" for name in TABLES}
        return register_tables(spark, paths, {"spark.sql.ansi.enabled": "true"})

    return database
