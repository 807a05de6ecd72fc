"""Experiments: evaluate methods, store what they gave, analyse the patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from time import monotonic

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.operators.execution import evaluate
from querent.operators.metrics import (
    accuracy_by_k,
    align_methods,
    analysis_summary,
    method_accuracy,
    position_in,
)
from querent.sources.results import read_method_results, write_method_results, write_summary


def run_methods(
    generated: DataFrame, database: Callable[[str], SparkSession], path: str
) -> DataFrame:
    """Evaluate ``generated(method, idx, question, db_id, gold_sql, generated_sql)``.

    All methods are evaluated together, so that statements they share run once;
    the rows are stored by method and read back.
    """
    write_method_results(evaluate(generated, database), path)
    return read_method_results(generated.sparkSession, path)


def run_method(
    generated: DataFrame, method: str, database: Callable[[str], SparkSession], path: str
) -> DataFrame:
    """Evaluate and store one method, replacing only its rows.

    Returns one row: ``method, num_examples, correct, accuracy, time_seconds``,
    the last as the driver's clock saw it.
    """
    start = monotonic()
    rows = run_methods(generated.filter(F.col("method") == method), database, path)
    counted = method_accuracy(rows.filter(F.col("method") == method))
    return counted.select(
        "method",
        F.col("total").alias("num_examples"),
        "correct",
        "accuracy",
        F.lit(monotonic() - start).alias("time_seconds"),
    )


def experiment_summary(results: DataFrame, k: int, methods: Sequence[str]) -> DataFrame:
    """One row: accuracy per method, and the best one (first of equals)."""
    accuracy = method_accuracy(results).filter(F.col("method").isin(*methods))
    order = position_in(methods, F.col("method"))
    best = F.min_by(F.struct("method", "accuracy"), F.struct(-F.col("accuracy"), order))
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), "method", "accuracy")))
    return accuracy.agg(
        F.max("total").alias("num_examples"),
        F.lit(k).cast("bigint").alias("k_value"),
        entries.alias("e"),
        best.alias("best"),
    ).select(
        "num_examples",
        "k_value",
        F.map_from_arrays(F.col("e.method"), F.col("e.accuracy")).alias("methods"),
        F.col("best.method").alias("best_method"),
        F.col("best.accuracy").alias("best_accuracy"),
    )


def sweep_summary(results: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row: accuracy per k in the order tested, and the best k."""
    rows = F.array_sort(F.collect_list(F.struct("k", "accuracy")))
    first = F.struct(-F.col("accuracy"), position_in(ks, F.col("k")))
    return accuracy_by_k(results).agg(
        F.max("total").alias("num_examples"),
        F.array(*[F.lit(k).cast("bigint") for k in ks]).alias("k_values_tested"),
        rows.alias("results"),
        F.min_by(F.struct("k", "accuracy"), first).alias("best"),
    ).select(
        "num_examples",
        "k_values_tested",
        "results",
        F.col("best.k").alias("best_k"),
        F.col("best.accuracy").alias("best_accuracy"),
    )


def analyse(results: DataFrame, methods: Sequence[str], path: str) -> None:
    """Store the summary document and the compared examples under ``path``.

    The examples are a table of their own: they grow with the data.
    """
    aligned = align_methods(results, methods, carry=("question", "db_id", "gold_sql"))
    aligned.write.mode("overwrite").parquet(f"{path}/comparisons")
    stored = results.sparkSession.read.parquet(f"{path}/comparisons")
    write_summary(analysis_summary(stored, methods), f"{path}/summary")
