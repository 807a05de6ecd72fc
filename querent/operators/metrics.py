"""Accuracy, best setting and success patterns across methods.

Input of most functions is ``results(method, idx, question, db_id, execution_match)``.
Patterns work on the wide table of ``align_methods``: one shuffle by example,
after which each report is one aggregation over the wide rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.session import stored


def accuracy_by(results: DataFrame, *keys: str) -> DataFrame:
    """``(keys, correct, total, accuracy)``; no examples give accuracy 0."""
    correct = F.count_if(F.col("execution_match"))
    counted = results.groupBy(*keys).agg(
        correct.alias("correct"), F.count(F.lit(1)).alias("total")
    )
    ratio = F.try_divide(F.col("correct").cast("double"), F.col("total"))
    return counted.withColumn("accuracy", F.coalesce(ratio, F.lit(0.0)))


def method_accuracy(results: DataFrame) -> DataFrame:
    return accuracy_by(results, "method")


def accuracy_by_k(results: DataFrame) -> DataFrame:
    return accuracy_by(results, "k")


def accuracy_vs_baseline(accuracy: DataFrame, baseline: str = "baseline") -> DataFrame:
    """``improvement`` over the baseline, NULL for the baseline itself.

    The window has no key: its input is one row per method.
    """
    of_baseline = F.max(F.when(F.col("method") == baseline, F.col("accuracy")))
    gain = F.col("accuracy") - of_baseline.over(Window.partitionBy())
    return accuracy.withColumn("improvement", F.when(F.col("method") != baseline, gain))


def best_setting(accuracy: DataFrame, key: str, order: Sequence | None = None) -> DataFrame:
    """The row of highest accuracy; of equals the first in ``order``, else by key."""
    position = F.col(key)
    if order is not None:
        position = position_in(order, F.col(key))
    return accuracy.orderBy(F.desc("accuracy"), position).limit(1)


def position_in(order: Sequence, key: Column) -> Column:
    """The place of a key in ``order``; keys that are not listed come last."""
    place = F.array_position(F.array(*[F.lit(value) for value in order]), key)
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1))


def methods_in(results: DataFrame, order: Sequence[str]) -> list[str]:
    """The methods of ``order`` that have results."""
    present = {row.method for row in results.select("method").distinct().collect()}
    return [method for method in order if method in present]


def align_methods(
    results: DataFrame,
    methods: Sequence[str],
    carry: Sequence[str] = ("question", "db_id"),
    gaps: str = "raise",
) -> DataFrame:
    """One row per example, one boolean per method; a null outcome is not matched.

    The carried texts are those of the first method. An example that a method
    lacks, or has twice, is an error that names it; ``gaps="drop"`` leaves out
    those that a method lacks, and ``coverage_gaps`` lists them.
    """
    if gaps not in ("raise", "drop"):
        raise ValueError(f"gaps must be raise or drop, not {gaps}")
    matched = F.coalesce("execution_match", F.lit(False))
    matches = [F.bool_or(F.when(F.col("method") == m, matched)).alias(m) for m in methods]
    matches += [F.count_if(F.col("method") == m).alias(f"n {m}") for m in methods]
    texts = F.max(F.when(F.col("method") == methods[0], F.struct(*carry))).alias("texts")
    wide = results.filter(F.col("method").isin(*methods)).groupBy("idx").agg(texts, *matches)
    if gaps == "drop":
        wide = wide.dropna(subset=list(methods))

    def checked(m: str) -> Column:
        n = F.col(f"n {m}")
        told = F.concat(F.lit("example "), F.col("idx").cast("string"), F.lit(" has "), n.cast("string"))
        error = F.raise_error(F.concat(told, F.lit(f" rows of method {m}"))).cast("boolean")
        return F.when(n == 1, F.col(m)).otherwise(error).alias(m)

    return wide.select("idx", "texts.*", *[checked(m) for m in methods])


def coverage_gaps(results: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``(idx, n_methods)`` of examples that not every method has."""
    seen = results.filter(F.col("method").isin(*methods)).groupBy("idx")
    return seen.agg(F.count_distinct("method").alias("n_methods")).filter(
        F.col("n_methods") < len(methods)
    )


def _n_right(methods: Sequence[str]) -> Column:
    return sum((F.col(m).cast("int") for m in methods), F.lit(0))


def unique_successes(aligned: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``(method, n, first_idx, question, db_id)``: only this method was right."""
    alone = _n_right(methods) == 1
    example = F.struct("idx", "question", "db_id")
    reports = []
    for m in methods:
        only = F.col(m) & alone
        reports.append(F.count_if(only).alias(f"n_{m}"))
        reports.append(F.min(F.when(only, example)).alias(f"first_{m}"))
    rows = [
        F.struct(
            F.lit(m).alias("method"),
            F.col(f"n_{m}").alias("n"),
            F.col(f"first_{m}.idx").alias("first_idx"),
            F.col(f"first_{m}.question").alias("question"),
            F.col(f"first_{m}.db_id").alias("db_id"),
        )
        for m in methods
    ]
    return aligned.agg(*reports).select(F.inline(F.array(*rows)))


def all_failed(aligned: DataFrame, methods: Sequence[str]) -> DataFrame:
    return aligned.filter(_n_right(methods) == 0)


def all_succeeded(aligned: DataFrame, methods: Sequence[str]) -> DataFrame:
    return aligned.filter(_n_right(methods) == len(methods))


def count_and_first(examples: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` rows by position, each with the number of all rows.

    The rows are stored: they are counted and ordered without being made twice.
    """
    examples = stored(examples, "examples")
    total = examples.agg(F.count(F.lit(1)).alias("total"))
    return examples.orderBy("idx").limit(n).withColumn("total", total.scalar())


# The comparisons that are reported by default.
REPORTED_PAIRS = (
    ("schema_only", "examples_only"),
    ("dense_rag", "bm25_rag"),
    ("dense_rag", "cot_rag"),
)


def pairwise_methods(
    aligned: DataFrame,
    methods: Sequence[str],
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """``(method_a, method_b, a_only, b_only, winner, margin)``, all pairs by default."""
    pairs = list(pairs or combinations(methods, 2))
    counts = []
    for i, (a, b) in enumerate(pairs):
        counts.append(F.count_if(F.col(a) & ~F.col(b)).alias(f"a_{i}"))
        counts.append(F.count_if(F.col(b) & ~F.col(a)).alias(f"b_{i}"))
    rows = [
        F.struct(
            F.lit(a).alias("method_a"),
            F.lit(b).alias("method_b"),
            F.col(f"a_{i}").alias("a_only"),
            F.col(f"b_{i}").alias("b_only"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    lead = F.col("a_only") - F.col("b_only")
    winner = F.when(lead > 0, F.col("method_a")).when(lead < 0, F.col("method_b"))
    return aligned.agg(*counts).select(F.inline(F.array(*rows))).select(
        "*", F.coalesce(winner, F.lit("tie")).alias("winner"), F.abs(lead).alias("margin")
    )


def method_agreement(aligned: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``(agree, total, rate)``: examples on which all methods have one outcome."""
    right = _n_right(methods)
    counted = aligned.agg(
        F.count_if((right == 0) | (right == len(methods))).alias("agree"),
        F.count(F.lit(1)).alias("total"),
    )
    rate = F.try_divide(F.col("agree").cast("double"), F.col("total"))
    return counted.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def db_counts(examples: DataFrame) -> DataFrame:
    """``(split, db_id, n, first_idx)``."""
    return examples.groupBy("split", "db_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx")
    )


def top_databases(examples: DataFrame, split: str = "train", n: int = 10) -> DataFrame:
    """The databases with most examples; of equals the one seen first."""
    counts = db_counts(examples.filter(F.col("split") == split))
    return counts.orderBy(F.desc("n"), "first_idx").limit(n)


def dataset_summary(examples: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(part, n_rows, n_databases)`` per split and for the catalog."""
    measures = (F.count(F.lit(1)).alias("n_rows"), F.count_distinct("db_id").alias("n_databases"))
    splits = examples.groupBy(F.col("split").alias("part")).agg(*measures)
    return splits.unionByName(
        catalog.agg(*measures).select(F.lit("catalog").alias("part"), "n_rows", "n_databases")
    )


def analysis_summary(aligned: DataFrame, methods: Sequence[str]) -> DataFrame:
    """The analysis in one row; the compared examples are stored beside it.

    Everything in the row is an aggregate, so it does not grow with the data.
    """
    right = _n_right(methods)

    def by_method(value) -> Column:
        return F.create_map(*[part for m in methods for part in (F.lit(m), value(m))])

    counts = [
        F.count(F.lit(1)).alias("num_examples"),
        F.count_if(right == 0).alias("all_failed"),
        F.count_if(right == len(methods)).alias("all_succeeded"),
    ]
    for m in methods:
        counts.append(F.count_if(F.col(m)).alias(f"right_{m}"))
        counts.append(F.count_if(F.col(m) & (right == 1)).alias(f"only_{m}"))
    share = lambda m: F.coalesce(
        F.try_divide(F.col(f"right_{m}").cast("double"), F.col("num_examples")), F.lit(0.0)
    )
    return aligned.agg(*counts).select(
        "num_examples",
        F.array(*[F.lit(m) for m in methods]).alias("methods_compared"),
        by_method(share).alias("accuracies"),
        "all_failed",
        "all_succeeded",
        by_method(lambda m: F.col(f"only_{m}")).alias("unique_successes"),
    )
