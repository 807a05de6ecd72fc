"""A corpus pipeline: five stages over ``documents``, each written and read again.

Language ID, toxicity, near-duplicates, mixing of sources, packing. Every stage
works on all its predecessor kept; all but the last return the columns of the
documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import querent
from querent.llm import langid, mixing, near_dup, packing, toxicity
from querent.session import small_batches, stored
from querent.sources.files import scan_parquet

# Run from a checkout, the package is not installed on the workers.
cloudpickle.register_pickle_by_value(querent)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near enough to one of the languages learned from them."""
    return langid.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    return toxicity.keep_clean(docs, scan_parquet(spark, f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows in sequences."""
    return packing.pack_documents(docs)


def _bounded(stage):
    """The stage, with whole texts passed to Python in small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _bounded(language)),
    ("toxicity", _bounded(toxic)),
    ("near_duplicates", _bounded(near_duplicates)),
    ("source_mix", _bounded(mix)),
    ("packing", _bounded(packed)),
]

#: SQL can express neither the trained models nor the hashes; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan_parquet(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
