"""From questions to SQL, for a whole DataFrame of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions.text import extract_sql
from querent.operators.bm25 import Bm25Index, bm25_topk
from querent.operators.context import (
    EXAMPLES_PER_PROMPT,
    PROMPT_CONFIGS,
    PromptConfig,
    prompt_configs,
)
from querent.operators.dense import embed_once, vector_topk
from querent.operators.generation import Generator, generate
from querent.operators.topk import attach_items
from querent.session import stored


def as_questions(examples: DataFrame) -> DataFrame:
    """Examples in the role of questions: ``(query_id, db_id, question, gold_sql, text)``."""
    return examples.select(
        F.col("idx").alias("query_id"),
        "db_id",
        "question",
        F.col("query").alias("gold_sql"),
        F.col("question").alias("text"),
    )


def dense_hits(
    questions: DataFrame, index: DataFrame, encoder_factory, k: int = EXAMPLES_PER_PROMPT
) -> DataFrame:
    """Nearest examples of each question's own database, with question and query."""
    asked = embed_once(questions.select("query_id", "db_id", "text"), "text", encoder_factory)
    hits = vector_topk(index, asked, k, within=True)
    return attach_items(hits, index.select("item_id", "question", "query"))


def bm25_hits(
    questions: DataFrame, index: Bm25Index, corpus: DataFrame, k: int = EXAMPLES_PER_PROMPT
) -> DataFrame:
    hits = bm25_topk(index, questions, k, within=True)
    return attach_items(hits, corpus.select("item_id", "question", "query"))


def generate_sql(
    questions: DataFrame,
    schema_text: DataFrame,
    hits: dict[str, DataFrame],
    generator: Generator,
    configs: tuple[PromptConfig, ...] = PROMPT_CONFIGS,
) -> DataFrame:
    """``(query_id, db_id, question, method, prompt, response, generated_sql)``.

    Prompts are stored before and responses after the generator, so that neither
    retrieval nor generation runs twice.
    """
    prompts = stored(prompt_configs(questions, schema_text, hits, configs), "prompts")
    answered = stored(generate(prompts, generator, keys=("query_id", "method")), "responses")
    return answered.withColumn("generated_sql", extract_sql(F.col("response")))
