"""Prompt contexts and prompts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The headings of a context.
SCHEMA_HEADING = "DATABASE SCHEMA:"
EXAMPLES_HEADING = "EXAMPLE QUERIES FROM THIS DATABASE:"
EXAMPLE_BLOCK = "Example %d:\nQuestion: %s\nSQL: %s\n"

# Default templates; every prompt function takes another one.
PLAIN_TEMPLATE = (
    "Write one SQL query that answers the question. Reply with the query alone.\n\n"
    "Question: {question}\n\nSQL:"
)
RAG_TEMPLATE = (
    "You write SQL for a relational database.\n\n{context}\n\n"
    "Write one SQL query that answers the question. Reply with the query alone.\n\n"
    "Question: {question}\n\nSQL:"
)
STEPWISE_TEMPLATE = (
    "You write SQL for a relational database.\n\n{context}\n\n"
    "Question: {question}\n\nWork through these points:\n"
    "1. The tables that hold the answer.\n"
    "2. The columns to return.\n"
    "3. The joins, if there is more than one table.\n"
    "4. The conditions on rows.\n"
    "5. Grouping, order and limit, if any.\n\n"
    "Then reply with the final query alone.\n\nSQL:"
)


def fill_template(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by a column's text."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def prompt_plain(question: Column, template: str = PLAIN_TEMPLATE) -> Column:
    return fill_template(template, question=question)


def prompt_rag(question: Column, context: Column, template: str = RAG_TEMPLATE) -> Column:
    return fill_template(template, question=question, context=context)


def prompt_stepwise(
    question: Column, context: Column, template: str = STEPWISE_TEMPLATE
) -> Column:
    return fill_template(template, question=question, context=context)


def example_blocks(hits: DataFrame) -> DataFrame:
    """``(query_id, examples_text)`` of hits with ``rank, question, query``.

    A query has at most k hits, which bounds what is collected.
    """
    block = F.format_string(EXAMPLE_BLOCK, F.col("rank"), F.col("question"), F.col("query"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    blocks = hits.groupBy("query_id").agg(ordered.alias("ranked"))
    text = F.concat(F.lit(f"{EXAMPLES_HEADING}\n\n"), F.array_join("ranked.block", "\n"))
    return blocks.select("query_id", text.alias("examples_text"))


def _schema_block(schema_text: Column) -> Column:
    return F.concat(F.lit(f"{SCHEMA_HEADING}\n"), schema_text, F.lit("\n"))


def build_context(
    questions: DataFrame,
    schema_text: DataFrame | None = None,
    hits: DataFrame | None = None,
    include_schema: bool = True,
    include_examples: bool = True,
) -> DataFrame:
    """Questions ``(query_id, db_id, ...)`` with a ``context`` column.

    Schema block, then the examples numbered by rank; blocks that are switched
    off or have no data are left out, and nothing at all gives an empty text.
    """
    blocks = []
    if include_schema and schema_text is not None:
        questions = questions.join(schema_text, "db_id", "left")
        blocks.append(_schema_block(F.col("schema_text")))
    if include_examples and hits is not None:
        questions = questions.join(example_blocks(hits), "query_id", "left")
        blocks.append(F.col("examples_text"))
    context = F.concat_ws("\n", *blocks) if blocks else F.lit("")
    return questions.withColumn("context", context).drop("schema_text", "examples_text")


@dataclass(frozen=True)
class PromptConfig:
    """One prompting method: what the context holds and which hits it uses."""

    method: str
    schema: bool = False
    retriever: str | None = None
    style: str = "rag"


# The six settings that are compared, and the examples per prompt.
PROMPT_CONFIGS = (
    PromptConfig("baseline", style="plain"),
    PromptConfig("schema_only", schema=True),
    PromptConfig("examples_only", retriever="dense"),
    PromptConfig("dense_rag", schema=True, retriever="dense"),
    PromptConfig("bm25_rag", schema=True, retriever="bm25"),
    PromptConfig("cot_rag", schema=True, retriever="dense", style="stepwise"),
)
EXAMPLES_PER_PROMPT = 10


def prompt_configs(
    questions: DataFrame,
    schema_text: DataFrame,
    hits: dict[str, DataFrame],
    configs: tuple[PromptConfig, ...] = PROMPT_CONFIGS,
) -> DataFrame:
    """``(query_id, db_id, question, method, prompt)`` for every configuration.

    Schema and example texts are joined once per question; the configurations
    are then unfolded inside the row.
    """
    wide = questions.select("query_id", "db_id", "question").join(schema_text, "db_id", "left")
    for name, found in hits.items():
        wide = wide.join(
            example_blocks(found).withColumnRenamed("examples_text", f"examples_{name}"),
            "query_id",
            "left",
        )

    def prompt(config: PromptConfig) -> Column:
        question = F.col("question")
        if config.style == "plain":
            return prompt_plain(question)
        blocks = [_schema_block(F.col("schema_text"))] if config.schema else []
        if config.retriever:
            blocks.append(F.col(f"examples_{config.retriever}"))
        context = F.concat_ws("\n", *blocks) if blocks else F.lit("")
        build = prompt_stepwise if config.style == "stepwise" else prompt_rag
        return build(question, context)

    rows = F.array(
        *[F.struct(F.lit(c.method).alias("method"), prompt(c).alias("prompt")) for c in configs]
    )
    return wide.select("query_id", "db_id", "question", F.inline(rows))
