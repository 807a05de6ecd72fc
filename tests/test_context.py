import pytest

from querent.functions.text import extract_sql
from querent.operators import context, generation
from querent.plans.answering import generate_sql

HEAD = "DATABASE SCHEMA:\nDatabase: d\n\n"
EXAMPLES = (
    "EXAMPLE QUERIES FROM THIS DATABASE:\n\n"
    "Example 1:\nQuestion: near?\nSQL: SELECT 1\n\n"
    "Example 2:\nQuestion: far? 100%\nSQL: SELECT 2\n"
)


@pytest.fixture(scope="module")
def tables(spark):
    questions = spark.createDataFrame(
        [(1, "d", "how?"), (2, "d", "why?"), (3, "e", "who?")],
        "query_id long, db_id string, question string",
    )
    schemas = spark.createDataFrame([("d", "Database: d\n")], "db_id string, schema_text string")
    hits = spark.createDataFrame(
        [(1, 2, "far? 100%", "SELECT 2"), (1, 1, "near?", "SELECT 1")],
        "query_id long, rank long, question string, query string",
    )
    return questions, schemas, hits


def contexts(df):
    return {r.query_id: r.context for r in df.collect()}


def test_context_blocks(tables):
    questions, schemas, hits = tables
    full = contexts(context.build_context(questions, schemas, hits))
    assert full == {1: HEAD + "\n" + EXAMPLES, 2: HEAD, 3: ""}


def test_context_switches(tables):
    questions, schemas, hits = tables
    only = contexts(context.build_context(questions, schemas, hits, include_schema=False))
    assert only == {1: EXAMPLES, 2: "", 3: ""}
    bare = context.build_context(questions, schemas, hits, include_examples=False)
    assert contexts(bare)[1] == HEAD
    none = context.build_context(questions, include_schema=False, include_examples=False)
    assert set(contexts(none).values()) == {""}


def test_six_configurations(tables):
    questions, schemas, hits = tables
    made = context.prompt_configs(questions, schemas, {"dense": hits, "bm25": hits.filter("rank = 1")})
    prompts = {(r.query_id, r.method): r.prompt for r in made.collect()}
    assert len(prompts) == 18
    assert "DATABASE SCHEMA" not in prompts[1, "baseline"]
    assert HEAD + "\n" + EXAMPLES in prompts[1, "dense_rag"]
    assert "Example 2:" not in prompts[1, "bm25_rag"] and "Example 1:" in prompts[1, "bm25_rag"]
    assert "Example" not in prompts[1, "schema_only"]
    assert "DATABASE SCHEMA" not in prompts[1, "examples_only"]
    assert "5. " in prompts[1, "cot_rag"] and "5. " not in prompts[1, "dense_rag"]
    assert all("how?" in p and p.endswith("SQL:") for (q, _), p in prompts.items() if q == 1)


def test_own_template(spark, tables):
    asked = tables[0].select(context.prompt_rag("question", "db_id", "{context}|{question}!").alias("p"))
    assert {r.p for r in asked.collect()} == {"d|how?!", "d|why?!", "e|who?!"}


def test_generators(spark, tables):
    questions, schemas, hits = tables
    stored = spark.createDataFrame([(1, "SELECT 5;")], "query_id long, response string")
    prompts = questions.selectExpr("query_id", "question AS prompt")
    answered = generation.generate(prompts, generation.from_stored(stored))
    assert {r.query_id: r.response for r in answered.collect()} == {1: "SELECT 5;", 2: None, 3: None}

    def model():
        def call(prompts):
            if any("why?" in p for p in prompts):
                raise ConnectionError
            return ["```sql\nSELECT 7;\n```\nThe answer." for _ in prompts]

        return call

    generator = generation.from_function(model, keys=("query_id", "method"), batch_size=1)
    made = generate_sql(questions, schemas, {"dense": hits, "bm25": hits}, generator).collect()
    assert {(r.query_id, r.generated_sql) for r in made} == {(1, "SELECT 7"), (2, None), (3, "SELECT 7")}
    assert len(made) == 18
