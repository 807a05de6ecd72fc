"""The whole way from examples to an analysis, on a small database."""

import pytest
from pyspark.sql import functions as F

from querent.functions.encoders import hashing_encoder
from querent.operators.corpus import build_index_corpus
from querent.operators.generation import from_function
from querent.operators.schema import render_schema_text
from querent.plans import answering, experiments, indexing
from querent.sources.databases import register_tables
from tests.test_catalog import SHOP

QUESTIONS = {
    "how many items are there": "SELECT count(*) FROM item",
    "list the names of items": "SELECT name FROM item",
    "how many sales are there": "SELECT count(*) FROM sale",
}


@pytest.fixture(scope="module")
def examples(spark):
    train = [("train", i, "shop", q, sql) for i, (q, sql) in enumerate(QUESTIONS.items())]
    train.append(("train", 3, "other", "how many items are there", "SELECT 0"))
    dev = [("dev", i, "shop", f"please: {q}", sql) for i, (q, sql) in enumerate(QUESTIONS.items())]
    return spark.createDataFrame(
        train + dev, "split string, idx long, db_id string, question string, query string"
    )


def copy_first_example():
    """A model that answers with the SQL of the first example it is shown."""

    def call(prompts):
        answers = []
        for prompt in prompts:
            _, _, after = prompt.partition("\nSQL: ")
            answers.append(f"```sql\n{after.split(chr(10))[0]};\n```" if after else "SELECT nothing")
        return answers

    return call


def test_from_examples_to_analysis(spark, examples, tmp_path):
    train, dev = (examples.filter(F.col("split") == split) for split in ("train", "dev"))
    encoder = hashing_encoder(64)
    vectors = indexing.index_vectors(train, str(tmp_path / "vectors"), encoder)
    words = indexing.index_words(train, str(tmp_path / "words"))
    questions = answering.as_questions(dev)
    hits = {
        "dense": answering.dense_hits(questions, vectors, encoder, k=2),
        "bm25": answering.bm25_hits(questions, words, build_index_corpus(train), k=2),
    }
    for found in hits.values():
        first = {r.query_id: r.query for r in found.filter("rank = 1").collect()}
        assert first == dict(enumerate(QUESTIONS.values()))
        assert {r.item_db_id for r in found.collect()} == {"shop"}

    catalog = spark.createDataFrame(
        [{k: [[str(x) for x in c] for c in v] if k == "column_names_original" else v
          for k, v in SHOP.items()}],
        "db_id string, table_names_original array<string>, column_names_original array<array<string>>, "
        "column_types array<string>, foreign_keys array<array<bigint>>, primary_keys array<bigint>",
    )
    generator = from_function(copy_first_example, keys=("query_id", "method"))
    answered = answering.generate_sql(questions, render_schema_text(catalog), hits, generator)
    assert answered.count() == 18

    for name in ("item", "sale"):
        spark.range(3).selectExpr("id", f"concat('{name}', id) AS name").write.parquet(
            str(tmp_path / f"{name}.parquet")
        )
    session = register_tables(spark, {n: str(tmp_path / f"{n}.parquet") for n in ("item", "sale")})
    gold = questions.select("query_id", "gold_sql")
    generated = answered.join(gold, "query_id").withColumnRenamed("query_id", "idx")
    results = experiments.run_methods(
        generated.select("method", "idx", "question", "db_id", "gold_sql", "generated_sql"),
        {"shop": session}.__getitem__,
        str(tmp_path / "results"),
    )
    methods = ["baseline", "schema_only", "examples_only", "dense_rag", "bm25_rag", "cot_rag"]
    one = experiments.experiment_summary(results, 2, methods).first()
    assert one.methods == dict.fromkeys(methods, 1.0) | {"baseline": 0.0, "schema_only": 0.0}
    assert (one.best_method, one.num_examples) == ("examples_only", 3)
    experiments.analyse(results, methods, str(tmp_path / "analysis"))
    document = spark.read.json(str(tmp_path / "analysis" / "summary")).first()
    assert (document.all_failed, document.all_succeeded, document.num_examples) == (0, 0, 3)
