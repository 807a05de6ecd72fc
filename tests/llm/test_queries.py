"""The registered queries and the pipeline on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from querent.llm.queries import ORACLES, QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test data")


def test_all_registered():
    assert [sum(name.startswith(f"op{n}_") for name in queries()) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in queries() and ORACLES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op10_exact_topk", "op8_best_fit_packing", "op11_ptolemaic_kmeans", "op13_segment_negatives")])
def test_one_row_for_every_document(spark, name):
    made = QUERIES[name](spark, str(SF_DIR))
    wanted = spark.read.parquet(str(SF_DIR / "documents.parquet"))
    assert made.count() == wanted.count()
    assert made.schema["doc_id"].dataType == wanted.schema["doc_id"].dataType


@pytest.mark.parametrize("name", ORACLES)
def test_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    wanted = duck.sql(ORACLES[name])
    made = QUERIES[name](spark, str(SF_DIR))
    assert made.columns == wanted.columns
    assert sorted(map(tuple, made.collect())) == sorted(wanted.fetchall())


def test_pipeline_stages(spark):
    """Each stage against what its operator says of its own input."""
    sf, docs = str(SF_DIR), spark.read.parquet(str(SF_DIR / "documents.parquet"))
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    tokens = pieces.filter("start = 0").agg({"doc_tokens": "sum", "*": "count"}).first()
    assert tokens["count(1)"] == sizes[4]
    assert tokens["sum(doc_tokens)"] == pieces.agg({"length": "sum"}).first()[0]
    run = corpus_pipeline.run(spark, sf)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(run) == key(pieces)


def test_pipeline_hands_texts_to_python_in_small_batches(spark):
    from querent import session

    before, own = {key: spark.conf.get(key) for key in session.BATCHES}, spark.conf.getAll
    # texts of 20 MB in one partition
    docs = spark.range(5000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some words ', 370) AS text", "'en' AS lang", "'a' AS source")
    try:
        corpus_pipeline.STAGES[0][1](spark, docs, str(SF_DIR))
        sizes = docs.select("text").mapInArrow(_sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in sizes) == 5000 and all(r["rows"] <= 1000 and r["bytes"] < 6 << 20 for r in sizes)
        # a session's own setting stays
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
        session.small_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
    finally:
        for key in session.BATCHES:
            spark.conf.set(key, before[key]) if key in own else spark.conf.unset(key)


def _sizes(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})


def test_stages_of_language_and_toxicity_send_only_texts_to_python(spark):
    """Before, all columns went to Python and back, the text twice."""
    docs = spark.read.parquet(str(SF_DIR / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        plan = stage(spark, docs, str(SF_DIR))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
