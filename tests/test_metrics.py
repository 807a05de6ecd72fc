import json

import pytest
from pyspark.sql import functions as F

from querent.operators import metrics
from querent.plans import experiments
from querent.sources import results as stored

METHODS = ["baseline", "schema_only", "bm25_rag"]
#        idx: baseline, schema_only, bm25_rag
RIGHT = {
    0: (False, False, False),
    1: (True, True, True),
    2: (True, False, False),
    3: (False, True, False),
    4: (False, True, False),
    5: (False, False, False),
    6: (False, True, True),
}
# Published accuracies per k.
PUBLISHED = {5: 55, 10: 59, 15: 55, 20: 52, 25: 55, 30: 55, 35: 52, 40: 48, 45: 48, 50: 49}


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        (m, i, f"q{i}", f"d{i}", f"gold{i}", right)
        for i, values in RIGHT.items() for m, right in zip(METHODS, values)
    ]
    return spark.createDataFrame(
        rows, "method string, idx long, question string, db_id string, gold_sql string, execution_match boolean"
    )


@pytest.fixture(scope="module")
def aligned(results):
    return metrics.align_methods(results, METHODS)


def test_accuracy_and_gain(results):
    accuracy = metrics.method_accuracy(results)
    rows = {r.method: r for r in metrics.accuracy_vs_baseline(accuracy).collect()}
    assert (rows["schema_only"].correct, rows["schema_only"].total) == (4, 7)
    assert rows["schema_only"].improvement == pytest.approx(2 / 7)
    assert rows["baseline"].improvement is None
    assert metrics.best_setting(accuracy, "method", METHODS).first().method == "schema_only"


def test_first_of_equals_is_best(spark):
    tied = spark.createDataFrame([("z", 0.5), ("a", 0.5), ("m", 0.1)], "method string, accuracy double")
    assert metrics.best_setting(tied, "method", ["m", "z", "a"]).first().method == "z"


def test_best_k_of_the_published_sweep(spark):
    rows = [(k, i, i < n) for k, n in PUBLISHED.items() for i in range(100)]
    sweep = spark.createDataFrame(rows, "k long, idx long, execution_match boolean")
    one = experiments.sweep_summary(sweep, list(PUBLISHED)).first()
    assert (one.best_k, one.best_accuracy, one.num_examples) == (10, 0.59, 100)
    assert [(r.k, r.accuracy) for r in one.results] == [(k, n / 100) for k, n in PUBLISHED.items()]


def test_no_examples_give_zero(spark, results):
    assert metrics.accuracy_by(results.limit(0)).first().accuracy == 0.0
    assert metrics.method_agreement(metrics.align_methods(results.limit(0), METHODS), METHODS).first().rate == 0.0


def test_patterns(aligned):
    alone = {r.method: (r.n, r.first_idx, r.question) for r in metrics.unique_successes(aligned, METHODS).collect()}
    assert alone == {"baseline": (1, 2, "q2"), "schema_only": (2, 3, "q3"), "bm25_rag": (0, None, None)}
    failed = metrics.count_and_first(metrics.all_failed(aligned, METHODS), 1).collect()
    assert [(r.idx, r.total) for r in failed] == [(0, 2)]
    assert [r.idx for r in metrics.all_succeeded(aligned, METHODS).collect()] == [1]
    agreement = metrics.method_agreement(aligned, METHODS).first()
    assert (agreement.agree, agreement.total) == (3, 7)


def test_pairs(aligned):
    rows = {(r.method_a, r.method_b): tuple(r)[2:] for r in metrics.pairwise_methods(aligned, METHODS).collect()}
    assert rows == {
        ("baseline", "schema_only"): (1, 3, "schema_only", 2),
        ("baseline", "bm25_rag"): (1, 1, "tie", 0),
        ("schema_only", "bm25_rag"): (2, 0, "schema_only", 2),
    }
    one = metrics.pairwise_methods(aligned, METHODS, [("bm25_rag", "schema_only")]).first()
    assert (one.winner, one.margin) == ("schema_only", 2)


def test_coverage(results):
    short = results.filter("NOT (method = 'bm25_rag' AND idx = 6)")
    assert [tuple(r) for r in metrics.coverage_gaps(short, METHODS).collect()] == [(6, 2)]
    assert metrics.align_methods(short, METHODS, gaps="drop").count() == 6
    twice = results.union(results.filter("method = 'bm25_rag' AND idx = 6"))
    for bad in (short, twice):
        with pytest.raises(Exception, match="example 6 has . rows of method bm25_rag"):
            metrics.align_methods(bad, METHODS).collect()
    with pytest.raises(ValueError):
        metrics.align_methods(short, METHODS, gaps="keep")
    assert metrics.methods_in(short, ["cot_rag", *METHODS]) == METHODS


def test_results_are_stored_by_method(spark, results, tmp_path):
    path = str(tmp_path / "results")
    stored.write_method_results(results, path)
    changed = results.filter("method = 'baseline'").withColumn("execution_match", F.lit(True))
    stored.write_method_results(changed, path)
    again = stored.read_method_results(spark, path)
    assert again.count() == 21
    correct = {r.method: r.correct for r in metrics.method_accuracy(again).collect()}
    assert correct == {"baseline": 7, "schema_only": 4, "bm25_rag": 2}
    experiments.analyse(again, METHODS, str(tmp_path / "analysis"))
    document = json.loads(next((tmp_path / "analysis" / "summary").glob("*.json")).read_text())
    assert document["unique_successes"] == {"baseline": 3, "schema_only": 0, "bm25_rag": 0}
    assert document["accuracies"]["baseline"] == 1.0 and document["num_examples"] == 7
    assert spark.read.parquet(str(tmp_path / "analysis" / "comparisons")).count() == 7
    summary = experiments.experiment_summary(again, 10, METHODS)
    stored.write_summary(summary, str(tmp_path / "summary"))
    document = json.loads(next((tmp_path / "summary").glob("*.json")).read_text())
    assert (document["best_method"], document["k_value"], list(document["methods"])) == ("baseline", 10, METHODS)


def test_documents_with_optional_methods(spark, tmp_path):
    def document(name, **more):
        (tmp_path / f"{name}.json").write_text(json.dumps({"method": name, "correct": 1, **more}, indent=1))
        return str(tmp_path / f"{name}.json")

    detail = {"index": 0, "question": "q", "db_id": "d", "gold_sql": "g", "generated_sql": None,
              "execution_match": True, "gold_success": True, "gen_success": True}
    required = {"baseline": document("baseline", results=[detail, dict(detail, index=1)], time_seconds=2.5)}
    optional = {
        "bm25_rag": document("bm25", results=[detail], k=10),
        "cot_rag": document("cot"),
        "none": str(tmp_path / "none.json"),
    }
    rows = stored.read_method_documents(spark, required, optional)
    assert {(r.method, r.idx) for r in rows.collect()} == {("baseline", 0), ("baseline", 1), ("bm25_rag", 0)}
    assert rows.first().generated_sql is None
    with pytest.raises(FileNotFoundError):
        stored.read_method_documents(spark, {"gone": str(tmp_path / "gone.json")})


def test_run_methods_together_and_alone(spark, tmp_path):
    generated = spark.createDataFrame(
        [("a", 0, "q", "d", "SELECT 1", "SELECT 1"), ("b", 0, "q", "d", "SELECT 1", "SELECT 2")],
        "method string, idx long, question string, db_id string, gold_sql string, generated_sql string",
    )
    path = str(tmp_path / "runs")
    rows = experiments.run_methods(generated, lambda db: spark, path)
    assert {r.method: r.execution_match for r in rows.collect()} == {"a": True, "b": False}
    better = generated.withColumn("generated_sql", F.lit("SELECT 1.0"))
    one = experiments.run_method(better, "b", lambda db: spark, path).first()
    assert (one.method, one.num_examples, one.correct, one.accuracy) == ("b", 1, 1, 1.0)
    assert one.time_seconds > 0
    rows = stored.read_method_results(spark, path)
    assert {r.method: r.execution_match for r in rows.collect()} == {"a": True, "b": True}
