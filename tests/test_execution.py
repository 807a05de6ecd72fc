import pytest
from pyspark.sql import functions as F

from querent.operators import execution
from querent.sources.databases import list_tables, register_database

EQUAL, DIFFERENT, FAILS = True, False, None
PAIRS = [
    ("SELECT 1", "SELECT 1.0", EQUAL),
    ("SELECT 1", "SELECT CAST(1 AS DOUBLE)", EQUAL),
    ("SELECT 1", "SELECT true", EQUAL),
    ("SELECT 1", "SELECT '1'", DIFFERENT),
    ("SELECT NULL", "SELECT NULL", EQUAL),
    ("SELECT NULL", "SELECT CAST(NULL AS INT)", EQUAL),
    ("SELECT NULL", "SELECT 'null'", DIFFERENT),
    ("SELECT -0.0D", "SELECT 0", EQUAL),
    ("SELECT 9007199254740993", "SELECT 9007199254740992", DIFFERENT),
    ("SELECT 9007199254740992", "SELECT 9007199254740992D", EQUAL),
    ("SELECT 0.1", "SELECT 0.1D", EQUAL),
    ("SELECT 12.50", "SELECT 12.5D", EQUAL),
    ("SELECT 9.9", "SELECT 10", DIFFERENT),
    ("SELECT 12.00", "SELECT 12", EQUAL),
    ("SELECT CAST(0 AS DECIMAL(38, 18))", "SELECT 0", EQUAL),
    ("SELECT 0.1D + 0.2D", "SELECT 0.3D", DIFFERENT),
    ("SELECT 1, 2", "SELECT 2, 1", DIFFERENT),
    ("SELECT 1, 2", "SELECT 1", DIFFERENT),
    ("SELECT 1 AS a, 1 AS a", "SELECT 1 AS b, 1 AS c", EQUAL),
    ("SELECT x FROM n", "SELECT x FROM n ORDER BY x DESC", EQUAL),
    ("SELECT x % 2 FROM n", "SELECT DISTINCT x % 2 FROM n", EQUAL),
    ("SELECT x FROM n", "SELECT x FROM n WHERE x > 0", DIFFERENT),
    ("SELECT x FROM n WHERE x < 0", "SELECT t FROM n WHERE x < 0", EQUAL),
    ("SELECT x FROM n WHERE x < 0", "SELECT x, t FROM n WHERE x < 0", EQUAL),
    ("SELECT 'a,b', 'c'", "SELECT 'a', 'b,c'", DIFFERENT),
    ("SELECT date '2020-01-01'", "SELECT date '2020-01-01'", EQUAL),
    ("SELECT array(1, 2)", "SELECT array(1, 2)", EQUAL),
    ("SELECT x FROM n;", "-- all\nSELECT x FROM n", EQUAL),
    ("WITH m AS (SELECT x FROM n) SELECT * FROM m", "SELECT x FROM n", EQUAL),
    ("VALUES (1), (2)", "SELECT 2 UNION SELECT 1", EQUAL),
    ("SELECT 1", "SELECT nothing FROM n", FAILS),
    ("SELECT 1", "SELECT 1 FROM nowhere", FAILS),
    ("SELECT 1", "SELECT CAST(t AS INT) FROM n", FAILS),
    ("SELECT 1", "this is prose", FAILS),
    ("SELECT 1", "", FAILS),
    ("SELECT 1", None, FAILS),
    ("SELECT 1", "SELECT 1) UNION (SELECT 1", FAILS),
    ("SELECT 1", "DROP VIEW n", FAILS),
    ("SELECT 1", "CREATE TABLE made AS SELECT 1", FAILS),
    ("SELECT 1", "WITH m AS (SELECT 1 AS x) INSERT INTO n SELECT * FROM m", FAILS),
    ("SELECT 1", "SET spark.sql.ansi.enabled=false", FAILS),
]


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("databases")
    table = spark.range(4).selectExpr("id AS x", "concat('t', id) AS t")
    table.write.parquet(str(root / "one" / "n.parquet"))
    spark.range(1).selectExpr("id AS y").write.parquet(str(root / "two" / "n.parquet"))
    sessions = {db: register_database(spark, db, str(root)) for db in ("one", "two")}
    with pytest.raises(FileNotFoundError):
        register_database(spark, "three", str(root))
    return sessions.__getitem__


@pytest.fixture(scope="module")
def verdicts(spark, database):
    rows = [(i, "one", gold, made) for i, (gold, made, _) in enumerate(PAIRS)]
    rows.append((len(rows), "absent", "SELECT 1", "SELECT 1"))
    schema = "idx long, db_id string, gold_sql string, generated_sql string"
    pairs = spark.createDataFrame(rows, schema).withColumn("method", F.lit("m"))
    return {r.idx: r for r in execution.evaluate(pairs, database).collect()}


@pytest.mark.parametrize("i", range(len(PAIRS)))
def test_verdict(verdicts, i):
    row, wanted = verdicts[i], PAIRS[i][2]
    assert row.gold_success
    assert row.gen_success is (wanted is not FAILS)
    assert row.execution_match is (wanted is EQUAL)


def test_unknown_database_fails_both(verdicts):
    row = verdicts[len(PAIRS)]
    assert (row.gold_success, row.gen_success, row.execution_match) == (False, False, False)


def test_databases_are_apart_and_unharmed(verdicts, database):
    assert list_tables(database("one")) == list_tables(database("two")) == ["n"]
    assert database("one").table("n").columns == ["x", "t"]
    assert database("two").table("n").columns == ["y"]


def test_outcomes_name_the_error(spark, database):
    statements = spark.createDataFrame(
        [("one", "SELECT 1 FROM nowhere"), ("one", None), ("one", "SELECT 1"), ("one", "SELECT 1")],
        "db_id string, sql string",
    )
    runs = execution.run_statements(statements, database, parallelism=2)
    errors = {r.sql: r.error for r in runs.outcomes.collect()}
    assert errors == {
        "SELECT 1 FROM nowhere": "TABLE_OR_VIEW_NOT_FOUND", None: "NULL_STATEMENT", "SELECT 1": None,
    }
    assert runs.rows.count() == 1
    nothing = execution.run_statements(statements.limit(0), database)
    assert nothing.outcomes.count() == nothing.rows.count() == 0


def test_equal_digests_are_still_compared_row_by_row(spark):
    rows = spark.createDataFrame(
        [("a", "1"), ("a", "1"), ("a", "2"), ("b", "2"), ("b", "1"), ("c", "3")],
        "stmt_id string, row_key string",
    )
    pairs = spark.createDataFrame(
        [(1, "a", "b"), (2, "a", "c"), (3, "x", "y"), (4, "a", "a"), (5, "a", "x"), (6, "a", "b")],
        "pair_id long, gold_id string, gen_id string",
    )
    equal = {r.pair_id: r.equal for r in execution.results_equal(pairs, rows).collect()}
    assert equal == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_settings_of_a_database(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "lax" / "n.parquet"))
    lax = register_database(spark, "lax", str(tmp_path), {"spark.sql.ansi.enabled": "false"})
    pairs = spark.createDataFrame(
        [(1, "lax", "SELECT id / 0 FROM n", "SELECT NULL"), (2, "strict", "SELECT 1 / 0", "SELECT NULL")],
        "pair_id long, db_id string, gold_sql string, generated_sql string",
    )
    sessions = {"lax": lax, "strict": spark}
    rows = execution.evaluate(pairs, sessions.__getitem__).collect()
    assert {r.pair_id: (r.gold_success, r.execution_match) for r in rows} == {1: (True, True), 2: (False, False)}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT x FROM n WHERE EXISTS (SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`)",
        "SELECT * FROM kept_table",
        "SELECT (SELECT max(v) FROM kept_table)",
    ],
)
def test_only_views_are_read(spark, database, sql):
    spark.sql("CREATE TABLE IF NOT EXISTS kept_table (v INT) USING parquet")
    try:
        statements = spark.createDataFrame([("one", sql), ("one", "SELECT x FROM n")], "db_id string, sql string")
        runs = execution.run_statements(statements, database)
        got = {r.sql: r.success for r in runs.outcomes.collect()}
        assert got == {sql: False, "SELECT x FROM n": True}
    finally:
        spark.sql("DROP TABLE kept_table")


def test_folders_do_not_grow_with_statements(spark, database, tmp_path):
    rows = [("one", f"SELECT x + {i} FROM n") for i in range(70)] + [("one", "SELECT CAST(t AS INT) FROM n")]
    runs = execution.run_statements(spark.createDataFrame(rows, "db_id string, sql string"), database, str(tmp_path / "runs"))
    assert runs.outcomes.filter("success").count() == 70 and runs.rows.count() == 280
    assert len(list((tmp_path / "runs" / "rows").iterdir())) <= 5


def test_a_late_statement_has_failed(spark, database):
    slow = "SELECT count(*) FROM range(100000) a CROSS JOIN range(1000000) b WHERE a.id * b.id % 7 = 3"
    statements = spark.createDataFrame([("one", slow), ("one", "SELECT x FROM n")], "db_id string, sql string")
    runs = execution.run_statements(statements, database, deadline=6.0)
    assert {r.sql: (r.success, r.error) for r in runs.outcomes.collect()} == {slow: (False, "DEADLINE"), "SELECT x FROM n": (True, None)}


def test_storage_faults_are_raised(spark, database):
    statements = spark.createDataFrame([("one", "SELECT x FROM n")], "db_id string, sql string")
    with pytest.raises(Exception):
        execution.run_statements(statements, database, "/proc/no/such/folder")
