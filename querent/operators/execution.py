"""Running statements and comparing their results as sets of rows."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.rowkeys import row_keys
from querent.session import new_run_dir, stored

OUTCOME_SCHEMA = "stmt_id string, db_id string, sql string, success boolean, error string"
ROW_SCHEMA = "stmt_id string, row_key string"
STATEMENTS_PER_BATCH = 16
DEADLINE_SECONDS = 600.0
#: Classes of exceptions that no statement causes.
STORAGE_FAULTS = ("java.io.", "java.nio.file.", "org.apache.hadoop.", "java.lang.OutOfMemoryError")
#: Leaves of a plan: views over files, rows of the statement itself, common table expressions.
READABLE = ("LogicalRelation", "LocalRelation", "OneRowRelation", "OneRowRelation$", "Range", "CTERelationRef")


@dataclass(frozen=True)
class StatementRuns:
    """``outcomes(stmt_id, db_id, sql, success, error)`` and
    ``rows(stmt_id, row_key)``, the result rows of the successful ones."""

    outcomes: DataFrame
    rows: DataFrame


def statement_id(db_id: Column, sql: Column) -> Column:
    return F.sha2(F.to_json(F.struct(db_id.alias("d"), sql.alias("s"))), 256)


def _condition(error: Exception) -> str:
    name = error.getCondition() if isinstance(error, PySparkException) else None
    return name or type(error).__name__


def _storage_failed(error: Exception) -> bool:
    """Whether storage or memory failed, not the statement."""
    cause = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    while cause is not None:
        if cause.getClass().getName().startswith(STORAGE_FAULTS):
            return True
        cause = cause.getCause()
    return isinstance(error, OSError) and not isinstance(error, FileNotFoundError)


def _only_views(query: DataFrame) -> None:
    """Raise unless the query reads nothing but temp views and rows it writes itself."""
    plan = query._jdf.queryExecution().analyzed()
    nested = plan.subqueriesAll()
    for part in [plan, *(nested.apply(i) for i in range(nested.size()))]:
        leaves = part.collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            kind = leaf.getClass().getSimpleName()
            if kind not in READABLE or kind == "LogicalRelation" and leaf.catalogTable().isDefined():
                raise RefusedStatement(kind)


class RefusedStatement(Exception):
    """A statement that reads what is not a view of its database."""


def _keys_of(session: SparkSession, sql: str) -> DataFrame:
    """The row keys of a statement, analysed.

    Only queries are taken. A text that starts as a query cannot be anything
    else; any other must first be valid as a subquery, which no command is.
    """
    query = sql.strip().rstrip(";")
    if not query.upper().startswith(("SELECT", "VALUES")):
        session.sql(f"SELECT * FROM (\n{query}\n)")
    result = session.sql(query)
    _only_views(result)
    return row_keys(result)


class _Lane:
    """Runs batches of statements one after the other; several lanes share the work."""

    def __init__(self, spark, database, path: str, number: int, deadline: float):
        self.spark, self.database, self.deadline = spark, database, deadline
        self.rows, self.outcomes = f"{path}/rows/lane={number}", f"{path}/outcomes/lane={number}"

    def run(self, batch: list) -> None:
        """Analyse each statement of one database, then run all that are valid as one job."""
        done, frames = [], []
        for row in batch:
            try:
                if row.sql is None:
                    raise RefusedStatement("NULL_STATEMENT")
                keys = _keys_of(self.database(row.db_id), row.sql)
                frames.append((row, keys.select(F.lit(row.stmt_id).alias("stmt_id"), "row_key")))
            except Exception as error:
                if _storage_failed(error):
                    raise
                told = str(error) if isinstance(error, RefusedStatement) else _condition(error)
                done.append((row.stmt_id, row.db_id, row.sql, False, told))
        done.extend(self._write(frames))
        self.spark.createDataFrame(done, OUTCOME_SCHEMA).coalesce(1).write.mode("append").parquet(self.outcomes)

    def _write(self, frames: list, again: bool = True) -> list:
        """Outcomes of valid statements; a batch that fails is halved until the culprits stand alone."""
        if not frames:
            return []
        tag, context = f"statements-{uuid.uuid4().hex}", self.spark.sparkContext
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.deadline, stop)
        try:
            context.addJobTag(tag)
            timer.start()
            keys = reduce(DataFrame.unionAll, [frame for _, frame in frames])
            keys.distinct().write.mode("append").parquet(self.rows)
            return [(row.stmt_id, row.db_id, row.sql, True, None) for row, _ in frames]
        except Exception as error:
            if _storage_failed(error) and not late.is_set():
                if not again:
                    raise
                return self._write(frames, again=False)
            if len(frames) > 1:
                half = len(frames) // 2
                return self._write(frames[:half]) + self._write(frames[half:])
            row = frames[0][0]
            told = "DEADLINE" if late.is_set() else _condition(error)
            return [(row.stmt_id, row.db_id, row.sql, False, told)]
        finally:
            timer.cancel()
            context.removeJobTag(tag)


def run_statements(
    statements: DataFrame,
    database: Callable[[str], SparkSession],
    path: str | None = None,
    parallelism: int = 4,
    deadline: float = DEADLINE_SECONDS,
) -> StatementRuns:
    """Run every distinct ``(db_id, sql)`` once.

    Statements are data: the driver streams their texts and analyses each. Those
    of one database then run together, as one job that writes distinct row keys;
    the driver holds no result rows, and the number of folders does not grow with
    the statements. A job that fails or takes longer than ``deadline`` seconds is
    halved, so a statement that does so alone has failed. Errors of analysis and
    evaluation are outcomes; faults of storage are tried again, then raised.

    Statements read the views of their database and nothing else.
    """
    spark = statements.sparkSession
    path = path or new_run_dir(spark, "statements")
    keyed = statements.select(
        statement_id(F.col("db_id"), F.col("sql")).alias("stmt_id"), "db_id", "sql"
    ).distinct()
    for table, schema in (("rows", ROW_SCHEMA), ("outcomes", OUTCOME_SCHEMA)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{table}/lane=-1")

    pending = keyed.orderBy("db_id", "stmt_id").toLocalIterator(prefetchPartitions=False)
    lock = threading.Lock()
    held: list = []

    def next_batch() -> list:
        """The next statements of one database."""
        with lock:
            batch = []
            while len(batch) < STATEMENTS_PER_BATCH:
                row = held.pop() if held else next(pending, None)
                if row is None or batch and row.db_id != batch[0].db_id:
                    held.extend([row] if row else [])
                    break
                batch.append(row)
            return batch

    def work(number: int) -> None:
        lane = _Lane(spark, database, path, number, deadline)
        while batch := next_batch():
            lane.run(batch)

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(work, range(parallelism)))
    outcomes = spark.read.schema(OUTCOME_SCHEMA).parquet(f"{path}/outcomes")
    rows = spark.read.schema(ROW_SCHEMA).parquet(f"{path}/rows")
    return StatementRuns(outcomes.drop("lane"), rows.select("stmt_id", "row_key"))


def results_equal(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs(pair_id, gold_id, gen_id)`` with ``equal``: same set of rows.

    Per statement, a row count and a digest decide most pairs: where they
    differ the sets differ. Only pairs that agree on both are compared row by
    row, each distinct pair of statements once. An absent row set is empty.

    What the digests say is stored, one small row per pair: it is used twice,
    and its known size lets the rows be joined without a shuffle by statement.
    """
    digests = rows.distinct().groupBy("stmt_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("row_key")).alias("digest"),
    )

    def side(name: str) -> DataFrame:
        return digests.select(
            F.col("stmt_id").alias(f"{name}_id"),
            F.col("n").alias(f"{name}_n"),
            F.col("digest").alias(f"{name}_digest"),
        )

    sized = pairs.join(side("gold"), "gold_id", "left").join(side("gen"), "gen_id", "left")
    same_size = F.coalesce("gold_n", F.lit(0)) == F.coalesce("gen_n", F.lit(0))
    same_digest = F.coalesce("gold_digest", F.lit(0)) == F.coalesce("gen_digest", F.lit(0))
    sized = stored(
        sized.select(*pairs.columns, (same_size & same_digest).alias("alike")), "digests"
    )
    open_pairs = (
        sized.filter(F.col("alike") & (F.col("gold_id") != F.col("gen_id")))
        .select("gold_id", "gen_id")
        .distinct()
    )
    sides = open_pairs.select(
        "gold_id",
        "gen_id",
        F.inline(
            F.array(
                F.struct(F.col("gold_id").alias("stmt_id"), F.lit(1).alias("side")),
                F.struct(F.col("gen_id").alias("stmt_id"), F.lit(2).alias("side")),
            )
        ),
    )
    one_sided = (
        sides.join(rows, "stmt_id")
        .groupBy("gold_id", "gen_id", "row_key")
        .agg(F.bit_or("side").alias("sides"))
        .filter(F.col("sides") < 3)
        .select("gold_id", "gen_id")
        .distinct()
        .withColumn("differs", F.lit(True))
    )
    equal = F.col("alike") & ~F.coalesce("differs", F.lit(False))
    return sized.join(one_sided, ["gold_id", "gen_id"], "left").select(
        *pairs.columns, equal.alias("equal")
    )


def execution_match(pairs: DataFrame, runs: StatementRuns) -> DataFrame:
    """``pairs(..., db_id, gold_sql, generated_sql)`` with ``execution_match,
    gold_success, gen_success``: both ran and gave the same set of rows."""
    keyed = pairs.withColumn("gold_id", statement_id(F.col("db_id"), F.col("gold_sql")))
    keyed = keyed.withColumn("gen_id", statement_id(F.col("db_id"), F.col("generated_sql")))
    ok = runs.outcomes.select("stmt_id", "success")
    for name in ("gold", "gen"):
        keyed = keyed.join(
            ok.withColumnsRenamed({"stmt_id": f"{name}_id", "success": f"{name}_success"}),
            f"{name}_id",
            "left",
        )
    compared = results_equal(keyed, runs.rows)
    both = F.col("gold_success") & F.col("gen_success")
    return compared.select(
        *pairs.columns,
        F.coalesce(both & F.col("equal"), F.lit(False)).alias("execution_match"),
        F.coalesce("gold_success", F.lit(False)).alias("gold_success"),
        F.coalesce("gen_success", F.lit(False)).alias("gen_success"),
    )


def statements_of(pairs: DataFrame) -> DataFrame:
    """The distinct ``(db_id, sql)`` of gold and generated statements."""
    both = F.explode(F.array("gold_sql", "generated_sql"))
    return pairs.select("db_id", both.alias("sql")).distinct()


def evaluate(
    pairs: DataFrame,
    database: Callable[[str], SparkSession],
    path: str | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Detail rows for ``pairs(method, idx, question, db_id, gold_sql, generated_sql)``.

    A gold statement shared by several methods runs once.
    """
    runs = run_statements(statements_of(pairs), database, path, parallelism)
    return execution_match(pairs, runs)
