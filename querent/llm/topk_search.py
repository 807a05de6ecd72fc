"""Exact top-k by inner product: columnar branch-and-bound.

A block of queries is compared with blocks of candidates in vertical layout
(dimension by dimension). Scores are accumulated a few dimensions at a time;
after each step the mass that remains bounds what a pair can still gain
(Cauchy-Schwarz on the unread dimensions), and pairs that cannot reach the
query's k-th best score are compacted away. Nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.session import new_run_dir, stored

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 1024
STEP = 8
DENSE_SHARE = 0.15
EXACT = 2.0**42
FOUND = "query_key long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """``(id, v)``: components as floor(scale * x); repeated rows once.

    Vectors that are null, empty, or hold a null or non-finite component, and
    rows without an id, are left out.
    """
    x = F.col(vec_col)
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & (F.size(x) > 0) & usable)
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"),
        )
        .distinct()
    )


class _Best:
    """The k best candidates of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.owner = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.ids = np.zeros(0, np.int64)
        self.kth = np.full(queries, -np.inf)
        self.kth_id = np.full(queries, np.iinfo(np.int64).max)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner = np.concatenate([self.owner, owner])
        score = np.concatenate([self.score, score])
        ids = np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
        keep = rank < self.k
        self.owner, self.score, self.ids = owner[keep], score[keep], ids[keep]
        last = rank == self.k - 1
        self.kth[owner[last]] = score[last]
        self.kth_id[owner[last]] = ids[last]


def _search_block(q_ids, q, best: _Best, ids, columns) -> None:
    """Add the candidates ``columns`` (dimensions x candidates, ids ascending) to ``best``."""
    dims, n = columns.shape
    q_left = np.sqrt(np.cumsum((q**2)[:, ::-1], axis=1))[:, ::-1]
    c_left = np.sqrt(np.cumsum((columns**2)[::-1], axis=0))[::-1]
    partial = np.zeros((len(q), n))
    done, live = 0, None
    while done < dims:
        upto = min(done + STEP, dims)
        partial += q[:, done:upto] @ columns[done:upto]
        done = upto
        if done == dims:
            break
        reach = q_left[:, done, None] * c_left[None, done]
        reach *= 1 + 1e-9
        reach += partial
        live = reach >= best.kth[:, None]
        if np.count_nonzero(live) <= DENSE_SHARE * live.size:
            break
    if done == dims:
        # unique keys: the score, then the smaller id
        key = partial * n
        key += np.arange(n - 1, -1, -1)
        key[q_ids[:, None] == ids[None, :]] = -np.inf
        if n > best.k:
            floor = np.partition(key, n - best.k, axis=1)[:, n - best.k]
            chosen = (key >= floor[:, None]) & (partial >= best.kth[:, None]) & np.isfinite(key)
        else:
            chosen = (partial >= best.kth[:, None]) & np.isfinite(key)
        owner, at = np.nonzero(chosen)
        best.add(owner, partial[owner, at], ids[at])
        return
    owner, at = np.nonzero(live)
    score = partial[owner, at]
    rows = np.ascontiguousarray(columns.T)
    while done < dims:
        upto = min(done + STEP, dims)
        score = score + np.einsum("ij,ij->i", q[owner, done:upto], rows[at, done:upto])
        done = upto
        if done < dims:
            reach = score + q_left[owner, done] * c_left[done, at] * (1 + 1e-9)
        else:
            reach = score
        keep = reach >= best.kth[owner]
        owner, at, score = owner[keep], at[keep], score[keep]
    keep = (q_ids[owner] != ids[at]) & (
        (score > best.kth[owner]) | (ids[at] < best.kth_id[owner])
    )
    best.add(owner[keep], score[keep], ids[at[keep]])


def _search_exact(q_ids, q, best: _Best, ids, rows) -> None:
    """Components too large for exact doubles: whole numbers of any size."""
    scores = np.asarray(q, dtype=object) @ np.asarray(rows, dtype=object).T
    for i in range(len(q)):
        for j in range(len(ids)):
            if q_ids[i] != ids[j]:
                best.add(np.array([i]), np.array([scores[i, j]], dtype=object), ids[j : j + 1])


def _searcher(queries, first_key: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_whole = queries.value
        dims = q_whole.shape[1]
        # the heaviest dimensions first: what remains shrinks soonest
        order = np.argsort(-np.abs(q_whole.astype(float)).sum(axis=0), kind="stable")
        q = np.ascontiguousarray(q_whole[:, order].astype(float))
        best = _Best(len(q_ids), k)
        top = np.abs(q).max(initial=0)
        for batch in batches:
            all_ids = batch.column(0).to_numpy()
            values = batch.column(1).flatten().to_numpy().reshape(len(all_ids), dims)
            by_id = np.argsort(all_ids, kind="stable")
            for start in range(0, len(all_ids), CANDIDATE_BLOCK):
                part = by_id[start : start + CANDIDATE_BLOCK]
                rows = values[part]
                if dims * top * np.abs(rows.astype(float)).max(initial=0) * CANDIDATE_BLOCK >= EXACT * 1024:
                    _search_exact(q_ids, q_whole[:, order], best, all_ids[part], rows[:, order])
                    continue
                columns = np.ascontiguousarray(rows[:, order].T.astype(float))
                _search_block(q_ids, q, best, all_ids[part], columns)
        if len(best.owner):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(best.owner + first_key, pa.int64()),
                    pa.array(q_ids[best.owner], pa.int64()),
                    pa.array(best.ids, pa.int64()),
                    pa.array([int(s) for s in best.score], pa.int64()),
                ],
                names=["query_key", "query_id", "vec_id", "score"],
            )

    return search


def exact_topk(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` items of highest inner product.

    Both tables are ``(id long, v array<long>)`` without nulls. An item with the
    query's own id takes no part; ties go to the smaller id; vectors are only
    compared with vectors of as many dimensions. Scores must fit a long.

    Queries come in blocks of about ``QUERY_BLOCK`` (a bounded broadcast each);
    every block is one pass over the stored items, and what a task returns is at
    most k rows a query. An empty table gives an empty result.
    """
    spark = items.sparkSession
    items = stored(items.withColumn("dims", F.size("v")), "topk-items")
    queries = queries.withColumn("dims", F.size("v"))
    sizes = {row["dims"]: row["n"] for row in queries.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, -(-n // QUERY_BLOCK))]) if sizes else None
    found_dir = new_run_dir(spark, "topk-found")
    key = 0
    if sizes:
        dealt = stored(
            queries.withColumn("part", F.pmod(F.xxhash64("id", "v"), parts[F.col("dims")]).cast("int")),
            "topk-queries",
        )
        for dims, n in sorted(sizes.items()):
            for part in range(-(-n // QUERY_BLOCK)):
                rows = dealt.filter((F.col("dims") == dims) & (F.col("part") == part)).select("id", "v").toArrow()
                ids = rows.column("id").to_numpy()
                matrix = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dims)
                block = spark.sparkContext.broadcast((ids, matrix))
                candidates = items.filter(F.col("dims") == dims).select("id", "v")
                candidates.mapInArrow(_searcher(block, key, k), FOUND).write.mode("append").parquet(found_dir)
                block.unpersist()
                key += len(ids)
    found = spark.read.schema(FOUND).parquet(found_dir) if sizes else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
