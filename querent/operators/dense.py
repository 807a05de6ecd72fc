"""Dense retrieval: encoding, exact nearest vectors and the sweep over k."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.functions.vectors import normalize, similarity
from querent.operators.topk import (
    BLOCK_PAIRS,
    TASKS_PER_CORE,
    Limits,
    QuerySize,
    _arrow_type,
    _pieces,
    keep_own_database,
    require_mode,
    topk_hits,
)
from querent.session import stored
from querent.sources.files import read_partitioned

Encoder = Callable[[list[str]], np.ndarray]

OVERFETCH = 5
TIE_DECIMALS = 6

# Items are dealt by hash into buckets; every round of counting takes more of them,
# up to so many times all before. A block holds so many items.
BUCKETS = 1 << 16
GROWTH = 4
BLOCK_ITEMS = 1_024


def embed(
    df: DataFrame,
    text_col: str,
    encoder_factory: Callable[[], Encoder],
    batch_size: int = 32,
    vector_col: str = "v",
) -> DataFrame:
    """Add ``vector_col``: each text encoded, in batches, to one fixed length.

    The factory runs once per task, so a model is loaded once per task. Only the
    text goes to Python; the other columns stay where they are.
    """

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, dim = encoder_factory(), None
        for batch in batches:
            texts = batch.fillna("").tolist()
            vectors: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                matrix = np.asarray(encoder(texts[start : start + batch_size]), dtype=np.float64)
                dim = dim or matrix.shape[1]
                if matrix.shape[1] != dim:
                    raise ValueError(f"encoder gave {matrix.shape[1]} values, not {dim}")
                vectors.extend(matrix)
            yield pd.Series(vectors, dtype=object)

    # As if it were random: otherwise a filter on the vectors, even one Spark adds
    # itself, may be moved below and encode the texts a second time.
    encoded = F.pandas_udf(encode, "array<double>").asNondeterministic()
    return df.withColumn(vector_col, encoded(F.col(text_col)))


def embed_once(df: DataFrame, text_col: str, encoder_factory, batch_size: int = 32) -> DataFrame:
    """``embed``, stored in the shared folder: later reads do not encode again."""
    return stored(embed(df, text_col, encoder_factory, batch_size), "embedded")


def write_vector_index(
    items: DataFrame, path: str, vector_col: str = "v", partition_by: Sequence[str] = ("db_id",)
) -> None:
    """Store unit vectors with their metadata; the indexed text is left out.

    Partitioning by database lets a search within databases skip folders; give
    no columns where databases are very many. Rows are brought together by
    folder to avoid many small files; adaptive execution splits a large folder.
    """
    unit = items.withColumn("v", normalize(_usable(items, vector_col))).drop("text")
    if partition_by:
        unit = unit.hint("rebalance", *partition_by)
    unit.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def _usable(items: DataFrame, vector_col: str) -> Column:
    """The vector, or an error naming the item: null, of another length, or not finite."""
    v = F.col(vector_col)
    first = items.filter(v.isNotNull()).select(F.size(v).alias("dim")).first()
    dim = first.dim if first else 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    message = F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit(f" has no vector of {dim} finite numbers"))
    return F.when(v.isNotNull() & (F.size(v) == dim) & finite, v).otherwise(F.raise_error(message))


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index; searching one that was never built is an error."""
    return read_partitioned(spark, path, "db_id")


def _matrix(lists: pa.Array, ids: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of unit length; zero vectors stay zero. An unusable vector is an error naming its id."""
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    dim = dim if dim is not None else (int(lengths[0]) if len(lengths) else 0)
    if (lengths != dim).any():
        raise ValueError(f"{ids[int(np.argmax(lengths != dim))]} has no vector of {dim} numbers")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(lists), dim)
    odd = ~np.isfinite(matrix).all(axis=1)
    if odd.any():
        raise ValueError(f"{ids[int(np.argmax(odd))]} has a vector with a number that is null or not finite")
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norm > 0, norm, 1.0)


def _distance_scorer(queries: pa.Table):
    asked = _matrix(queries["v"].combine_chunks(), queries["query_id"])
    asked_square = (asked * asked).sum(axis=1)[:, None]

    def score(items: pa.RecordBatch) -> np.ndarray:
        held = _matrix(items["v"], items["item_id"], asked.shape[1] if len(asked) else None)
        square = (held * held).sum(axis=1)[None, :]
        return -np.maximum(asked_square + square - 2.0 * (asked @ held.T), 0.0)

    return score


def _measured(index: DataFrame, queries: DataFrame) -> tuple[QuerySize, int]:
    """The size of the queries and the bytes of one vector."""
    first = index.select(F.size("v").alias("dim")).first()
    vector_bytes = (first.dim if first else 0) * 8 + 64
    n_queries = queries.count()
    return QuerySize(n_queries, n_queries * vector_bytes), vector_bytes


def _nearest(
    index: DataFrame, queries: DataFrame, k: int, within: bool, limits: Limits, measured: tuple[QuerySize, int], with_tied: bool = False
) -> DataFrame:
    size, vector_bytes = measured
    db_id = F.col("db_id") if "db_id" in queries.columns else F.lit(None).cast("string")
    vector = F.col("v").cast("array<double>").alias("v")
    hits = topk_hits(
        index.select("item_id", F.col("corpus_idx").cast("bigint"), "db_id", vector),
        queries.select("query_id", db_id.alias("db_id"), vector),
        _distance_scorer,
        k,
        within=within,
        decimals=TIE_DECIMALS,
        size=size,
        item_bytes=lambda: index.count() * vector_bytes,
        limits=limits,
        with_tied=with_tied,
    )
    return hits.withColumn("distance", -F.col("goodness")).drop("goodness")


class _Ahead:
    """How many items come before each candidate of each query.

    ``asked``: ``query_id, v`` and the lists ``tied, corpus_idx, ahead`` of a query's
    candidates, best first, with the items counted so far. A candidate with
    ``enough`` items before it is given up, and with it all after it, so an item
    is looked at for the candidates only that are still open.
    """

    def __init__(self, asked: pa.Table, k: int, enough: int):
        self.asked, self.enough = asked, enough
        self.vectors = _matrix(asked["v"].combine_chunks(), asked["query_id"])
        self.square = (self.vectors * self.vectors).sum(axis=1)
        filled = np.arange(k) < pc.list_value_length(asked["tied"]).to_numpy()[:, None]

        def lists(name: str, value, dtype) -> np.ndarray:
            held = np.full(filled.shape, value, dtype=dtype)
            held[filled] = asked[name].combine_chunks().flatten().to_numpy()
            return held

        # Absent candidates come last and are given up from the start.
        self.tied, self.corpus_idx = lists("tied", -np.inf, np.float64), lists("corpus_idx", 0, np.int64)
        self.ahead = lists("ahead", enough, np.int64)
        self.before = self.ahead.copy()

    def add(self, items: pa.RecordBatch) -> None:
        held = _matrix(items["v"], items["item_id"], self.vectors.shape[1])
        half = (held * held).sum(axis=1) / 2
        corpus_idx = items["corpus_idx"].to_numpy()
        for start in range(0, len(held), BLOCK_ITEMS):
            block = slice(start, start + BLOCK_ITEMS)
            open_ones = (self.ahead < self.enough).sum(axis=1)
            waiting = np.flatnonzero(open_ones)
            step = max(1, BLOCK_PAIRS // len(held[block]))
            for first in range(0, len(waiting), step):
                rows = waiting[first : first + step]
                self._count(rows, open_ones[rows], held[block], half[block], corpus_idx[block])

    def _count(self, rows, open_ones, held, half, corpus_idx) -> None:
        worst = self.tied[rows, open_ones - 1]
        near = self.vectors[rows] @ held.T - half
        # Of what is farther than the worst open candidate, rounding included, nothing comes before it.
        least = (self.square[rows] + worst - 2 * 10.0**-TIE_DECIMALS) / 2
        query, item = np.nonzero(near >= least[:, None])
        tied = np.round(-np.maximum(self.square[rows[query]] - 2 * near[query, item], 0.0), TIE_DECIMALS)
        after, k = np.zeros(len(query), dtype=np.int64), self.tied.shape[1]
        for place in range(k):
            than, than_idx = self.tied[rows, place][query], self.corpus_idx[rows, place][query]
            after += (tied > than) | ((tied == than) & (corpus_idx[item] < than_idx))
        counts = np.bincount(query * (k + 1) + k - after, minlength=len(rows) * (k + 1)).reshape(-1, k + 1)
        self.ahead[rows] += np.cumsum(counts, axis=1)[:, :k]

    def found(self, schema: pa.Schema) -> pa.RecordBatch:
        """``(query_id, rank, n)``: what was counted, for candidates that were open."""
        n = np.where(self.before < self.enough, self.ahead - self.before, 0)
        query, place = np.nonzero(n)
        ids = self.asked["query_id"].combine_chunks().take(pa.array(query))
        columns = [ids.cast(schema.field(0).type), pa.array(place + 1, pa.int64()), pa.array(n[query, place], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _count_ahead(
    batches: Iterable[pa.RecordBatch], asked: pa.Table, k: int, enough: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    counted = _Ahead(asked, k, enough)
    for piece in _pieces(batches):
        counted.add(piece)
    yield counted.found(schema)


def _cells(asked_bytes: int, items_bytes: int, limit: int, least: int) -> tuple[int, int]:
    """Cells of queries and of items: bounded in bytes, ``least`` in all, with few copies of both."""
    q_cells, i_cells = max(1, ceil(2 * asked_bytes / limit)), max(1, ceil(items_bytes / limit))
    if q_cells * i_cells < least:
        q_cells = max(q_cells, min(least, round(sqrt(least * asked_bytes / max(items_bytes, 1)))))
        i_cells = max(i_cells, ceil(least / q_cells))
    return q_cells, i_cells


def _usable_rows(df: DataFrame, key: str, dim: int) -> int:
    """The number of rows; a vector that is null, of another length, or not finite is an error."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for piece in _pieces(batches):
            rows += len(_matrix(piece["v"], piece[key], dim))
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    counted = df.select(key, F.col("v").cast("array<double>").alias("v")).mapInArrow(look, "rows bigint")
    return counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def _own_among_nearest(
    index: DataFrame, queries: DataFrame, k: int, fetched: int, limits: Limits, measured: tuple[QuerySize, int]
) -> DataFrame:
    """The first ``k`` hits of a query's own database among its ``fetched`` nearest of all.

    What ranking everything and then keeping the own database gives, for many
    queries: the k nearest of the own database are the candidates, and each is a
    hit if fewer than ``fetched`` items come before it. So items are counted, not
    ranked, in rounds that take ever more of them by hash; a query whose nearest
    candidate has that many before it is done, and later rounds meet the others
    only. In the worst case all queries stay and every pair is scored once.
    Queries of one id count together, as they are ranked together.
    """
    if fetched < 1:
        raise ValueError("k must be positive")
    spark, vector_bytes = index.sparkSession, measured[1]
    query_bytes = vector_bytes + 24 * k
    first = queries.select(F.size("v").alias("dim")).first()
    dim = (first.dim if first else 0) or 0
    _usable_rows(queries, "query_id", dim)
    items_bytes = _usable_rows(index, "item_id", dim) * vector_bytes
    no_idx = F.lit(-(1 << 63)).cast("bigint")
    vector = F.col("v").cast("array<double>").alias("v")
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(BUCKETS)).cast("int")
    items = index.select("item_id", F.coalesce(F.col("corpus_idx").cast("bigint"), no_idx).alias("corpus_idx"), vector, bucket.alias("bucket"))
    vectors = queries.select("query_id", vector)
    id_type = queries.schema["query_id"].dataType
    out = f"query_id {id_type.simpleString()}, rank bigint, n bigint"
    schema = pa.schema([("query_id", _arrow_type(id_type)), ("rank", pa.int64()), ("n", pa.int64())])

    near = _nearest(index, queries, k, True, limits, measured, with_tied=True)
    candidates = stored(near.withColumn("ahead", F.lit(0).cast("bigint")), "candidates")
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    low, high = 0, min(BUCKETS, max(1, BUCKETS * limits.cell_bytes // (GROWTH * max(items_bytes, 1))))
    while low < BUCKETS:
        entry = F.struct("rank", "tied", F.coalesce("corpus_idx", no_idx).alias("corpus_idx"), "ahead")
        lists = candidates.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("c"))
        asked = vectors.join(lists, F.col("query_id").eqNullSafe(F.col("id"))).select(
            "query_id", "v", F.col("c.tied").alias("tied"), F.col("c.corpus_idx").alias("corpus_idx"), F.col("c.ahead").alias("ahead")
        )
        rows = asked.count()
        if not rows:
            break
        size = QuerySize(rows, rows * query_bytes)
        if limits.allow_broadcast(size):
            high, shipped = BUCKETS, spark.sparkContext.broadcast(asked.toArrow())

            def scan(batches, shipped=shipped):
                return _count_ahead(batches, shipped.value, k, fetched, schema)

            found = items.filter(F.col("bucket") >= low).coalesce(tasks).mapInArrow(scan, out)
        else:
            round_bytes = items_bytes * (high - low) // BUCKETS
            q_cells, i_cells = _cells(size.bytes, round_bytes, limits.cell_bytes, tasks)
            found = _count_in_cells(
                items.filter(F.col("bucket").between(low, high - 1)), asked, q_cells, i_cells, (low, high), k, fetched, schema, out
            )
        counted = found.groupBy(F.col("query_id").alias("id"), F.col("rank").alias("place")).agg(F.sum("n").alias("n"))
        same = F.col("query_id").eqNullSafe(F.col("id")) & (F.col("rank") == F.col("place"))
        added = candidates.join(counted, same, "left").withColumn("ahead", F.col("ahead") + F.coalesce("n", F.lit(0)))
        candidates = stored(added.drop("id", "place", "n").filter(F.col("ahead") < fetched), "candidates")
        low, high = high, min(BUCKETS, high * (1 + GROWTH))
    equal = Window.partitionBy("query_id", "tied", "corpus_idx").orderBy("rank")
    placed = candidates.withColumn("place", F.col("ahead") + F.row_number().over(equal))
    return placed.filter(F.col("place") <= fetched).drop("place", "ahead", "tied")


def _count_in_cells(
    items: DataFrame, asked: DataFrame, q_cells: int, i_cells: int, buckets: tuple[int, int], k: int, enough: int, schema: pa.Schema, out: str
) -> DataFrame:
    """``_count_ahead`` of queries and the items of a range of buckets, dealt into a grid of cells."""

    def dealt(df: DataFrame, q_cell, i_cell):
        cell = (q_cell * i_cells + i_cell).cast("int")
        return df.withColumn("cell", cell).repartition(q_cells * i_cells, "cell").groupBy("cell")

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def count(held: pa.Table, queries: pa.Table) -> pa.Table:
        if not held.num_rows or not queries.num_rows:
            return schema.empty_table()
        return pa.Table.from_batches(list(_count_ahead(held.to_batches(), queries, k, enough, schema)), schema=schema)

    low, high = buckets
    i_cell = F.floor((F.col("bucket") - low).cast("bigint") * i_cells / (high - low))
    q_cell = F.pmod(F.xxhash64("query_id"), F.lit(q_cells))
    return dealt(items.withColumn("copy", copies(q_cells)), F.col("copy"), i_cell).cogroup(
        dealt(asked.withColumn("copy", copies(i_cells)), q_cell, F.col("copy"))
    ).applyInArrow(count, out)


def add_similarity(hits: DataFrame) -> DataFrame:
    return hits.withColumn("similarity", similarity(F.col("distance")))


def vector_topk(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    within: bool = False,
    mode: str = "post",
    overfetch: int = OVERFETCH,
    limits: Limits = Limits(),
) -> DataFrame:
    """Exact nearest items by squared L2 distance of unit vectors.

    ``index``: ``item_id, corpus_idx, db_id, v``; ``queries``: ``query_id, db_id, v``.
    Result: ``query_id, db_id, rank, item_id, corpus_idx, item_db_id, distance,
    similarity``. ``within`` keeps to the query's database among the
    ``overfetch * k`` nearest (``post``; may give fewer than k) or before
    taking k (``pre``). ``post`` with queries beyond ``limits`` counts items
    instead of ranking them all; the hits are the same.
    """
    require_mode(mode)
    post = within and mode == "post"
    measured = _measured(index, queries)
    if post and not limits.allow_broadcast(measured[0]):
        return add_similarity(_own_among_nearest(index, queries, k, k * overfetch, limits, measured))
    hits = _nearest(index, queries, k * overfetch if post else k, within and not post, limits, measured)
    return add_similarity(keep_own_database(hits, k) if post else hits)


def vector_topk_sweep(
    index: DataFrame,
    queries: DataFrame,
    ks: Sequence[int],
    overfetch: int = OVERFETCH,
    limits: Limits = Limits(),
) -> DataFrame:
    """``vector_topk(within=True)`` for every k of ``ks``, from one scoring pass."""
    hits = _nearest(index, queries, overfetch * max(ks), False, limits, _measured(index, queries))
    anywhere = F.coalesce("db_id", F.lit("")) == ""
    # Own hits are numbered once; for each k they are those fetched whose number
    # is at most k (the number grows with the rank, so it equals a count per k).
    own = hits.filter(anywhere | (F.col("db_id") == F.col("item_db_id")))
    own = own.withColumn("own", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("bigint"))
    own = own.filter(F.col("own") <= max(ks))
    per_k = own.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    fetched = F.when(anywhere, F.col("k")).otherwise(F.col("k") * overfetch)
    kept = per_k.filter((F.col("rank") <= fetched) & (F.col("own") <= F.col("k")))
    return add_similarity(kept.withColumn("rank", F.col("own")).drop("own"))
