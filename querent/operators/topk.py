"""Exact top-k of many queries over many items, scored inside tasks.

Every task scores blocks of its items against the queries and keeps only the k
best per query; these few rows are shuffled by query and ranked. Pairs of query
and item are never rows of a DataFrame, and no item is left out.

Two ways to bring queries and items together:

* few queries (their number and size are measured first): they are broadcast,
  and the items are scanned once without a shuffle;
* more: both sides are dealt by hash into a grid of bounded cells, each cell is
  one co-group, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.session import stored

# Given the queries, a function from a block of items to a matrix (queries, items):
# larger is better, NaN where an item is no candidate.
Scorer = Callable[[pa.Table], Callable[[pa.RecordBatch], np.ndarray]]

# Pairs scored at a time, bytes of items looked at and hits held; they bound the
# memory of a task to about 100 MB whatever a batch or a cell holds.
BLOCK_PAIRS = 500_000
PIECE_BYTES = 8 << 20
KEPT_HITS = 1 << 18
TASKS_PER_CORE = 4


@dataclass(frozen=True)
class QuerySize:
    """Number of queries and a bound of the bytes they take, both measured."""

    rows: int
    bytes: int


@dataclass(frozen=True)
class Limits:
    """Bounds of what one task or the driver may hold."""

    broadcast_queries: int = 5_000
    broadcast_bytes: int = 64 << 20
    cell_queries: int = 5_000
    cell_bytes: int = 64 << 20

    def allow_broadcast(self, size: QuerySize) -> bool:
        return size.rows <= self.broadcast_queries and size.bytes <= self.broadcast_bytes


class _Group:
    """Queries that look at the same items, and where they stand among all."""

    def __init__(self, queries: pa.Table, positions: np.ndarray, scorer: Scorer):
        self.positions = positions
        self.score = scorer(queries.take(pa.array(positions)))


class _Groups:
    """Splits queries by what they look at, so that only pairs that count are scored.

    Searching within databases, a block of items meets the queries of its own
    database; queries without one, and all queries otherwise, meet every item.
    """

    def __init__(self, queries: pa.Table, scorer: Scorer, within: bool):
        names = pc.coalesce(queries["db_id"], pa.scalar("")).combine_chunks()
        self.names = pc.unique(names).filter(pc.not_equal(pc.unique(names), ""))
        code = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy()
        if not within:
            code = np.full(len(code), -1)
            self.names = self.names.slice(0, 0)
        self.make = lambda positions: _Group(queries, positions, scorer)
        self.of_code = {c: np.flatnonzero(code == c) for c in np.unique(code)}
        self.made: dict[int, _Group] = {}

    def _group(self, code: int) -> _Group:
        if code not in self.made:
            self.made[code] = self.make(self.of_code[code])
        return self.made[code]

    def meetings(self, items: pa.RecordBatch) -> Iterator[tuple[_Group, pa.RecordBatch]]:
        """Each group with its items of this batch, the items in corpus order."""
        items = items.take(pc.sort_indices(items["corpus_idx"]))
        if -1 in self.of_code:
            yield self._group(-1), items
        if len(self.names):
            code = pc.fill_null(pc.index_in(items["db_id"], value_set=self.names), -1).to_numpy()
            by_code = np.argsort(code, kind="stable")
            present, starts = np.unique(code[by_code], return_index=True)
            for c, rows in zip(present, np.split(by_code, starts[1:])):
                if c >= 0:
                    yield self._group(c), items.take(pa.array(rows))


def _best_mask(goodness: np.ndarray, k: int) -> np.ndarray:
    """True for the k largest per row; of equal values the leftmost are taken."""
    if goodness.shape[1] <= k:
        return goodness > -np.inf
    kth = -np.partition(-goodness, k - 1, axis=1)[:, k - 1 : k]
    above = goodness > kth
    equal = goodness == kth
    room = k - above.sum(axis=1, keepdims=True)
    mask = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return mask & (goodness > -np.inf)


class _Keeper:
    """The k best hits per query among everything it was given."""

    def __init__(self, k: int):
        self.k, self.parts, self.rows, self.limit = k, [], 0, KEPT_HITS

    def add(self, query, tied, goodness, corpus_idx, item_id, db_id) -> None:
        self.parts.append((query, tied, goodness, corpus_idx, item_id, db_id))
        self.rows += len(query)
        if self.rows > self.limit:
            self.best()
            self.limit = max(self.limit, 2 * self.rows)

    def best(self):
        if not self.parts:
            return None
        columns = [np.concatenate(column) for column in zip(*self.parts)]
        query, tied, _, corpus_idx = columns[:4]
        order = np.lexsort((corpus_idx, -tied, query))
        starts = np.r_[True, np.diff(query[order]) != 0]
        position = np.arange(len(order))
        rank = position - np.maximum.accumulate(np.where(starts, position, 0))
        kept = order[rank < self.k]
        columns = [column[kept] for column in columns]
        self.parts, self.rows = [tuple(columns)], len(kept)
        return columns


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``PIECE_BYTES``, one row at least."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _scan_batches(
    batches: Iterable[pa.RecordBatch],
    queries: pa.Table,
    scorer: Scorer,
    k: int,
    within: bool,
    decimals: int,
    schema: pa.Schema,
) -> Iterator[pa.RecordBatch]:
    keeper, groups = _Keeper(k), _Groups(queries, scorer, within)
    for piece in _pieces(batches):
        for group, items in groups.meetings(piece):
            block = max(1, BLOCK_PAIRS // len(group.positions))
            for start in range(0, items.num_rows, block):
                part = items.slice(start, block)
                goodness = group.score(part)
                goodness[np.isnan(goodness)] = -np.inf
                tied = np.round(goodness, decimals)
                query, item = np.nonzero(_best_mask(tied, k))
                keeper.add(
                    group.positions[query],
                    tied[query, item],
                    goodness[query, item],
                    *(
                        part[name].to_numpy(zero_copy_only=False)[item]
                        for name in ("corpus_idx", "item_id", "db_id")
                    ),
                )
    best = keeper.best()
    if best is not None and len(best[0]):
        query, tied, goodness, corpus_idx, item_id, db_id = best
        asked = queries.select(["query_id", "db_id"]).take(pa.array(query))
        columns = [asked["query_id"], asked["db_id"], item_id, corpus_idx, db_id, goodness, tied]
        arrays = [
            column.combine_chunks().cast(field.type)
            if isinstance(column, pa.ChunkedArray)
            else pa.array(column, type=field.type, from_pandas=True)
            for column, field in zip(columns, schema)
        ]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def topk_hits(
    items: DataFrame,
    queries: DataFrame,
    scorer: Scorer,
    k: int,
    *,
    within: bool,
    decimals: int,
    size: QuerySize,
    item_bytes: Callable[[], int],
    limits: Limits = Limits(),
    with_tied: bool = False,
) -> DataFrame:
    """``(query_id, db_id, rank, item_id, corpus_idx, item_db_id, goodness)``.

    ``with_tied`` adds ``tied``, the rounded score by which hits are ranked.
    ``items``: ``item_id, corpus_idx, db_id`` and what the scorer reads.
    ``queries``: ``query_id, db_id`` and what the scorer reads; ``size`` decides
    how they travel. Scores equal to ``decimals`` places are ties and keep corpus
    order, so results do not depend on the order of floating-point sums.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = items.sparkSession
    query_type, item_type = queries.schema["query_id"].dataType, items.schema["item_id"].dataType
    out = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("db_id", T.StringType()),
            T.StructField("item_id", item_type),
            T.StructField("corpus_idx", T.LongType()),
            T.StructField("item_db_id", T.StringType()),
            T.StructField("goodness", T.DoubleType()),
            T.StructField("tied", T.DoubleType()),
        ]
    )
    arrow_out = pa.schema(
        [
            ("query_id", _arrow_type(query_type)),
            ("db_id", pa.string()),
            ("item_id", _arrow_type(item_type)),
            ("corpus_idx", pa.int64()),
            ("item_db_id", pa.string()),
            ("goodness", pa.float64()),
            ("tied", pa.float64()),
        ]
    )
    if limits.allow_broadcast(size):
        table = queries.toArrow()
        shipped = spark.sparkContext.broadcast(table)

        def scan(batches):
            return _scan_batches(batches, shipped.value, scorer, k, within, decimals, arrow_out)

        if within:
            items = _prune_databases(items, table)
        # A task keeps k hits per query, so fewer tasks leave fewer to merge.
        tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        found = items.coalesce(tasks).mapInArrow(scan, out)
    else:
        cell = _cell_function(scorer, k, within, decimals, arrow_out)
        anywhere = F.coalesce(F.col("db_id"), F.lit("")) == ""
        everywhere = queries.filter(anywhere) if within else queries
        q_rows = everywhere.count() if within else size.rows
        q_cells = max(1, ceil(max(q_rows / limits.cell_queries, q_rows * size.bytes / max(size.rows, 1) / limits.cell_bytes)))
        i_cells = max(1, ceil(item_bytes() / limits.cell_bytes))
        parts = [_grid(items, everywhere, q_cells, i_cells).applyInArrow(cell, out)] if q_rows or not within else []
        if within:
            dealt = _grid_by_database(items, queries.filter(~anywhere), size, item_bytes(), limits)
            parts.append(dealt.applyInArrow(cell, out))
        found = reduce(DataFrame.unionByName, parts)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("tied"), "corpus_idx")
    ranked = found.withColumn("rank", F.row_number().over(best_first).cast("bigint"))
    return ranked.filter(F.col("rank") <= k).select(
        "query_id", "db_id", "rank", "item_id", "corpus_idx", "item_db_id", "goodness", *["tied"] * with_tied
    )


def _prune_databases(items: DataFrame, queries: pa.Table) -> DataFrame:
    """Let the scan skip databases nobody asks for, where the list is short."""
    asked = pc.unique(queries["db_id"]).to_pylist()
    if all(asked) and len(asked) <= 1_000:
        return items.filter(F.col("db_id").isin(asked))
    return items


def _cell_function(scorer, k, within, decimals, schema):
    def cell(items: pa.Table, queries: pa.Table) -> pa.Table:
        if not items.num_rows or not queries.num_rows:
            return schema.empty_table()
        whole = items.combine_chunks().to_batches()
        found = _scan_batches(whole, queries.combine_chunks(), scorer, k, within, decimals, schema)
        return pa.Table.from_batches(list(found), schema=schema)

    return cell


def _grid(items: DataFrame, queries: DataFrame, q_cells: int, i_cells: int):
    """Deal items and queries by hash so that every pair meets in one cell."""

    def dealt(df: DataFrame, key: str, own: str, own_cells: int, other: str, other_cells: int):
        cell = F.pmod(F.xxhash64(key), F.lit(own_cells)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(other_cells - 1)))
        return df.withColumn(own, cell).withColumn(other, copies).groupBy("q_cell", "i_cell")

    return dealt(items, "item_id", "i_cell", i_cells, "q_cell", q_cells).cogroup(
        dealt(queries, "query_id", "q_cell", q_cells, "i_cell", i_cells)
    )


def plan_database_cells(items: DataFrame, queries: DataFrame, size: QuerySize, total_bytes: int, limits: Limits) -> DataFrame:
    """``(db_id, q_cells, i_cells)`` for every database that queries ask for.

    A database's items take its share of the item bytes, its queries their
    share of the query bytes; each side is cut into as many cells as its bound
    asks for, so a database of 90 % of the items is split as the whole corpus
    would be, and a small one is one cell. Databases nobody asks for get none.
    """
    n_items = items.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_items"))
    n_queries = queries.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_queries"))
    every = n_items.agg(F.sum("n_items")).first()[0] or 1
    per_item, per_query = total_bytes / every, size.bytes / max(size.rows, 1)
    q_cells = F.greatest(
        F.ceil(F.col("n_queries") / limits.cell_queries), F.ceil(F.col("n_queries") * per_query / limits.cell_bytes), F.lit(1)
    )
    i_cells = F.greatest(F.ceil(F.col("n_items") * per_item / limits.cell_bytes), F.lit(1))
    return n_queries.join(n_items, "db_id").select("db_id", q_cells.cast("int").alias("q_cells"), i_cells.cast("int").alias("i_cells"))


def _grid_by_database(items: DataFrame, queries: DataFrame, size: QuerySize, total_bytes: int, limits: Limits):
    """Cells within databases: a query meets only the items of its own database.

    Scored pairs are those of one database, not all queries times all items;
    the plan has one row a database asked for.
    """
    plan = plan_database_cells(items, queries, size, total_bytes, limits)

    def dealt(df: DataFrame, key: str, own: str, own_cells: str, other: str, other_cells: str):
        cell = F.pmod(F.xxhash64(key), F.col(own_cells)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other_cells) - 1))
        placed = df.join(plan, "db_id").withColumn(own, cell).withColumn(other, copies)
        return placed.drop("q_cells", "i_cells").groupBy("db_id", "q_cell", "i_cell")

    return dealt(items, "item_id", "i_cell", "i_cells", "q_cell", "q_cells").cogroup(
        dealt(queries, "query_id", "q_cell", "q_cells", "i_cell", "i_cells")
    )


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    types = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    if data_type not in types:
        raise TypeError(f"ids must be bigint, int or string, not {data_type.simpleString()}")
    return types[data_type]


def attach_items(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add the corpus columns to the hits.

    The hits are stored first: the scoring is not repeated, and as their size is
    known, few hits are broadcast and the corpus is scanned without a shuffle.
    """
    return stored(hits, "hits").join(corpus.drop("corpus_idx", "db_id"), "item_id")


def require_mode(mode: str) -> None:
    if mode not in ("pre", "post"):
        raise ValueError(f"mode must be pre or post, not {mode}")


def keep_own_database(hits: DataFrame, k: int) -> DataFrame:
    """Of ranked hits, those in the query's database, ranked again, first k."""
    anywhere = F.coalesce("db_id", F.lit("")) == ""
    own = hits.filter(anywhere | (F.col("db_id") == F.col("item_db_id")))
    again = Window.partitionBy("query_id").orderBy("rank")
    return own.withColumn("rank", F.row_number().over(again).cast("bigint")).filter(
        F.col("rank") <= k
    )
