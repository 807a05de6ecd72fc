"""Inverted BM25 postings with block maxima, and exact top-k that skips blocks.

The postings of a word hold each document's impact, tf (k1 + 1) / (tf + k1 (1 -
b + b dl / avgdl)), so a document's score is the sum of query weight times
impact over the query's words. Postings are cut into blocks by impact (``BINS``
equal bins of the range (0, k1 + 1)). They are stored as short lists, one for
each word, block and database of about ``LIST_WORDS`` postings that a task
inverts at a time, with the largest impact of the list beside it: no row a
posting is ever shuffled, and a word found in a third of the corpus is no hot
key. The files are partitioned by a hash of the word and sorted by word and
block, so a search reads only the folders of the words it asks for, and the
scan's word filter skips row groups.

A search (all query weights positive; otherwise that query keeps every block):

1. the top blocks of each query word give documents partial scores, each at
   most the document's whole score; the k-th best of them, ``theta``, is at most
   the k-th best whole score;
2. blocks are skipped cheapest first (weight times block maximum), as long as
   the sum over words of the largest skipped bound stays below ``theta`` less a
   margin wider than the rounding of ties: a document found only in skipped
   blocks scores below ``theta`` and cannot be in the top k, so only the kept
   blocks name candidates, and the lists of skipped ones are not unfolded;
3. the documents that any query's kept blocks name are scored exactly from the
   forward index by the scorer of the plain scan, and ranked as it ranks: score
   rounded to ``decimals`` first, then corpus order. Pairs of query and document
   are rows for the top blocks only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.functions.text import tokenize
from querent.operators import bm25
from querent.operators.bm25 import TIE_DECIMALS, Bm25Index, word_pieces
from querent.operators.topk import TASKS_PER_CORE
from querent.session import new_run_dir, stored
from querent.sources.files import require_sources

BINS = 32
TERM_BUCKETS = 64
#: Postings a task inverts at a time; bounds its memory.
LIST_WORDS = 1 << 19
#: Blocks below the top one that also set theta.
TOP_BLOCKS = 2
#: Words named in the scan's filter; more are joined.
LITERAL_TERMS = 20_000


@dataclass(frozen=True)
class Postings:
    """``lists(term_bucket, term, block, db_id, max_impact, items, impacts)`` and
    ``repeated(item_id)``, the ids that several documents share."""

    lists: DataFrame
    repeated: DataFrame

    @property
    def rows(self) -> DataFrame:
        """``(term_bucket, term, block, db_id, item_id, impact)``, one row a posting."""
        return _unfolded(self.lists)

    @property
    def maxima(self) -> DataFrame:
        """``(term, block, max_impact, n)``"""
        return _maxima(self.lists)


def _unfolded(lists: DataFrame, *more: str) -> DataFrame:
    pairs = F.explode(F.arrays_zip("items", "impacts")).alias("p")
    names = ["term_bucket", "term", "block", "db_id", *more]
    return lists.select(*names, pairs).select(*names, F.col("p.items").alias("item_id"), F.col("p.impacts").alias("impact"))


def _maxima(lists: DataFrame) -> DataFrame:
    return lists.groupBy("term", "block").agg(F.max("max_impact").alias("max_impact"), F.sum(F.size("items")).alias("n"))


def _inverted(k1: float, b: float, avgdl: float):
    """From documents ``(item_id, db_id, dl, terms, tfs)`` to lists of postings."""

    def lists_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = pa.Table.from_batches(held).combine_chunks()
        terms = docs["terms"].combine_chunks()
        flat, doc = terms.flatten(), bm25._rows_of(terms)
        if not len(flat):
            return
        words = pc.unique(flat)
        code = pc.index_in(flat, value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        tf = docs["tfs"].combine_chunks().flatten().to_numpy().astype(np.float64)
        dl = docs["dl"].to_numpy().astype(np.float64)[doc]
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (avgdl or 1.0)))
        block = np.clip(np.floor(impact / ((k1 + 1) / BINS)), 0, BINS - 1).astype(np.int64)
        names = docs["db_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        db = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        key = (code * BINS + block) * len(names.dictionary) + db
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        offsets = pa.array(np.r_[first, len(order)], pa.int32())
        chosen = order[first]
        batch = pa.RecordBatch.from_arrays(
            [
                words.take(pa.array(code[chosen])),
                pa.array(block[chosen], pa.int32()),
                names.dictionary.take(pa.array(db[chosen])),
                pa.array(np.maximum.reduceat(impact[order], first)),
                pa.ListArray.from_arrays(offsets, docs["item_id"].combine_chunks().take(pa.array(doc[order]))),
                pa.ListArray.from_arrays(offsets, pa.array(impact[order])),
            ],
            names=["term", "block", "db_id", "max_impact", "items", "impacts"],
        )
        yield from (batch.slice(i, 1 << 16) for i in range(0, batch.num_rows, 1 << 16))

    def invert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in word_pieces(batches, LIST_WORDS // 4, "terms"):
            held.append(piece)
            size += len(piece.column("terms").flatten())
            if size >= LIST_WORDS:
                yield from lists_of(held)
                held, size = [], 0
        if held:
            yield from lists_of(held)

    return invert


def write_postings(index: Bm25Index, path: str) -> None:
    """Write the postings of ``index`` and the ids that come twice below ``path``.

    Every task writes what it inverts, without a shuffle; the tasks are a fixed
    number a core, so files stay few.
    """
    one = index.stats.first()
    spark = index.docs.sparkSession
    docs = index.docs.filter(F.col("item_id").isNotNull()).select("item_id", "db_id", F.col("dl").cast("bigint").alias("dl"), "terms", "tfs")
    item_type = docs.schema["item_id"].dataType.simpleString()
    schema = f"term string, block int, db_id string, max_impact double, items array<{item_type}>, impacts array<double>"
    bucket = F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int")
    (
        docs.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        .mapInArrow(_inverted(one.k1, one.b, one.avgdl), schema)
        .withColumn("term_bucket", bucket)
        .sortWithinPartitions("term_bucket", "term", F.desc("block"))
        .write.partitionBy("term_bucket")
        .parquet(f"{path}/lists")
    )
    repeated = docs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("item_id")
    repeated.write.parquet(f"{path}/repeated")


def read_postings(spark: SparkSession, path: str) -> Postings:
    require_sources(spark, [f"{path}/lists", f"{path}/repeated"])
    repeated = spark.read.parquet(f"{path}/repeated")
    item_type = repeated.schema["item_id"].dataType.simpleString()
    schema = f"term string, block int, db_id string, max_impact double, items array<{item_type}>, impacts array<double>, term_bucket int"
    return Postings(spark.read.schema(schema).parquet(f"{path}/lists"), repeated)


def build_postings(index: Bm25Index, path: str | None = None) -> Postings:
    """Write the postings (to the shared folder by default) and open them."""
    spark = index.docs.sparkSession
    path = path or f"{new_run_dir(spark, 'postings')}-{uuid.uuid4().hex[:8]}"
    write_postings(index, path)
    return read_postings(spark, path)


def _asked(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """``(query_id, db_id, term, w)``: a query's words known to the index, weight qtf * idf."""
    db_id = F.col("db_id") if "db_id" in queries.columns else F.lit(None).cast("string")
    words = queries.select("query_id", db_id.alias("db_id"), F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("term"))
    counted = words.groupBy("query_id", "db_id", "term").agg(F.count("*").alias("qtf"))
    return counted.join(index.terms, "term").select("query_id", "db_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))


def _asked_lists(found: Postings, asked: DataFrame) -> DataFrame:
    """The lists of the words asked for.

    Up to ``LITERAL_TERMS`` words (counted first) are named in the filter, so that
    only their folders are listed and the scan's statistics skip row groups of
    other words; more are found by a semi-join.
    """
    words = asked.select("term").distinct()
    if words.count() <= LITERAL_TERMS:
        named = words.select("term", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int").alias("b")).collect()
        names, buckets = [r["term"] for r in named], sorted({r["b"] for r in named})
        return found.lists.filter(F.col("term_bucket").isin(buckets) & F.col("term").isin(names))
    return found.lists.join(words, "term", "left_semi")


def _asked_rows(found: Postings, asked: DataFrame) -> DataFrame:
    """The postings of the words asked for, one row each."""
    return _unfolded(_asked_lists(found, asked))


def candidates(found: Postings, asked: DataFrame, k: int, within: bool, decimals: int) -> DataFrame:
    """``(item_id)``: every document that may be among the k best of a query."""
    lists = _asked_lists(found, asked)
    maxima = stored(_maxima(lists).select("term", "block", "max_impact"), "postings-maxima")
    named = lists.withColumnRenamed("db_id", "item_db_id")
    own = (F.coalesce(F.col("db_id"), F.lit("")) == "") | (F.col("db_id") == F.col("item_db_id")) if within else F.lit(True)
    top = maxima.groupBy("term").agg(F.max("block").alias("top"))

    # 1. theta from the top blocks: partial scores never exceed whole ones. An id
    # of several documents would add up their scores, so it sets no theta.
    high = asked.join(top, "term").withColumn("block", F.explode(F.sequence(F.col("top") - (TOP_BLOCKS - 1), F.col("top"))))
    first = high.select("query_id", "db_id", "term", "w", "block").join(named, ["term", "block"]).filter(own)
    first = _unfolded(first, "query_id", "w").join(found.repeated, "item_id", "left_anti")
    partial = first.groupBy("query_id", "item_id").agg(F.sum(F.col("w") * F.col("impact")).alias("partial"))
    best = Window.partitionBy("query_id").orderBy(F.desc("partial"))
    theta = (
        partial.withColumn("r", F.row_number().over(best))
        .filter(F.col("r") == k)
        .select("query_id", F.col("partial").alias("theta"))
    )
    weights = asked.groupBy("query_id").agg(F.min("w").alias("least_w"))

    # 2. blocks to skip: cheapest bounds first, while the sum over words of the
    # largest skipped bound stays below theta less a margin wider than the
    # rounding of ties; a document only in skipped blocks scores below theta
    margin = 10.0 ** -(decimals - 1)
    cells = (
        asked.join(maxima, "term")
        .withColumn("bound", F.col("w") * F.col("max_impact"))
        .join(weights, "query_id")
        .join(theta, "query_id", "left")
    )
    by_word = Window.partitionBy("query_id", "term").orderBy("bound", "block")
    by_bound = Window.partitionBy("query_id").orderBy("bound", "term", "block").rowsBetween(Window.unboundedPreceding, 0)
    rise = F.col("bound") - F.coalesce(F.lag("bound").over(by_word), F.lit(0.0))
    skipped = cells.withColumn("rise", rise).withColumn("reach", F.sum("rise").over(by_bound))
    budget = F.col("theta") * (1 - 1e-9) - margin
    skip = (F.col("least_w") > 0) & budget.isNotNull() & (F.col("reach") < budget)
    read = skipped.filter(~F.coalesce(skip, F.lit(False)))

    # a list that several queries keep is unfolded once
    whose = F.coalesce(F.col("db_id"), F.lit("")) if within else F.lit("")
    read = stored(read.select("term", "block", whose.alias("whose")).distinct(), "postings-read")
    everywhere = read.filter("whose = ''").select("term", "block")
    inside = read.filter("whose <> ''").join(everywhere, ["term", "block"], "left_anti")
    kept = lists.join(everywhere, ["term", "block"], "left_semi").select("items")
    if within:
        of_db = inside.withColumnRenamed("whose", "db_id")
        kept = kept.unionByName(lists.join(of_db, ["term", "block", "db_id"], "left_semi").select("items"))
    return kept.select(F.explode("items").alias("item_id")).distinct()


def _restricted(index: Bm25Index, chosen: DataFrame) -> Bm25Index:
    """The index with the documents of the ``chosen`` ids alone, and those without an id, which have no postings."""
    kept = index.docs.join(stored(chosen, "postings-chosen"), "item_id", "left_semi").select(*index.docs.columns)
    return replace(index, docs=kept.unionByName(index.docs.filter(F.col("item_id").isNull())))


def bm25_topk_pruned(
    index: Bm25Index,
    found: Postings,
    queries: DataFrame,
    k: int,
    within: bool = False,
    decimals: int = TIE_DECIMALS,
) -> DataFrame:
    """``(query_id, db_id, rank, item_id, corpus_idx, item_db_id, score)``: documents sharing a word.

    Equal to ``bm25_topk(..., fill=False)`` in mode ``pre``: the k best documents
    that share a word with the query (within its database if ``within`` and the
    query has one); ties by score rounded to ``decimals``, then corpus order. A
    query without a known word gets no rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = stored(_asked(index, queries), "postings-asked")
    chosen = candidates(found, asked, k, within, decimals)
    return bm25.bm25_topk(_restricted(index, chosen), queries, k, within=within, fill=False, decimals=decimals)


def filler_pool(index: Bm25Index, k: int) -> DataFrame:
    """``(item_id)``: the first k documents by corpus order of every database and of the whole corpus.

    k rows a database: it grows with the number of databases, not with documents.
    """
    docs = index.docs.select("item_id", "corpus_idx", "db_id")
    first = Window.partitionBy("db_id").orderBy("corpus_idx")
    by_db = docs.filter(F.col("db_id").isNotNull()).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    return by_db.select("item_id").unionByName(docs.orderBy("corpus_idx").limit(k).select("item_id"))


def bm25_topk_filled(
    index: Bm25Index,
    found: Postings,
    queries: DataFrame,
    k: int,
    within: bool = False,
    decimals: int = TIE_DECIMALS,
) -> DataFrame:
    """``bm25_topk(..., fill=True)`` from the postings and a pool of first documents.

    Every query gets k documents (fewer only where its database has fewer):
    those sharing a word rank by score, the rest score zero and follow corpus
    order. With no negative query weight, a document of score zero among the k
    best is among the first k of its database (or of the corpus), since all
    documents before it rank before it; so the documents that the kept blocks
    name and the pool, scored exactly, hold the whole answer. A query with a
    negative weight (idf of a word in most documents, floored below zero) may
    rank a document below unmatched ones further down, so such queries take the
    exact scan, ``bm25_topk``, instead.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = stored(_asked(index, queries), "postings-asked")
    signs = asked.groupBy("query_id").agg((F.min("w") < 0).alias("negative"))
    db_id = F.col("db_id") if "db_id" in queries.columns else F.lit(None).cast("string")
    plain = queries.select("query_id", db_id.alias("db_id"), "text").join(signs, "query_id", "left")
    plain = stored(plain.withColumn("negative", F.coalesce("negative", F.lit(False))), "postings-queries")
    safe, rest = (plain.filter(F.col("negative") == sign).drop("negative") for sign in (False, True))

    wanted = asked.join(signs.filter("not negative"), "query_id", "left_semi")
    chosen = candidates(found, wanted, k, within, decimals).unionByName(filler_pool(index, k)).distinct()
    filled = bm25.bm25_topk(_restricted(index, chosen), safe, k, within=within, fill=True, decimals=decimals)
    if rest.isEmpty():
        return filled
    exact = bm25.bm25_topk(index, rest, k, within=within, fill=True, decimals=decimals)
    return filled.unionByName(exact.select(*filled.columns))
