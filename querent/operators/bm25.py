"""BM25 retrieval over a tokenised corpus."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querent.functions.text import tokenize
from querent.operators.topk import Limits, QuerySize, keep_own_database, require_mode, topk_hits
from querent.session import new_run_dir
from querent.sources.files import require_sources

# The Okapi defaults.
K1, B, EPSILON = 1.5, 0.75, 0.25
TIE_DECIMALS = 6
# Words counted at a time; bounds the memory of a task whatever a batch holds.
PIECE_WORDS = 1 << 18


@dataclass(frozen=True)
class Bm25Index:
    """``docs(item_id, corpus_idx, db_id, dl, terms, tfs)``, ``terms(term, df, idf)``
    and one row of ``stats``. Statistics always cover the whole corpus."""

    docs: DataFrame
    terms: DataFrame
    stats: DataFrame


def token_counts(corpus: DataFrame) -> DataFrame:
    """``(item_id, term, tf)``: how often each item holds each word."""
    words = corpus.select("item_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return words.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def postings(index: Bm25Index) -> DataFrame:
    """``(item_id, db_id, dl, term, tf)`` of an index."""
    pairs = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    return index.docs.select("item_id", "db_id", "dl", pairs).select(
        "item_id", "db_id", "dl", F.col("p.terms").alias("term"), F.col("p.tfs").cast("bigint").alias("tf")
    )


def word_pieces(batches: Iterable[pa.RecordBatch], words: int, name: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about ``words`` list values (of the last column), one row at least."""
    for batch in batches:
        lists = batch.column(name or batch.num_columns - 1)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + words, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column, tokens, by its distinct words, sorted, and their counts."""
    for batch in word_pieces(batches, PIECE_WORDS):
        lists = batch.column(batch.num_columns - 1)
        row, flat = _rows_of(lists), lists.flatten()
        words = pc.unique(flat)
        words = words.take(pc.sort_indices(words))
        code = pc.index_in(flat, value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        seen, tf = np.unique(row * max(len(words), 1) + code, return_counts=True)
        row, code = np.divmod(seen, max(len(words), 1))
        offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        terms = pa.ListArray.from_arrays(offsets, words.take(pa.array(code)))
        tfs = pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept, terms, tfs], names=[*batch.schema.names[:-1], "terms", "tfs"])


def write_bm25_index(
    corpus: DataFrame,
    path: str,
    k1: float = K1,
    b: float = B,
    epsilon: float = EPSILON,
    partition_by: Sequence[str] = ("db_id",),
) -> None:
    """Store the words of each item with their counts, by database, then the statistics.

    A search within databases skips the folders of all others; give no columns
    where databases are very many. Every index is written to a folder of its own
    and named in ``current`` last, so readers never see half of one.
    """
    spark = corpus.sparkSession
    version = uuid.uuid4().hex
    root = f"{path}/{version}"
    tokens = tokenize(F.coalesce("text", F.lit("")))
    read = corpus.select(
        "item_id", F.col("corpus_idx").cast("bigint").alias("corpus_idx"),
        F.col("db_id").cast("string").alias("db_id"), F.size(tokens).cast("bigint").alias("dl"), tokens.alias("tokens"),
    )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    counted = read.mapInArrow(_count_terms, f"{fields}, terms array<string>, tfs array<int>")
    if partition_by:
        counted = counted.hint("rebalance", *partition_by)
    counted.write.partitionBy(*partition_by).parquet(f"{root}/docs")
    docs = spark.read.schema(counted.schema).parquet(f"{root}/docs")
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("n_tokens")).first()
    n_docs, n_tokens = totals.n, totals.n_tokens or 0

    # A word counts once per document, so the explode sends distinct words only.
    words = docs.select(F.explode("terms").alias("term"))
    df = F.col("df")
    plain_idf = F.log(F.lit(float(n_docs)) - df + 0.5) - F.log(df + 0.5)
    words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn(
        "plain_idf", plain_idf
    ).write.parquet(f"{root}/terms")
    spark.read.parquet(f"{root}/terms").agg(
        F.lit(n_docs).cast("bigint").alias("n_docs"),
        F.lit(n_tokens).cast("bigint").alias("n_tokens"),
        F.lit(n_tokens / n_docs if n_docs else 0.0).alias("avgdl"),
        F.count(F.lit(1)).alias("n_terms"),
        F.coalesce(F.avg("plain_idf"), F.lit(0.0)).alias("avg_idf"),
        F.lit(float(k1)).alias("k1"),
        F.lit(float(b)).alias("b"),
        F.lit(float(epsilon)).alias("epsilon"),
        F.lit(counted.schema.json()).alias("docs_schema"),
    ).coalesce(1).write.parquet(f"{root}/stats")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode(
        "append"
    ).parquet(f"{path}/current")


def read_bm25_index(spark: SparkSession, path: str) -> Bm25Index:
    """The index that was published last."""
    require_sources(spark, [f"{path}/current"])
    current = spark.read.schema("version string, at timestamp").parquet(f"{path}/current")
    path = f"{path}/{current.orderBy(F.desc('at')).first().version}"
    stats = spark.read.parquet(f"{path}/stats")
    one = stats.first()
    floor = F.lit(one.epsilon * one.avg_idf)
    terms = spark.read.parquet(f"{path}/terms").select(
        "term", "df", F.when(F.col("plain_idf") < 0, floor).otherwise(F.col("plain_idf")).alias("idf")
    )
    schema = T.StructType.fromJson(json.loads(one.docs_schema))
    return Bm25Index(spark.read.schema(schema).parquet(f"{path}/docs"), terms, stats)


def build_bm25_index(corpus: DataFrame, path: str | None = None, **params: float) -> Bm25Index:
    """Write the index tables (to the shared folder by default) and open them."""
    spark = corpus.sparkSession
    path = path or new_run_dir(spark, "bm25")
    write_bm25_index(corpus, path, **params)
    return read_bm25_index(spark, path)


def _query_weights(index: Bm25Index, queries: DataFrame, few: bool) -> DataFrame:
    """``(query_id, db_id, terms, weights)``; a repeated word counts again.

    The words of few queries are broadcast, so that the whole vocabulary is
    scanned but not shuffled.
    """
    db_id = F.col("db_id") if "db_id" in queries.columns else F.lit(None).cast("string")
    asked = queries.select(
        "query_id", db_id.alias("db_id"), tokenize(F.coalesce("text", F.lit(""))).alias("tokens")
    )
    words = asked.select("query_id", F.explode("tokens").alias("term"))
    counted = words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighted = (
        index.terms.join(F.broadcast(counted) if few else counted, "term")
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w")))
            ).alias("tw")
        )
    )
    return asked.join(weighted, "query_id", "left").select(
        "query_id",
        "db_id",
        F.coalesce(F.col("tw.term"), F.array().cast("array<string>")).alias("terms"),
        F.coalesce(F.col("tw.w"), F.array().cast("array<double>")).alias("weights"),
    )


def _size(queries: DataFrame) -> QuerySize:
    """A word takes its text, a weight and an offset: at most ten bytes per character."""
    row = queries.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes"),
    ).first()
    return QuerySize(row.n, 10 * row.text_bytes + 64 * row.n)


def _rows_of(lists: pa.Array) -> np.ndarray:
    """For each value of a list array, the row it belongs to."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(lists)), lengths)


def _bm25_scorer(k1: float, b: float, avgdl: float, matched_only: bool):
    """Scores of a block of documents, one query word at a time."""

    def scorer(queries: pa.Table):
        terms = queries["terms"].combine_chunks()
        vocabulary = pc.unique(terms.flatten())
        weight = queries["weights"].combine_chunks().flatten().to_numpy()
        asking_query = _rows_of(terms)
        code = pc.index_in(terms.flatten(), value_set=vocabulary).to_numpy()
        by_code = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[by_code], np.arange(len(vocabulary) + 1))

        def score(items: pa.RecordBatch) -> np.ndarray:
            words = items["terms"]
            found = pc.index_in(words.flatten(), value_set=vocabulary)
            known = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            term, item = found.drop_null().to_numpy().astype(np.int64), _rows_of(words)[known]
            # Term first, so that each word's documents lie next to each other.
            order = np.argsort(term, kind="stable")
            term, item = term[order], item[order]
            tf = items["tfs"].flatten().to_numpy()[known[order]]
            dl = items["dl"].to_numpy()[item]
            impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (avgdl or 1.0)))

            scores = np.zeros((queries.num_rows, items.num_rows))
            matched = np.zeros(scores.shape, dtype=bool)
            present, starts = np.unique(term, return_index=True)
            for t, start, end in zip(present, starts, np.r_[starts[1:], len(term)]):
                asking = by_code[bounds[t] : bounds[t + 1]]
                cells = np.ix_(asking_query[asking], item[start:end])
                scores[cells] += np.outer(weight[asking], impact[start:end])
                if matched_only:
                    matched[cells] = True
            return np.where(matched, scores, np.nan) if matched_only else scores

        return score

    return scorer


def bm25_topk(
    index: Bm25Index,
    queries: DataFrame,
    k: int,
    within: bool = False,
    mode: str = "pre",
    fill: bool = True,
    overfetch: int = 5,
    decimals: int = TIE_DECIMALS,
    limits: Limits = Limits(),
) -> DataFrame:
    """``(query_id, db_id, rank, item_id, corpus_idx, item_db_id, score)``.

    ``within`` keeps to the query's database: before taking k (``pre``) or
    among the ``overfetch * k`` best (``post``). ``fill`` returns k items even
    where fewer share a word with the query, the others with score zero.
    """
    require_mode(mode)
    one, size = index.stats.first(), _size(queries)
    hits = topk_hits(
        index.docs,
        _query_weights(index, queries, limits.allow_broadcast(size)),
        _bm25_scorer(one.k1, one.b, one.avgdl, matched_only=not fill),
        k * overfetch if within and mode == "post" else k,
        within=within and mode == "pre",
        decimals=decimals,
        size=size,
        item_bytes=lambda: one.n_tokens * 16 + one.n_docs * 64,
        limits=limits,
    ).withColumnRenamed("goodness", "score")
    return keep_own_database(hits, k) if within and mode == "post" else hits
