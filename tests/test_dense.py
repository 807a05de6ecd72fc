import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querent.functions.encoders import hashing_encoder
from querent.functions.vectors import l2_norm, normalize, similarity, squared_l2
from querent.operators import dense
from querent.operators.topk import Limits

GRID = Limits(broadcast_queries=0, cell_queries=4, cell_bytes=2_000)


def unit(matrix):
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm > 0, norm, 1)


def model(vectors, queries, k):
    """All squared distances, nearest first; ties by position."""
    near = {}
    for q, query in enumerate(unit(queries)):
        distance = ((unit(vectors) - query) ** 2).sum(axis=1).round(6)
        near[q] = sorted(range(len(vectors)), key=lambda i: (distance[i], i))[:k]
    return near


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 6))
    vectors[10:20] = vectors[0]
    vectors[30] = 0
    dbs = ["hot" if i % 3 else f"d{i % 5}" for i in range(90)]
    queries = np.vstack([rng.normal(size=(7, 6)), vectors[0], np.zeros(6)])
    asked_dbs = ["hot", "d0", "d1", "d2", "d3", None, "", "hot", "none"]
    items = spark.createDataFrame(
        [(i, i, dbs[i], v.tolist()) for i, v in enumerate(vectors)],
        "item_id long, corpus_idx long, db_id string, v array<double>",
    )
    asked = spark.createDataFrame(
        [(q, asked_dbs[q], v.tolist()) for q, v in enumerate(queries)],
        "query_id long, db_id string, v array<float>",
    )
    queries = queries.astype(np.float32).astype(float)
    return vectors, dbs, queries, asked_dbs, items, asked


def found(hits, *keys):
    rows = {}
    for r in hits.orderBy(*keys, "query_id", "rank").collect():
        rows.setdefault(tuple(r[k] for k in keys) + (r.query_id,), []).append(r.item_id)
    return rows


@pytest.mark.parametrize("limits", [Limits(), GRID], ids=["broadcast", "grid"])
def test_global_search_is_exact(case, limits):
    vectors, _, queries, _, items, asked = case
    hits = dense.vector_topk(items, asked, 8, limits=limits)
    assert found(hits) == {(q,): ids for q, ids in model(vectors, queries, 8).items()}
    one = hits.filter("query_id = 7 AND rank = 1").first()
    assert (one.item_id, round(one.distance, 6), round(one.similarity, 6)) == (0, 0.0, 1.0)


def test_post_filter_may_give_fewer(case):
    vectors, dbs, queries, asked_dbs, items, asked = case
    wanted = {}
    for q, ids in model(vectors, queries, 15).items():
        own = [i for i in ids if not asked_dbs[q] or dbs[i] == asked_dbs[q]][:3]
        if own:
            wanted[(q,)] = own
    assert found(dense.vector_topk(items, asked, 3, within=True)) == wanted
    assert any(len(ids) < 3 for ids in wanted.values())


@pytest.mark.parametrize("limits", [Limits(), GRID], ids=["broadcast", "grid"])
def test_pre_filter_fills_up(case, limits):
    vectors, dbs, queries, asked_dbs, items, asked = case
    wanted = {}
    for q, ids in model(vectors, queries, len(vectors)).items():
        own = [i for i in ids if not asked_dbs[q] or dbs[i] == asked_dbs[q]][:4]
        if own:
            wanted[(q,)] = own
    hits = dense.vector_topk(items, asked, 4, within=True, mode="pre", limits=limits)
    assert found(hits) == wanted


def test_sweep_is_one_search_per_k(case):
    items, asked = case[-2:]
    swept = found(dense.vector_topk_sweep(items, asked, [2, 5]), "k")
    for k in (2, 5):
        single = found(dense.vector_topk(items, asked, k, within=True))
        assert {key[1:]: ids for key, ids in swept.items() if key[0] == k} == single


def test_k_beyond_the_index_returns_what_there_is(case):
    items, asked = case[-2:]
    assert {len(ids) for ids in found(dense.vector_topk(items, asked, 1000)).values()} == {90}


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<double>")
    row = df.select(
        l2_norm(F.col("a")).alias("norm"),
        normalize(F.col("a")).alias("unit"),
        normalize(F.col("z")).alias("zero"),
        squared_l2(F.col("a"), F.col("z")).alias("d"),
        similarity(F.lit(3.0)).alias("s"),
    ).first()
    assert (row.norm, row.zero, row.d, row.s) == (5.0, [0.0, 0.0], 25.0, 0.25)
    assert row.unit == pytest.approx([0.6, 0.8])


def test_embed_and_index_round_trip(spark, tmp_path):
    rows = [(i, i, f"d{i % 2}", f"word{i} the", f"q{i}") for i in range(50)] + [(50, 50, "d0", None, "q")]
    items = spark.createDataFrame(
        rows, "item_id long, corpus_idx long, db_id string, text string, question string"
    )
    encoded = dense.embed(items, "text", hashing_encoder(32), batch_size=4)
    assert {len(r.v) for r in encoded.collect()} == {32}
    path = str(tmp_path / "index")
    dense.write_vector_index(encoded, path)
    stored = dense.read_vector_index(spark, path)
    assert "text" not in stored.columns and stored.count() == 51
    norms = {r.item_id: r.n for r in stored.select("item_id", l2_norm(F.col("v")).alias("n")).collect()}
    assert norms[50] == 0 and norms[0] == pytest.approx(1)
    asked = items.filter("item_id IN (3, 4)").select(F.col("item_id").alias("query_id"), "db_id", "text")
    hits = dense.vector_topk(stored, dense.embed_once(asked, "text", hashing_encoder(32)), 1, within=True)
    assert sorted((r.query_id, round(r.distance, 6)) for r in hits.collect()) == [(3, 0), (4, 0)]
    plan = dense.vector_topk(stored, dense.embed(asked, "text", hashing_encoder(32)), 1, within=True, mode="pre")
    assert "PartitionFilters: [db_id" in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        dense.read_vector_index(spark, str(tmp_path / "none"))


def test_database_names_that_look_like_numbers(spark, tmp_path):
    rows = [(i, i, db, [1.0, float(i)], "t") for i, db in enumerate(["007", "7", "1e2", None])]
    items = spark.createDataFrame(
        rows, "item_id long, corpus_idx long, db_id string, v array<double>, text string"
    )
    dense.write_vector_index(items, str(tmp_path / "index"))
    index = dense.read_vector_index(spark, str(tmp_path / "index"))
    assert {r.item_id: r.db_id for r in index.collect()} == {0: "007", 1: "7", 2: "1e2", 3: None}
    asked = spark.createDataFrame([(1, "007", [1.0, 0.0])], "query_id long, db_id string, v array<double>")
    hits = dense.vector_topk(index, asked, 3, within=True, mode="pre").collect()
    assert [r.item_id for r in hits] == [0]


def test_texts_are_encoded_once(spark):
    df = spark.range(5).selectExpr("id", "concat('word', id) AS text").repartition(3)
    encoded = dense.embed(df, "text", hashing_encoder(8))
    used = encoded.select("id", F.posexplode("v").alias("place", "n")).filter("n > 0")
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert used.count() == 5


def test_vectors_of_different_length_are_an_error(spark):
    bad = lambda: lambda texts: np.zeros((len(texts), 2 + len(texts)))
    df = spark.range(3).selectExpr("'x' AS text").coalesce(1)
    with pytest.raises(Exception, match="encoder gave"):
        dense.embed(df, "text", bad, batch_size=2).collect()


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, float("nan"), 0.0], [1.0, None, 0.0], [float("inf"), 0.0, 0.0]])
@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_queries=0)])
def test_unusable_vectors_are_errors(spark, tmp_path, bad, limits):
    schema = "item_id long, corpus_idx long, db_id string, v array<double>"
    items = spark.createDataFrame([(1, 1, "a", [1.0, 2.0, 3.0]), (7, 2, "a", bad)], schema)
    with pytest.raises(Exception, match="7"):
        dense.write_vector_index(items, str(tmp_path / "index"))
    asked = spark.createDataFrame([(0, "a", [0.0, 1.0, 0.0])], "query_id long, db_id string, v array<double>")
    with pytest.raises(Exception, match="7"):
        dense.vector_topk(items, asked, 2, limits=limits).collect()
    other = spark.createDataFrame([(0, "a", [0.0, 1.0])], "query_id long, db_id string, v array<double>")
    with pytest.raises(Exception, match="numbers"):
        dense.vector_topk(items.filter("item_id = 1"), other, 2, limits=limits).collect()
    with pytest.raises(ValueError):
        dense.vector_topk(items, asked, 2, within=True, mode="both")


MANY = [GRID, Limits(broadcast_queries=0), Limits(broadcast_queries=20, cell_bytes=4_000)]


def close(spark, n_items, n_queries, n_dbs):
    """Items and queries on few places, so that ties are many; ids, databases and vectors repeat or are absent."""
    rng = np.random.default_rng(11)
    held, asked = (rng.integers(0, 3, size=(n, 8)).astype(float) for n in (n_items, n_queries))
    held[20:30], held[40] = held[0], 0
    asked[0], asked[1] = held[0], 0
    db = lambda i: None if i % 37 == 5 else "" if i % 41 == 7 else f"d{i % n_dbs}"
    items = [(i - 10 if 60 <= i < 70 else i, db(i), v.tolist()) for i, v in enumerate(held)]
    rows = [(i or None, "none" if i % 29 == 3 else db(i), v.tolist()) for i, v in enumerate(asked)]
    rows += rows[10:15] + [(i, db(i + i % 2), asked[i + 1].tolist()) for i in range(15, 25)]
    return (
        spark.createDataFrame(items, "item_id long, db_id string, v array<double>").withColumn("corpus_idx", F.col("item_id")),
        spark.createDataFrame(rows, "query_id long, db_id string, v array<float>"),
    )


@pytest.mark.parametrize("limits", MANY, ids=["rounds", "cells", "rounds then broadcast"])
def test_post_filter_of_many_queries_is_the_same(spark, limits):
    items, asked = close(spark, 300, 60, 12)
    for k, overfetch in ((3, 4), (4, 1_000)):
        rows = []
        for given in (Limits(), limits):
            hits = dense.vector_topk(items, asked, k, within=True, overfetch=overfetch, limits=given)
            shown = hits.withColumns({name: F.round(name, 6) for name in ("distance", "similarity")})
            rows.append((hits.columns, sorted(shown.collect(), key=str)))
        assert rows[0] == rows[1]
        assert rows[0][1]


def test_post_filter_of_many_queries_ranks_no_others(spark, monkeypatch):
    """Pairs with items of other databases are counted while they matter, not ranked."""
    items, asked = close(spark, 600, 60, 20)
    ranked, plain = spark.sparkContext.accumulator(0), dense._distance_scorer

    def scorer(queries):
        score = plain(queries)

        def counted(block):
            ranked.add(queries.num_rows * block.num_rows)
            return score(block)

        return counted

    monkeypatch.setattr(dense, "_distance_scorer", scorer)
    asked = asked.filter("coalesce(db_id, '') <> ''")
    assert dense.vector_topk(items, asked, 3, within=True, limits=Limits(broadcast_queries=0)).count()
    assert 0 < ranked.value < items.count() * asked.count() / 10


def test_counting_ends_with_enough_before(monkeypatch):
    def batch(ids, vectors, **more):
        return pa.table({"query_id": ids, "item_id": ids, "v": vectors, "corpus_idx": ids, **more})

    asked = batch([7, 8], [[1.0, 0.0], [0.0, 1.0]]).drop(["corpus_idx"])
    for name, lists in {"tied": [[-0.5, -1.0], [-0.5]], "corpus_idx": [[3, 4], [5]], "ahead": [[0, 1], [0]]}.items():
        asked = asked.append_column(name, pa.array(lists))
    near = batch(list(range(100)), [[1.0, 0.0]] * 100).to_batches()[0]
    monkeypatch.setattr(dense, "BLOCK_ITEMS", 10)
    counted, blocks = dense._Ahead(asked, 2, 4), []
    count = counted._count
    counted._count = lambda rows, *rest: (blocks.append(list(rows)), count(rows, *rest))
    counted.add(near)
    assert blocks == [[0, 1]] + [[1]] * 9
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int64()), ("n", pa.int64())])
    assert counted.found(schema).to_pylist() == [{"query_id": 7, "rank": 1, "n": 10}, {"query_id": 7, "rank": 2, "n": 10}]


def test_unusable_vectors_of_many_queries_are_errors(spark):
    schema = "{} long, corpus_idx long, db_id string, v array<double>"
    items = spark.createDataFrame([(1, 1, "a", [1.0, 2.0]), (7, 2, "b", [float("nan"), 0.0])], schema.format("item_id"))
    asked = spark.createDataFrame([(0, 0, "a", [0.0, 1.0]), (9, 0, "none", [1.0])], schema.format("query_id")).drop("corpus_idx")
    many = Limits(broadcast_queries=0)
    with pytest.raises(Exception, match="7"):
        dense.vector_topk(items, asked.filter("query_id = 0"), 2, within=True, limits=many).collect()
    with pytest.raises(Exception, match="9"):
        dense.vector_topk(items.filter("item_id = 1"), asked, 2, within=True, limits=many).collect()
