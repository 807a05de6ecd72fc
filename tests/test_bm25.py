import math
import random
import re
from collections import Counter

import pytest

from querent.operators import bm25
from querent.operators.topk import Limits

GRID = Limits(broadcast_queries=0, cell_queries=3, cell_bytes=300)


def model_scores(docs, words):
    """Okapi scores of all documents for one query, straight from the formula."""
    tokens = [d.lower().split() for d in docs]
    n, avgdl = len(docs), sum(map(len, tokens)) / len(docs)
    df = Counter(word for t in tokens for word in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}

    def score(t):
        tf = Counter(t)
        return sum(
            idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
            for w in words.lower().split()
        )

    return [score(t) for t in tokens], [bool(set(t) & set(words.lower().split())) for t in tokens]


def model_topk(docs, dbs, queries, k, within, fill):
    hits = {}
    for q, (db, words) in enumerate(queries):
        scores, matched = model_scores(docs, words)
        pool = [
            i for i in range(len(docs))
            if (not within or not db or dbs[i] == db) and (fill or matched[i])
        ]
        pool.sort(key=lambda i: (-round(scores[i], 6), i))
        hits[q] = [(i, round(scores[i], 6)) for i in pool[:k]]
    return hits


def found(hits):
    rows = {}
    for r in hits.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.item_id, round(r.score, 6)))
    return rows


def make(spark, docs, dbs):
    rows = [(i, i, db, text) for i, (db, text) in enumerate(zip(dbs, docs))]
    return spark.createDataFrame(rows, "item_id long, corpus_idx long, db_id string, text string")


def ask(spark, queries):
    rows = [(q, db, words) for q, (db, words) in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id long, db_id string, text string")


@pytest.fixture(scope="module")
def random_case(spark):
    rng = random.Random(7)
    words = ["the", "of", *"abcdefghijklmnop"]
    weights = [30, 20, *range(16, 0, -1)]
    docs = [" ".join(rng.choices(words, weights, k=rng.randint(0, 12))) for _ in range(120)]
    docs += docs[:20] + ["the of the"] * 15
    # One database holds most of the items.
    dbs = [rng.choice(["hot", "hot", "hot", "x", "y"]) for _ in docs]
    queries = [(rng.choice(["hot", "x", "y", "none"]), " ".join(rng.choices(words, k=4))) for _ in range(8)]
    queries += [("hot", "the the of"), ("x", ""), ("y", "unknown words"), (None, "a b"), ("", "c")]
    return docs, dbs, queries, bm25.build_bm25_index(make(spark, docs, dbs))


@pytest.mark.parametrize("limits", [Limits(), GRID], ids=["broadcast", "grid"])
@pytest.mark.parametrize("within", [False, True])
@pytest.mark.parametrize("fill", [False, True])
def test_agrees_with_the_formula(spark, random_case, within, fill, limits):
    docs, dbs, queries, index = random_case
    hits = bm25.bm25_topk(index, ask(spark, queries), 7, within=within, fill=fill, limits=limits)
    wanted = model_topk(docs, dbs, queries, 7, within, fill)
    assert found(hits) == {q: rows for q, rows in wanted.items() if rows}


def test_filled_results_have_min_k_candidates(spark, random_case):
    docs, dbs, _, index = random_case
    asked = ask(spark, [("y", "unknown"), ("x", "")])
    hits = found(bm25.bm25_topk(index, asked, 500, within=True))
    assert [len(hits[0]), len(hits[1])] == [dbs.count("y"), dbs.count("x")]
    assert all(score == 0 for _, score in hits[0])


def test_post_filter_takes_k_before_the_database(spark, random_case):
    docs, dbs, queries, index = random_case
    hits = found(bm25.bm25_topk(index, ask(spark, queries), 2, within=True, mode="post"))
    anywhere = model_topk(docs, dbs, queries, 10, False, True)
    for q, (db, _) in enumerate(queries):
        own = [hit for hit in anywhere[q] if not db or dbs[hit[0]] == db][:2]
        assert hits.get(q, []) == own


def test_same_result_for_other_partitions_and_order(spark, random_case):
    docs, dbs, queries, index = random_case
    asked = ask(spark, queries)
    wanted = found(bm25.bm25_topk(index, asked, 5, within=True))
    shuffled = make(spark, docs, dbs).repartition(5).orderBy("text")
    other = bm25.build_bm25_index(shuffled.coalesce(1))
    assert found(bm25.bm25_topk(other, asked.repartition(3), 5, within=True)) == wanted


def test_negative_floor_ranks_matches_below_fillers(spark):
    docs, dbs = ["a", "a", "a", "a b"], ["d"] * 4
    index = bm25.build_bm25_index(make(spark, docs, dbs))
    queries = [("d", "a"), ("d", "b")]
    assert index.stats.first().avg_idf < 0
    hits = found(bm25.bm25_topk(index, ask(spark, queries), 3, within=True))
    assert hits == model_topk(docs, dbs, queries, 3, True, True)


def test_index_tables(spark, tmp_path):
    corpus = make(spark, ["a a b", "b", ""], ["x", "x", "y"])
    bm25.write_bm25_index(corpus, str(tmp_path / "i"))
    index = bm25.read_bm25_index(spark, str(tmp_path / "i"))
    stats = index.stats.first()
    assert (stats.n_docs, stats.n_tokens, stats.n_terms) == (3, 4, 2)
    assert {r.term: r.df for r in index.terms.collect()} == {"a": 1, "b": 2}
    counts = {(r.item_id, r.term): r.tf for r in bm25.postings(index).collect()}
    assert counts == {(0, "a"): 2, (0, "b"): 1, (1, "b"): 1}
    assert {(r.item_id, r.term): r.tf for r in bm25.token_counts(corpus).collect()} == counts
    with pytest.raises(FileNotFoundError):
        bm25.read_bm25_index(spark, str(tmp_path / "none"))


def test_text_ids_and_empty_corpus(spark):
    items = spark.createDataFrame(
        [("i0", 0, "d", "a b"), ("i1", 1, "d", "a")],
        "item_id string, corpus_idx long, db_id string, text string",
    )
    asked = spark.createDataFrame([("q", "d", "b")], "query_id string, db_id string, text string")
    hits = bm25.bm25_topk(bm25.build_bm25_index(items), asked, 5).collect()
    assert [r.item_id for r in hits] == ["i0", "i1"]
    none = bm25.build_bm25_index(items.limit(0))
    assert bm25.bm25_topk(none, asked, 5).count() == 0
    assert bm25.bm25_topk(bm25.build_bm25_index(items), asked.limit(0), 5).count() == 0


def test_search_within_databases_skips_the_others(spark):
    docs = [f"word{i} common" for i in range(40)]
    index = bm25.build_bm25_index(make(spark, docs, [f"db{i % 4}" for i in range(40)]))
    for fill in (True, False):
        hits = bm25.bm25_topk(index, ask(spark, [("db1", "common word1")]), 3, within=True, fill=fill)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*db_id#", plan), plan
        assert {r.item_db_id for r in hits.collect()} == {"db1"}
    with pytest.raises(ValueError):
        bm25.bm25_topk(index, ask(spark, [("db1", "common")]), 3, within=True, mode="posst")


def test_the_last_published_index_is_read(spark, tmp_path):
    path = str(tmp_path / "index")
    bm25.build_bm25_index(make(spark, ["a b"], ["x"]), path)
    again = bm25.build_bm25_index(make(spark, ["a b", "c"], ["x", None]), path)
    assert again.stats.first().n_docs == 2 and bm25.read_bm25_index(spark, path).docs.count() == 2


def test_grid_cells_follow_databases(spark):
    from querent.operators.topk import QuerySize, plan_database_cells

    rows = [(i, i, "big" if i < 90 else f"s{i % 3}", "x") for i in range(100)]
    items = spark.createDataFrame(rows, "item_id long, corpus_idx long, db_id string, text string")
    queries = spark.createDataFrame([(0, "big"), (1, "s0"), (2, "big")], "query_id long, db_id string")
    plan = {r.db_id: (r.q_cells, r.i_cells) for r in plan_database_cells(items, queries, QuerySize(3, 300), 100_000, Limits(cell_bytes=10_000)).collect()}
    assert plan == {"big": (1, 9), "s0": (1, 1)}  # the big database is split, s1 and s2 nobody asks for
