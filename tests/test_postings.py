"""Inverted postings with block maxima: same hits as the formula, blocks skipped."""

import random

from pyspark.sql import functions as F

from querent.operators import bm25, postings
from tests.test_bm25 import ask, found, make, model_topk

WORDS = [f"w{i}" for i in range(40)]


def corpus(seed, n=120):
    rng = random.Random(seed)
    docs = [" ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(1, 30))) for _ in range(n)]
    dbs = [rng.choice(["a", "b", "c", None]) for _ in range(n)]
    return docs, dbs


def test_equals_the_formula(spark):
    docs, dbs = corpus(1)
    rng = random.Random(2)
    queries = [(rng.choice(["a", "b", None]), " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))) for _ in range(12)]
    queries += [("a", "nothing known"), (None, "")]
    index = bm25.build_bm25_index(make(spark, docs, dbs))
    made = postings.build_postings(index)
    for within in (False, True):
        for k in (1, 3, 10):
            hits = postings.bm25_topk_pruned(index, made, ask(spark, queries), k, within=within)
            want = model_topk(docs, dbs, queries, k, within, fill=False)
            assert found(hits) == {q: h for q, h in want.items() if h}


def test_equals_the_scan_with_ties(spark):
    docs = ["x y", "y x", "x y", "x", "y", "z z z", "x y z"] * 5
    dbs = ["a"] * len(docs)
    queries = [("a", "x"), (None, "x y"), ("a", "z x")]
    index = bm25.build_bm25_index(make(spark, docs, dbs))
    made = postings.build_postings(index)
    asked = ask(spark, queries)
    for within in (False, True):
        plain = bm25.bm25_topk(index, asked, 4, within=within, fill=False)
        assert found(postings.bm25_topk_pruned(index, made, asked, 4, within=within)) == found(plain)


def test_blocks_are_skipped_and_other_words_not_read(spark):
    rng = random.Random(3)
    # a frequent word of low impact everywhere, a rare word of high impact in few documents
    many = [f"v{i}" for i in range(3000)]
    docs = [" ".join(["common"] + rng.choices(many, k=40)) for _ in range(300)]
    docs += ["rare rare rare common"] * 5
    index = bm25.build_bm25_index(make(spark, docs, ["a"] * len(docs)))
    made = postings.build_postings(index)
    asked = postings._asked(index, ask(spark, [("a", "rare common")]))
    read = postings._asked_rows(made, asked)
    chosen = postings.candidates(made, asked, 3, within=False, decimals=6)
    assert chosen.count() < read.count() / 10  # the common word's low blocks never name candidates
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "term_bucket" in plan  # other words' folders are not listed
    assert read.select(F.countDistinct("term")).first()[0] == 2


def test_empty_queries_and_corpus(spark):
    index = bm25.build_bm25_index(make(spark, ["a b"], ["x"]))
    made = postings.build_postings(index)
    assert postings.bm25_topk_pruned(index, made, ask(spark, []), 3).count() == 0


def test_filled_equals_the_formula(spark):
    docs, dbs = corpus(4, n=90)
    rng = random.Random(5)
    queries = [(rng.choice(["a", "b", "c", None]), " ".join(rng.choices(WORDS, k=rng.randint(1, 5)))) for _ in range(10)]
    queries += [("a", "nothing known"), (None, ""), ("zz", "w1")]
    index = bm25.build_bm25_index(make(spark, docs, dbs))
    made = postings.build_postings(index)
    for within in (False, True):
        for k in (1, 4, 30):
            hits = postings.bm25_topk_filled(index, made, ask(spark, queries), k, within=within)
            want = model_topk(docs, dbs, queries, k, within, fill=True)
            assert found(hits) == {q: h for q, h in want.items() if h}


def test_filled_with_negative_weights_takes_the_scan(spark):
    # every word in nearly every document: idf below zero, floored below zero
    docs = ["x y", "y x", "x y", "x", "y x", "x y"] * 4
    dbs = ["a", "b"] * 12
    queries = [("a", "x"), (None, "x y"), ("b", "q")]
    index = bm25.build_bm25_index(make(spark, docs, dbs))
    made = postings.build_postings(index)
    asked = ask(spark, queries)
    for within in (False, True):
        plain = bm25.bm25_topk(index, asked, 5, within=within, fill=True)
        assert found(postings.bm25_topk_filled(index, made, asked, 5, within=within)) == found(plain)
