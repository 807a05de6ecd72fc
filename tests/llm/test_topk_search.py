import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.llm import topk_search


def brute(vectors, k, asked):
    known = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            known[i] = [math.floor(64 * x) for x in v]
    out = []
    for q in (i for i in known if asked(i)):
        scores = [(-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q and len(v) == len(known[q])]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, vectors, k, asked="id % 3 = 0"):
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    items = topk_search.quantised(table, "vec_id", "embedding")
    return sorted(map(tuple, topk_search.exact_topk(items, items.filter(asked), k).select("query_id", "rank", "vec_id", "score").collect()))


def vectors(n, dims, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = centres[rng.integers(5, size=n)] + 0.2 * rng.normal(size=(n, dims))
    return [(i, [float(np.float32(x)) for x in spread * row]) for i, row in enumerate(rows)]


@pytest.mark.parametrize("dims,k", [(1, 3), (16, 5), (20, 50)])
def test_equals_brute_force(spark, dims, k):
    rows = vectors(300, dims)
    assert found(spark, rows, k) == brute(rows, k, lambda i: i % 3 == 0)


def test_ties_copies_and_unusable_rows(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 1)) for _ in range(4)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 0.0, 1.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (204, []), (None, [1.0] * 4), (6, rows[6][1])]
    rows += [(300, [1.0, 2.0]), (303, [2.0, 1.0]), (306, [7.0])]
    assert found(spark, rows, 7) == brute(rows, 7, lambda i: i % 3 == 0)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 16)
    rows = vectors(260, 24, seed=4)
    assert found(spark, rows, 9) == brute(rows, 9, lambda i: i % 3 == 0)


def test_large_components(spark):
    rows = vectors(40, 6, seed=3, spread=1e6)
    assert found(spark, rows, 4) == brute(rows, 4, lambda i: i % 3 == 0)


def test_blocks_prune(spark):
    """Far candidates are compacted away before the last dimensions."""
    rows = np.array([v for _, v in vectors(2000, 64, seed=8)])
    q, c = np.floor(64 * rows[:50]), np.floor(64 * rows)
    best = topk_search._Best(50, 5)
    for start in range(0, 2000, 500):
        topk_search._search_block(np.arange(50), q, best, np.arange(start, start + 500), np.ascontiguousarray(c[start : start + 500].T))
    wanted = q @ c.T
    wanted[np.arange(50), np.arange(50)] = -np.inf
    assert np.array_equal(np.sort(best.kth), np.sort(np.sort(wanted, axis=1)[:, -5]))


def test_empty(spark):
    assert found(spark, [], 5) == []
    assert found(spark, vectors(30, 4), 5, asked="id < 0") == []
