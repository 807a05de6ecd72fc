"""op13: hard negatives by segment bounds against a brute-force search."""

import math
import random

import numpy as np

from querent.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id string, h string, score string"


def brute(rows):
    kept = {}
    for vec_id, vec, label, *_ in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        lab = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept[(vec_id, lab, tuple(math.floor(256 * x) for x in vec))] = None
    rows = list(kept)
    out = []
    for a_id, a_lab, a in rows:
        if a_id % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), i, lab) for i, lab, v in rows if i != a_id and len(v) == len(a)]
        scored.sort()
        positives = [(i, -s) for s, i, lab in scored if lab == a_lab][:5]
        for p_id, ps in positives:
            negs = [(i, -s) for s, i, lab in scored if lab != a_lab and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a_id, p_id, r + 1, n_id, ps, ns) for r, (n_id, ns) in enumerate(negs)]
    return sorted(out)


def made(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, H.mine_hard_negatives(H.mined_rows(df)).collect()))


def table(n, seed, dims=64, labels=4):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, [x + rng.gauss(0, 0.3) for x in middle[i % labels]], i % labels, "a", "b", "c") for i in range(n)]


def test_equals_brute_force_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(H, "CANDIDATE_BLOCK", 50)
    rows = table(400, 1)
    got = made(spark, rows)
    assert got and got == brute(rows)


def test_bounds_skip_exact_scores():
    """Where segments are level (small deviation), bounds decide most pairs."""
    rng = np.random.default_rng(2)
    level = lambda n: np.repeat(rng.integers(-200, 200, (n, 16)), 4, axis=1)
    q = level(40) + rng.integers(-8, 8, (40, 64))
    c = level(900) + rng.integers(-8, 8, (900, 64))
    allowed = np.ones((40, 900), bool)

    def keep(lower, upper, live):
        return upper >= H._kth_largest(lower, live, 5)[:, None]

    i, j, score = H._survivors(q, c, allowed, keep)
    assert len(i) < allowed.size / 4
    exact = q @ c.T
    for r in range(40):
        want = sorted(range(900), key=lambda x: (-exact[r, x], x))[:5]
        mine = [b for a, b in zip(i, j) if a == r]
        assert set(want) <= set(mine)


def test_odd_rows(spark):
    rng = random.Random(4)
    v = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    same = v()
    rows = [
        (0, v(), 1, "x", "y", "z"), (50, v(), None, "x", "y", "z"), (100, None, 2, "x", "y", "z"),
        (150, [None] + v()[1:], 3, "x", "y", "z"), (200, [float("nan")] + v()[1:], 3, "x", "y", "z"),
        (250, same, 1, "x", "y", "z"), (250, same, 1, "x", "y", "z"), (None, v(), 1, "x", "y", "z"),
        (7, v(), 0, "x", "y", "z"), (14, v(), 0, "x", "y", "z"), (300, [0.0] * 8, 1, "x", "y", "z"),
        (350, v()[:4], 1, "x", "y", "z"),
    ] + [(1000 + i, v(), i % 3, "x", "y", "z") for i in range(60)] + [(2000 + i, same, 1, "x", "y", "z") for i in range(6)]
    got = made(spark, rows)
    assert got == brute(rows)


def test_rows_of_one_id(spark):
    """One id with two labels or two vectors: anchors and positives of their own."""
    rng = random.Random(6)
    v = lambda: [rng.uniform(0, 1) for _ in range(8)]
    rows = [(i, v(), i % 3, "x", "y", "z") for i in range(1, 80) if i % 50]
    rows += [(i, v(), lab, "x", "y", "z") for i, *_ in rows[:30] for lab in (0, 1)]
    anchor, other = v(), v()
    rows += [(50, anchor, 0, "x", "y", "z"), (50, anchor, 1, "x", "y", "z"), (50, other, 1, "x", "y", "z")]
    got = made(spark, rows)
    assert got and got == brute(rows)


def test_scores_beyond_exact_doubles(spark):
    """Scores that differ only below the precision of a double keep their order."""
    rows = [(0, [2.0**18, 1 / 256], 0, "x", "y", "z")]
    rows += [(i, [2.0**22, i / 256], 1, "x", "y", "z") for i in range(1, 7)]
    rows += [(i, [3 * 2.0**20, (i % 10) / 256], 2, "x", "y", "z") for i in range(101, 109) if i % 7]
    got = made(spark, rows)
    assert got and got == brute(rows)


def test_empty_table(spark):
    assert made(spark, []) == []


def test_whole_number_path(spark, monkeypatch):
    monkeypatch.setattr(H, "EXACT", 1.0)
    rows = table(150, 5, dims=16)
    assert made(spark, rows) == brute(rows)
