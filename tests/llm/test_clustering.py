"""op11: k-means with Ptolemaic pivot bounds against a plain k-means."""

import hashlib
import math
import random

import numpy as np

from querent.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cluster string"


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    kept = {}
    for vec_id, vec, *_ in rows:
        if vec_id is None or vec is None or len(vec) != dims:
            continue
        if any(x is None or not math.isfinite(x) for x in vec):
            continue
        v = tuple(math.floor(scale * float(np.float32(x))) for x in vec)
        kept[(vec_id, v)] = None
    vectors = list(kept)
    start = sorted(vectors, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in start]

    def assign():
        out = []
        for vec_id, v in vectors:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            best = min(range(len(centroids)), key=lambda c: (d[c], c))
            out.append((vec_id, v, best, d[best]))
        return out

    for _ in range(rounds):
        groups = {}
        for _, v, c, _ in assign():
            groups.setdefault(c, []).append(v)
        for c, members in groups.items():
            centroids[c] = [sum(col) // len(members) for col in zip(*members)]
    final = assign()
    inertia = {}
    for _, _, c, d in final:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, _, c, d in final)


def made(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = clustering.cluster_report(clustering.kept_vectors(df))
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(tuple(r) for r in out.select(cols).collect()), out


def clustered(n, seed, centres=5):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(centres)]
    out = []
    for i in range(n):
        m = middle[i % centres]
        out.append((i, [x + rng.gauss(0, 0.05) for x in m], i % 10, "x", "y"))
    return out


def test_equals_plain_kmeans_and_prunes(spark):
    rows = clustered(600, 1)
    got, out = made(spark, rows)
    assert got == brute(rows)
    checked = [r["checked"] for r in out.select("checked").collect()]
    assert sum(checked) / len(checked) < 16  # bounds skip exact distances on clustered data


def test_odd_rows(spark):
    rng = random.Random(3)
    v = lambda: [rng.uniform(-1, 1) for _ in range(64)]
    same = v()
    rows = [
        (1, None, 1, "a", "b"), (2, [0.1] * 63, 1, "a", "b"), (3, [None] + [0.0] * 63, 1, "a", "b"),
        (4, [float("nan")] + [0.0] * 63, 1, "a", "b"), (5, [float("inf")] + [0.0] * 63, 1, "a", "b"),
        (None, v(), 1, "a", "b"), (6, same, None, None, None), (6, same, None, None, None),
        (7, same, 2, "c", "d"), (8, [0.0] * 64, 3, "e", "f"), (9, [0.0] * 64, 3, "e", "f"),
    ] + [(10 + i, v(), i, "g", "h") for i in range(20)]
    got, _ = made(spark, rows)
    assert got == brute(rows)
    assert {r[0] for r in got} == {6, 7, 8, 9} | set(range(10, 30))


def test_fewer_vectors_than_centroids_and_empty(spark):
    rows = clustered(5, 2)
    got, _ = made(spark, rows)
    assert got == brute(rows) and all(r[2] == 0 for r in got)
    empty, _ = made(spark, [])
    assert empty == []


def test_whole_number_path_equals_int64_path(spark, monkeypatch):
    """Past ``SAFE`` distances are summed as Python integers; results agree."""
    rows = clustered(200, 5)
    monkeypatch.setattr(clustering, "SAFE", 16)
    got, _ = made(spark, rows)
    assert got == brute(rows)
