"""Centroid clustering (k-means) whose assignment is pruned by Ptolemaic pivots.

Every vector keeps its Euclidean distances to a few fixed pivot vectors, computed
once and stored with it. Each round, the centroids' distances to the same pivots
are computed (k x pivots, on each task), and Ptolemy's inequality over every
pivot pair (p, q) bounds a vector's distance to a centroid from below:

    d(x, c) * d(p, q) >= | d(x, p) * d(c, q) - d(x, q) * d(c, p) |

A vector is first measured exactly against the centroid of least bound; every
other centroid whose bound, rounded down, still reaches that distance is
measured exactly as well, and the nearest wins (ties: the smaller centroid
number). Bounds only skip work: the assignment is the exact one.

A round is one pass over the stored vectors: tasks assign their rows and return
per centroid the count and the componentwise sums (k x (d + 1) rows a task); Spark
adds them by centroid, and the driver divides k x d whole numbers. Nothing that
grows with the rows passes through the driver or one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.session import stored

DIMS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Pivot vectors, all pairs of them are used: 4 give 6 pairs.
PIVOTS = 4
#: Whole numbers up to this size keep squared distances of 64 components exact in int64.
SAFE = 2**27
SUMS = "cluster int, pos int, total long"
FOUND = "id long, cluster int, distance long, checked int"


def kept_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(id, v)``: vectors of exactly ``dims`` components, each as floor(scale * x).

    A null id, a null vector, another length, or a null or non-finite component
    leaves the row out. Repeated rows (same id, same vector) count once; one id
    with two different vectors gives two vectors.
    """
    x = F.col(vec_col)
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (
        embeddings.filter(F.col(id_col).isNotNull() & (F.size(x) == dims) & usable)
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("v"),
        )
        .distinct()
    )


def _first_by_hash(vectors: DataFrame, salt: str, n: int) -> list[list[int]]:
    """The ``n`` vectors of smallest lowercase-hex sha256 of ``<salt>:<id>``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(n).collect()
    return [list(row["v"]) for row in rows]


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, exact whatever the size of the numbers."""
    if len(x) and max(np.abs(x).max(), np.abs(c).max()) >= SAFE:
        diff = x.astype(object) - c.astype(object)
        return (diff * diff).sum(axis=1)
    diff = x - c
    return np.einsum("ij,ij->i", diff, diff)


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(_exact(x, np.broadcast_to(p, x.shape)).astype(float))
    return out


def _assign(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray):
    """(cluster, squared distance, exact measurements) of every row of ``x``."""
    n, k = len(x), len(centroids)
    c_pivots = _pivot_distances(centroids, pivots)
    bound = np.zeros((n, k))
    for a in range(len(pivots)):
        for b in range(a + 1, len(pivots)):
            apart = float(np.sqrt(float(_exact(pivots[a : a + 1], pivots[b : b + 1])[0])))
            if apart == 0:
                continue
            ab = np.outer(to_pivots[:, a], c_pivots[:, b])
            ba = np.outer(to_pivots[:, b], c_pivots[:, a])
            # conservative rounding: the error of a difference is relative to its terms
            np.maximum(bound, (np.abs(ab - ba) - 1e-12 * (ab + ba)) / apart, out=bound)
    bound *= 1 - 1e-12
    first = np.argmin(bound, axis=1)
    rows = np.arange(n)
    best = _exact(x, centroids[first])
    need = bound <= np.sqrt(best.astype(float))[:, None] * (1 + 1e-12)
    need[rows, first] = False
    more_rows, more_cols = np.nonzero(need)
    all_rows = np.concatenate([rows, more_rows])
    all_cols = np.concatenate([first, more_cols])
    all_dist = np.concatenate([best, _exact(x[more_rows], centroids[more_cols])])
    order = np.lexsort((all_cols, all_dist, all_rows))
    starts = np.flatnonzero(np.r_[True, all_rows[order][1:] != all_rows[order][:-1]])
    chosen = order[starts]
    return all_cols[chosen], all_dist[chosen], 1 + need.sum(axis=1)


def _batch(batch: pa.RecordBatch, dims: int):
    ids = batch.column("id").to_numpy()
    x = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(len(ids), dims)
    to_pivots = batch.column("pd").flatten().to_numpy().reshape(len(ids), -1)
    return ids, x, to_pivots


def _with_pivots(pivots: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, pivots.shape[1])
            pd = _pivot_distances(x, pivots)
            offsets = pa.array(np.arange(0, pd.size + 1, max(len(pivots), 1), dtype=np.int32)[: batch.num_rows + 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(pd.ravel()))],
                names=["id", "v", "pd"],
            )

    return add


def _round(centroids: np.ndarray, pivots: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        counts = np.zeros(k, np.int64)
        totals = np.zeros((k, dims), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            _, x, to_pivots = _batch(batch, dims)
            cluster, _, _ = _assign(x, to_pivots, centroids, pivots)
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                totals[c] += x[cluster == c].astype(object).sum(axis=0)
        live = np.flatnonzero(counts)
        cluster = np.repeat(live, dims + 1).astype(np.int32)
        pos = np.tile(np.arange(-1, dims, dtype=np.int32), len(live))
        total = [int(v) for c in live for v in (counts[c], *totals[c])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(pos, pa.int32()), pa.array(total, pa.int64())],
            names=["cluster", "pos", "total"],
        )

    return sums


def _final(centroids: np.ndarray, pivots: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, to_pivots = _batch(batch, centroids.shape[1])
            cluster, distance, checked = _assign(x, to_pivots, centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(cluster.astype(np.int32), pa.int32()),
                    pa.array([int(d) for d in distance], pa.int64()),
                    pa.array(checked.astype(np.int32), pa.int32()),
                ],
                names=["id", "cluster", "distance", "checked"],
            )

    return assign


def kmeans(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, list[list[int]]]:
    """Assignments ``(id, cluster, distance, checked)`` and the final centroids.

    ``vectors`` is ``(id long, v array<long>)`` of one length, as ``kept_vectors``
    gives. Centroids 0, 1, ... start as the ``k`` vectors of smallest sha256 of
    ``1:<id>`` (all vectors if fewer); each round assigns every vector to the
    nearest centroid by squared Euclidean distance (ties: smaller number) and
    replaces each non-empty centroid by the componentwise floor of its vectors'
    mean; empty ones stay. Then every vector is assigned once more. ``checked``
    counts the centroids measured exactly for the last assignment (k without
    pruning). An empty table gives no rows and no centroids.
    """
    spark = vectors.sparkSession
    start = _first_by_hash(vectors, "1", k)
    if not start:
        return spark.createDataFrame([], FOUND), []
    dims = len(start[0])
    pivot_rows = np.array(_first_by_hash(vectors, "pivot", pivots), dtype=np.int64)
    pivot_rows = np.unique(pivot_rows, axis=0) if len(pivot_rows) else pivot_rows.reshape(0, dims)
    cached = stored(
        vectors.select("id", "v").mapInArrow(_with_pivots(pivot_rows), "id long, v array<long>, pd array<double>"),
        "kmeans-vectors",
    )
    centroids = np.array(start, dtype=np.int64)
    for _ in range(rounds):
        added = cached.mapInArrow(_round(centroids, pivot_rows), SUMS).groupBy("cluster", "pos").agg(
            F.sum("total").alias("total")
        )
        totals: dict[int, dict[int, int]] = {}
        for row in added.collect():  # at most k x (dims + 1) rows
            totals.setdefault(row["cluster"], {})[row["pos"]] = int(row["total"])
        moved = [list(map(int, c)) for c in centroids]
        for c, by_pos in totals.items():
            n = by_pos[-1]
            moved[c] = [by_pos[p] // n for p in range(dims)]
        centroids = np.array(moved, dtype=np.int64)
    return cached.mapInArrow(_final(centroids, pivot_rows), FOUND), [list(map(int, c)) for c in centroids]


def cluster_report(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, checked)``.

    ``centroid_sha256`` is the lowercase-hex sha256 of the final centroid's
    components written as decimal integers joined by ``,``. The per-centroid
    table has at most ``k`` rows, so joining it back is bounded.
    """
    spark = vectors.sparkSession
    found, centroids = kmeans(vectors, k, rounds)
    table = spark.createDataFrame(
        [(c, centroid) for c, centroid in enumerate(centroids)], "cluster int, centroid array<long>"
    )
    by_cluster = (
        found.groupBy("cluster")
        .agg(F.sum("distance").alias("cluster_inertia"))
        .join(table, "cluster", "right")
        .select(
            "cluster",
            F.coalesce("cluster_inertia", F.lit(0)).cast("long").alias("cluster_inertia"),
            F.sha2(F.array_join(F.transform("centroid", lambda e: e.cast("string")), ","), 256).alias(
                "centroid_sha256"
            ),
        )
    )
    by_cluster = by_cluster.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()).cast("long"))
    return found.join(F.broadcast(by_cluster), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "checked"
    )
