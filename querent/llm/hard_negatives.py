"""Hard-negative mining with segment summary filtering.

Each vector is cut into segments; per segment its mean and (population)
standard deviation are kept. For two vectors a and b and a segment of length L,

    sum a_i b_i = L * mean_a * mean_b + sum (a_i - mean_a) (b_i - mean_b)

and the last sum lies within +- L * sd_a * sd_b (Cauchy-Schwarz), so the means'
product plus or minus the deviations' product bounds every segment and their sum
bounds the score. Bounds of 4 segments are two small matrix products for a whole
block of pairs; pairs that survive are bounded again with 16 segments, and only
what survives that is scored exactly. Nothing is approximate: a pair is dropped
only when its bounds prove it cannot be among the results.

Anchors are a stated query set (every row whose id is divisible by
``ANCHOR_EVERY``). They meet all rows in a grid of blocks: anchors are dealt into
blocks of at most about ``ANCHOR_BLOCK`` rows and rows into blocks of about
``CANDIDATE_BLOCK``; every anchor block meets every row block in one task group of
a cogroup, so what a task holds is bounded by the two block sizes, whatever the
labels' sizes. Each group returns at most k rows per anchor (or per anchor and
positive); Spark ranks them globally. Two passes: positives, then negatives
within the windows their positives' scores set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.session import stored

SCALE = 256
RELABEL_EVERY = 7
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies within LOW% and HIGH% of its positive's score.
LOW, HIGH = 50, 95
LEVELS = (4, 16)
ANCHOR_BLOCK = 256
CANDIDATE_BLOCK = 2048
#: Scores below this size are exact in doubles.
EXACT = 2.0**52

POSITIVE = "anchor_id long, anchor_key long, vec_id long, vec_key long, score long"
NEGATIVE = "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long, vec_id long, score long"


def mined_rows(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, v)``: usable rows, relabelled and quantised; repeated rows once.

    A null id, label or vector, or a null or non-finite component leaves the row
    out. Where the id is divisible by ``RELABEL_EVERY`` the label becomes
    (label + 1) % 10. Components become floor(SCALE * x), x as double. Rows of one
    id that differ in label or vector are rows of their own.
    """
    x = F.col(vec_col)
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ident = F.col(id_col).cast("long")
    label = F.col(label_col).cast("long")
    return (
        embeddings.filter(ident.isNotNull() & label.isNotNull() & x.isNotNull() & usable)
        .select(
            ident.alias("id"),
            F.when(ident % RELABEL_EVERY == 0, (label + 1) % 10).otherwise(label).alias("label"),
            F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")).cast("long")).alias("v"),
        )
        .distinct()
    )


def _matrix(table: pa.Table) -> np.ndarray:
    n = table.num_rows
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0).astype(np.int64)


def _summaries(x: np.ndarray, segments: int):
    """Per segment: lengths, means, standard deviations (rows x segments)."""
    parts = [p for p in np.array_split(np.arange(x.shape[1]), min(segments, max(x.shape[1], 1))) if len(p)]
    lengths = np.array([len(p) for p in parts], float)
    xf = x.astype(float)
    means = np.stack([xf[:, p].mean(axis=1) for p in parts], axis=1) if parts else np.zeros((len(x), 0))
    sds = np.stack([xf[:, p].std(axis=1) for p in parts], axis=1) if parts else np.zeros((len(x), 0))
    return lengths, means, sds


def _bounds_block(q: np.ndarray, c: np.ndarray, segments: int):
    """(lower, upper) bounds of all anchor x row scores from segment summaries."""
    lengths, qm, qs = _summaries(q, segments)
    _, cm, cs = _summaries(c, segments)
    centre = (qm * lengths) @ cm.T
    radius = (qs * lengths) @ cs.T
    slack = 1e-9 * (((np.abs(qm) + qs) * lengths) @ (np.abs(cm) + cs).T) + 1e-6
    return centre - radius - slack, centre + radius + slack


def _bounds_pairs(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, segments: int):
    """Bounds of the pairs (i, j) only."""
    lengths, qm, qs = _summaries(q, segments)
    _, cm, cs = _summaries(c, segments)
    centre = np.einsum("ij,ij->i", qm[i] * lengths, cm[j])
    radius = np.einsum("ij,ij->i", qs[i] * lengths, cs[j])
    slack = 1e-9 * np.einsum("ij,ij->i", (np.abs(qm[i]) + qs[i]) * lengths, np.abs(cm[j]) + cs[j]) + 1e-6
    return centre - radius - slack, centre + radius + slack


def _exact(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer scores of the pairs (i, j), whatever the size of the numbers."""
    big = len(i) and q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) >= EXACT
    if big:
        return np.array([int(np.dot(q[a].astype(object), c[b].astype(object))) for a, b in zip(i, j)], dtype=object)
    return np.einsum("ij,ij->i", q[i].astype(float), c[j].astype(float)).round().astype(np.int64)


def _kth_largest(values: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Per row, the k-th largest allowed value; -inf where fewer than k are allowed."""
    masked = np.where(allowed, values, -np.inf)
    if masked.shape[1] < k:
        return np.full(len(masked), -np.inf)
    return -np.partition(-masked, k - 1, axis=1)[:, k - 1]


def _survivors(q, c, allowed, keep):
    """Refine bounds level by level; ``keep(lower, upper, live)`` says which pairs stay.

    Returns the surviving pairs (i, j) and their exact scores.
    """
    lower, upper = _bounds_block(q, c, LEVELS[0])
    alive = allowed & keep(lower, upper, allowed)
    i, j = np.nonzero(alive)
    for segments in LEVELS[1:]:
        lo, up = _bounds_pairs(q, c, i, j, segments)
        lower_m = np.full(alive.shape, -np.inf)
        upper_m = np.full(alive.shape, np.inf)
        lower_m[i, j], upper_m[i, j] = lo, up
        alive = alive & keep(lower_m, upper_m, alive)
        i, j = np.nonzero(alive)
    return i, j, _exact(q, c, i, j)


def _top(owner: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best per owner: higher score, then smaller id. Scores are compared as whole numbers."""
    if not len(owner):
        return np.zeros(0, int)
    order = np.lexsort((ident, -np.unique(score, return_inverse=True)[1], owner))
    owner_sorted = owner[order]
    starts = np.flatnonzero(np.r_[True, owner_sorted[1:] != owner_sorted[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("anchor_id", "anchor_key", "vec_id", "vec_key", "score")})
    if not anchors.num_rows or not rows.num_rows:
        return empty
    q, c = _matrix(anchors), _matrix(rows)
    a_id, c_id = anchors.column("id").to_numpy(), rows.column("id").to_numpy()
    allowed = (anchors.column("label").to_numpy()[:, None] == rows.column("label").to_numpy()[None, :]) & (
        a_id[:, None] != c_id[None, :]
    )

    def keep(lower, upper, live):
        return upper >= _kth_largest(lower, live, POSITIVES)[:, None]

    i, j, score = _survivors(q, c, allowed, keep)
    chosen = _top(i, score, c_id[j], POSITIVES)
    i, j = i[chosen], j[chosen]
    return pa.table(
        {
            "anchor_id": pa.array(a_id[i], pa.int64()),
            "anchor_key": pa.array(anchors.column("key").to_numpy()[i], pa.int64()),
            "vec_id": pa.array(c_id[j], pa.int64()),
            "vec_key": pa.array(rows.column("key").to_numpy()[j], pa.int64()),
            "score": pa.array([int(s) for s in score[chosen]], pa.int64()),
        }
    )


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    names = ("anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score", "vec_id", "score")
    if not anchors.num_rows or not rows.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    q, c = _matrix(anchors), _matrix(rows)
    a_id, c_id = anchors.column("id").to_numpy(), rows.column("id").to_numpy()
    allowed = anchors.column("label").to_numpy()[:, None] != rows.column("label").to_numpy()[None, :]
    # positives: up to POSITIVES a row, as (id, score) lists padded with nan
    pos_ids = anchors.column("pos_ids").to_pylist()
    pos_keys = anchors.column("pos_keys").to_pylist()
    pos_scores = anchors.column("pos_scores").to_pylist()
    ps = np.full((len(q), POSITIVES), np.nan)
    for r, scores in enumerate(pos_scores):
        ps[r, : len(scores)] = scores
    lows, highs = ps * LOW / 100, ps * HIGH / 100

    def keep(lower, upper, live):
        needed = np.zeros(live.shape, bool)
        for p in range(POSITIVES):
            lo, hi = lows[:, p, None], highs[:, p, None]
            maybe = live & (upper >= lo - 1e-6) & (lower <= hi + 1e-6)
            surely = live & (lower >= lo + 1e-6) & (upper <= hi - 1e-6)
            floor = _kth_largest(lower, surely, NEGATIVES)[:, None]
            needed |= maybe & (upper >= floor)
        return needed

    i, j, score = _survivors(q, c, allowed, keep)
    out = {n: [] for n in names}
    for p in range(POSITIVES):
        has = ~np.isnan(ps[i, p])
        sel = np.flatnonzero(has)
        if not len(sel):
            continue
        positive = np.array([int(pos_scores[i[s]][p]) for s in sel], dtype=object)
        negative = np.asarray(score[sel], dtype=object)
        inside = (LOW * positive <= 100 * negative) & (100 * negative <= HIGH * positive)
        sel = sel[inside.astype(bool)]
        chosen = sel[_top(i[sel], score[sel], c_id[j[sel]], NEGATIVES)]
        out["anchor_id"] += a_id[i[chosen]].tolist()
        out["anchor_key"] += anchors.column("key").to_numpy()[i[chosen]].tolist()
        out["positive_id"] += [pos_ids[i[s]][p] for s in chosen]
        out["positive_key"] += [pos_keys[i[s]][p] for s in chosen]
        out["positive_score"] += [int(pos_scores[i[s]][p]) for s in chosen]
        out["vec_id"] += c_id[j[chosen]].tolist()
        out["score"] += [int(score[s]) for s in chosen]
    return pa.table({n: pa.array(out[n], pa.int64()) for n in names})


def _grid(rows: DataFrame, anchors: DataFrame):
    """Anchors and rows keyed by (dims, anchor block, row block); every pair of blocks meets once."""
    sizes = (
        rows.withColumn("dims", F.size("v"))
        .groupBy("dims")
        .agg(F.count("*").alias("n"), F.count_if(F.col("id") % ANCHOR_EVERY == 0).alias("anchors"))
        .collect()
    )  # one row a vector length
    if not sizes:
        return None
    q_blocks = F.create_map(*[F.lit(x) for r in sizes for x in (r["dims"], max(1, -(-r["anchors"] // ANCHOR_BLOCK)))])
    c_blocks = F.create_map(*[F.lit(x) for r in sizes for x in (r["dims"], max(1, -(-r["n"] // CANDIDATE_BLOCK)))])
    dims = F.size("v")
    dealt_anchors = anchors.withColumn("dims", dims).select(
        "*",
        F.pmod(F.xxhash64("key"), q_blocks[dims]).alias("qb"),
        F.explode(F.sequence(F.lit(0), c_blocks[dims] - 1)).alias("cb"),
    )
    dealt_rows = rows.withColumn("dims", dims).select(
        "*",
        F.explode(F.sequence(F.lit(0), q_blocks[dims] - 1)).alias("qb"),
        F.pmod(F.xxhash64("key"), c_blocks[dims]).alias("cb"),
    )
    return dealt_anchors, dealt_rows


def mine_hard_negatives(rows: DataFrame) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` is ``mined_rows``'s output. Anchors: rows whose id is divisible by
    ``ANCHOR_EVERY``. Scores are integer inner products with the anchor, only
    between vectors of one length; higher first, ties by smaller id. Positives:
    the first ``POSITIVES`` rows of the anchor's label other than itself (a row of
    another id); two rows of one id are two anchors, or two positives, each with
    results of its own. Negatives of a positive: the first ``NEGATIVES`` rows of another
    label with LOW * positive <= 100 * negative <= HIGH * positive; ``rank`` counts
    them from 1. An anchor without positives, or a positive with a negative score,
    has no negatives; an empty table gives no rows.
    """
    spark = rows.sparkSession
    # a number for every row: an id may come with several labels or vectors
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "negatives-rows")
    # fresh columns: anchors and rows meet in a cogroup, which refuses a self-join
    anchors = rows.filter(F.col("id") % ANCHOR_EVERY == 0).toDF(*rows.columns)
    grid = _grid(rows, anchors)
    if grid is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dealt_anchors, dealt_rows = grid
    keys = ["dims", "qb", "cb"]
    cols = ["id", "key", "label", "v"]
    found = (
        dealt_anchors.select(*keys, *cols)
        .groupBy(*keys)
        .cogroup(dealt_rows.select(*keys, *cols).groupBy(*keys))
        .applyInArrow(_positives, POSITIVE)
    )
    best = Window.partitionBy("anchor_key").orderBy(F.col("score").desc(), "vec_id", "vec_key")
    positives = stored(
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= POSITIVES), "negatives-positives"
    )
    listed = positives.groupBy(F.col("anchor_key").alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "vec_key", "score"))).alias("p")
    )
    with_positives = dealt_anchors.join(listed, "key").select(
        *keys, *cols, F.col("p.vec_id").alias("pos_ids"), F.col("p.vec_key").alias("pos_keys"), F.col("p.score").alias("pos_scores")
    )
    mined = (
        with_positives.groupBy(*keys)
        .cogroup(dealt_rows.select(*keys, *cols).groupBy(*keys))
        .applyInArrow(_negatives, NEGATIVE)
    )
    order = Window.partitionBy("anchor_key", "positive_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
