"""Quality classification by co-training.

Two views of a document, each with its own classifier: what the text says
(hashed words and word endings) and what page metadata says (language, source,
length, layout). On a pool of unlabelled documents each view hands its most
confident labels to the other over several rounds. Both are calibrated on
labelled documents neither was fitted on, and combined to score every document.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import fold, shared_object

#: Labelled rows the views are fitted and calibrated on, and unlabelled rows of the pool.
FIT_ROWS, POOL_ROWS = 12_000, 12_000
TEXT_DIMS = 256
SOURCE_DIMS, LANG_DIMS = 32, 8
ROUNDS = 5
#: Share of the pool each view labels in a round, and how sure it must be.
GIVE, SURE = 0.05, 0.9
THRESHOLD = 0.5


def text_view(text: str | None) -> np.ndarray:
    """Square roots of hashed shares of words and endings, and how much the words repeat."""
    out = np.zeros(TEXT_DIMS + 3)
    words = (text or "").lower().encode(errors="replace").split()
    if not words:
        return out
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        out[zlib.crc32(w) % (TEXT_DIMS // 2)] += n
        out[TEXT_DIMS // 2 + zlib.crc32(w[-2:] + b"$") % (TEXT_DIMS // 2)] += n
    out = np.sqrt(out / len(words))
    out[TEXT_DIMS] = len(counts) / len(words)
    out[TEXT_DIMS + 1] = max(counts.values()) / len(words)
    out[TEXT_DIMS + 2] = sum(map(len, words)) / len(words) / 10
    return out


def metadata_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Language and source by hash, and length, lines and kinds of characters."""
    out = np.zeros(LANG_DIMS + SOURCE_DIMS + 10)
    out[zlib.crc32((lang or "").encode()) % LANG_DIMS] = 0.5
    out[LANG_DIMS + zlib.crc32((source or "").encode()) % SOURCE_DIMS] = 0.5
    data = np.frombuffer((text or "").encode(errors="replace"), np.uint8)
    n = max(len(data), 1)
    upper = int(((data >= 65) & (data <= 90)).sum())
    lower = int(((data >= 97) & (data <= 122)).sum())
    marks = int(((data > 32) & (data < 48) | (data > 57) & (data < 65) | (data > 90) & (data < 97) | (data > 122) & (data < 127)).sum())
    ends = int(((data == 46) | (data == 44)).sum())
    space = int(((data == 32) | ((data >= 9) & (data <= 13))).sum())
    lines = int((data == 10).sum()) + 1
    size = np.log1p(len(data))
    out[LANG_DIMS + SOURCE_DIMS :] = [
        size / 10, size**2 / 100, np.log1p(lines) / 5, np.log1p(n / lines) / 10, upper / max(upper + lower, 1),
        3 * (marks - ends) / n, 3 * ends / n, 3 * int(((data >= 48) & (data <= 57)).sum()) / n, space / n, len(data) == 0,
    ]
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.3, rounds: int = 25):
    """Weights and bias by Newton steps; ``y`` may be soft."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, weight = np.zeros(x1.shape[1]), np.ones(len(x)) if weight is None else weight
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        curve = (x1 * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(curve, x1.T @ (weight * (p - y)) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


@dataclass
class CoTrained:
    text: tuple[np.ndarray, float]
    metadata: tuple[np.ndarray, float]
    text_scale: tuple[np.ndarray, float]
    metadata_scale: tuple[np.ndarray, float]
    combined: tuple[np.ndarray, float]

    def scores(self, text_rows: np.ndarray, metadata_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text and metadata scores, and the combined one."""
        logits = [_calibrated(scale, x @ w + b) for (w, b), scale, x in ((self.text, self.text_scale, text_rows), (self.metadata, self.metadata_scale, metadata_rows))]
        both = np.stack(logits, axis=1) @ self.combined[0] + self.combined[1]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*logits, both))


def _calibrated(scale, logit: np.ndarray) -> np.ndarray:
    return np.clip(logit, -30, 30) * scale[0][0] + scale[1]


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], apart: np.ndarray) -> CoTrained:
    """``views``: two feature tables of labelled rows; ``pool``: of unlabelled rows; ``apart``: rows to calibrate on."""
    fit = ~apart if (~apart).any() and len(set(y[~apart])) == 2 and len(set(y[apart])) == 2 else np.ones(len(y), bool)
    check = apart if not fit.all() else fit
    given = [np.full(len(pool[0]), np.nan), np.full(len(pool[0]), np.nan)]
    share = float(y[fit].mean())
    models = [logistic(v[fit], y[fit]) for v in views]
    each = max(1, int(GIVE * len(pool[0])))
    for _ in range(ROUNDS if len(pool[0]) else 0):
        chances = [1 / (1 + np.exp(-np.clip(p @ w + b, -30, 30))) for p, (w, b) in zip(pool, models)]
        for own, other in ((0, 1), (1, 0)):
            chance = np.where(np.isnan(given[other]), chances[own], 0.5)
            good = np.argsort(-chance, kind="stable")[: max(1, int(each * share))]
            bad = np.argsort(chance, kind="stable")[: max(1, int(each * (1 - share)))]
            given[other][good[chance[good] >= SURE]] = 1
            given[other][bad[chance[bad] <= 1 - SURE]] = 0
        models = []
        for v, p, g in zip(views, pool, given):
            has = ~np.isnan(g)
            # a guessed label weighs half a given one
            weight = np.concatenate([np.ones(fit.sum()), np.full(has.sum(), 0.5)])
            models.append(logistic(np.concatenate([v[fit], p[has]]), np.concatenate([y[fit], g[has]]), weight))
    scales = []
    for v, (w, b) in zip(views, models):
        scales.append(logistic(np.clip(v[check] @ w + b, -30, 30)[:, None], y[check], ridge=1e-3))
    logits = np.stack([_calibrated(s, v[check] @ w + b) for s, v, (w, b) in zip(scales, views, models)], axis=1)
    return CoTrained(*models, *scales, logistic(logits, y[check], ridge=1e-2))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        text = [text_view(t).astype("<f4").tobytes() for t, _, _ in rows]
        meta = [metadata_view(*r).astype("<f4").tobytes() for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=["place", "y", "x", "m"])


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS) -> CoTrained | None:
    """From documents (doc_id, text, lang, source) and labels (doc_id, quality); None if a class has no row.

    Ids are drawn by a hash: about ``fit_rows`` labelled ones, half of each class
    or all it has, and about ``pool_rows`` others. An id labelled twice counts as
    bad if one label says so; null labels and ids say nothing.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    keep = {c: min(1.0, fit_rows / 2 / n) for c, n in sizes.items()}
    drawn = known.filter(part < F.when(F.col("y") == 1, keep[1]).otherwise(keep[0]))
    total = docs.count()
    pool = docs.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / float(1 << 20) < min(1.0, pool_rows / max(total, 1))))
    columns = ["text", "lang", "source", F.xxhash64("doc_id", F.lit(9)).alias("place")]
    # about fit_rows ids: bounded broadcasts
    ids = F.broadcast(drawn.withColumnRenamed("doc_id", "label_id"))
    chosen = docs.join(ids, F.col("doc_id") == F.col("label_id")).select(*columns, "y")
    unlabelled = pool.join(ids.select("label_id"), F.col("doc_id") == F.col("label_id"), "left_anti").select(*columns, F.lit(None).cast("int").alias("y"))
    rows = chosen.unionByName(unlabelled).mapInArrow(_features, "place long, y int, x binary, m binary").toArrow()
    order = np.lexsort((rows.column("y").fill_null(-1).to_numpy(), rows.column("place").to_numpy()))
    y = rows.column("y").to_pandas().to_numpy(dtype=float)[order]
    views = [np.array([np.frombuffer(b, "<f4") for b in rows.column(c).to_pylist()], dtype=np.float64)[order] for c in ("x", "m")]
    place = rows.column("place").to_numpy()[order]
    has = ~np.isnan(y)
    if len(set(y[has])) < 2:
        return None
    return co_train([v[has] for v in views], y[has], [v[~has] for v in views], (place[has] % 4 == 0))


def score_quality(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, text_score, metadata_score, score, keep)`` of every document, 0 to 1.

    A null text scores as an empty one, nulls of lang and source as empty names;
    without a model every score is null and every document kept. Other columns
    are ignored; repeated rows score alike.
    """
    shared = shared_object(docs.sparkSession, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in batches:
            columns: list[list] = [[], [], []]
            for start in range(0, batch.num_rows, 512):
                rows = list(zip(*(batch.column(i).slice(start, 512).to_pylist() for i in (1, 2, 3))))
                if known is None:
                    found = [[None] * len(rows)] * 3
                else:
                    found = known.scores(np.array([text_view(r[0]) for r in rows]), np.array([metadata_view(*r) for r in rows]))
                for column, values in zip(columns, found):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], names=["doc_id", "text_score", "metadata_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text", "lang", "source").mapInArrow(scored, f"doc_id {kind}, text_score double, metadata_score double, score double")
    return made.withColumn("keep", F.coalesce(F.col("score") >= threshold, F.lit(True)))


def learned_quality(labels: DataFrame) -> DataFrame:
    return labels.filter(fold(F.col("doc_id"), 4) != 2)
