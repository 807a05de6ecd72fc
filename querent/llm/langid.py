"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts become normalised TF-IDF vectors of hashed byte n-grams; each language is
described by several centroids, clustered on its own vectors; a text belongs to
the language of the centroid of highest cosine. Texts well farther from it than
nearly all of the language's own texts of like length get rejected.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import fold, shared_object

DIMS = 2048
ORDERS = (1, 2, 3)
#: Rows the centroids are fitted on: a sample, dealt evenly over the languages.
FIT_ROWS = 6000
CENTROIDS = 4
UNKNOWN = "und"
#: Accepted: cosines of at least this share of a low quantile among fitted texts of like length.
SLACK = 0.8
LOWEST = 0.01
#: Fitted texts that make a floor; where a length has fewer, all languages are pooled.
ENOUGH = 20
PIECE = 1 << 20
NOT_LETTERS = re.compile(r"[\W\d_]+")
BATCH = 256


def ngram_counts(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Counts of hashed byte n-grams of the letters of a whole text; None without a letter."""
    letters = NOT_LETTERS.sub(" ", text.lower()) if text else ""
    if not letters or letters.isspace():
        return None
    data = np.frombuffer(f" {letters} ".encode(errors="replace"), np.uint8)
    counts = np.zeros(dims, np.int64)
    for start in range(0, len(data), PIECE):
        part = data[start : start + PIECE + max(ORDERS) - 1].astype(np.uint32)
        for order in ORDERS:
            n = min(len(part) - order + 1, PIECE)
            if n > 0:
                code = part[:n].copy()
                for k in range(1, order):
                    code = (code << np.uint32(8)) | part[k : k + n]
                slot = ((code + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1)
                counts += np.bincount(slot, minlength=dims)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    rows = np.log1p(counts.astype(np.float32)) * idf
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1, dtype=np.int64), 1)).astype(int), 15)


def clustered(rows: np.ndarray, many: int) -> np.ndarray:
    """Spherical k-means with farthest-first starts; the same for the same rows."""
    centres = [rows.mean(axis=0)]
    while len(centres) < min(many, len(rows)):
        unit = np.array(centres) / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        centres.append(rows[np.argmin((rows @ unit.T).max(axis=1))])
    centres = np.array(centres)
    for _ in range(8):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = (rows @ centres.T).argmax(axis=1)
        centres = np.array([rows[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


@dataclass
class CentroidModel:
    langs: list[str]
    centres: np.ndarray
    of: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its cosine, and whether the text is too far."""
        cosine = weighted(counts, self.idf) @ self.centres.T
        best = cosine.argmax(axis=1)
        lang = self.of[best]
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return lang, score, score < SLACK * self.floor[lang, length_class(counts)]


def fit_centroids(rows: list[tuple[str, np.ndarray]], centroids: int = CENTROIDS) -> CentroidModel:
    """From ``(lang, counts)`` of labelled texts; order does not matter."""
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    langs = sorted({lang for lang, _ in rows})
    counts = np.array([c for _, c in rows], dtype=np.uint16).reshape(len(rows), -1)
    own = np.array([langs.index(lang) for lang, _ in rows], dtype=int)
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = weighted(counts, idf)
    centres, of = [], []
    for i in range(len(langs)):
        found = clustered(vectors[own == i], centroids)
        centres.append(found)
        of += [i] * len(found)
    model = CentroidModel(langs, np.concatenate(centres).astype(np.float32), np.array(of), idf, np.zeros((len(langs), 16)))
    cosine = np.where(model.of[None, :] == own[:, None], vectors @ model.centres.T, -1).max(axis=1)
    sizes = length_class(counts)
    pooled = np.full(16, np.nan)
    for size in range(16):
        near = (sizes >= size - 1) & (sizes <= size + 1)
        if near.sum() >= ENOUGH:
            pooled[size] = np.quantile(cosine[near], LOWEST)
        for i in range(len(langs)):
            like = cosine[near & (own == i)]
            model.floor[i, size] = np.quantile(like, LOWEST) if len(like) >= ENOUGH else pooled[size]
    for i in range(len(langs)):
        known = np.flatnonzero(~np.isnan(model.floor[i]))
        if not len(known):
            # too few texts of any length: the lowest of all of them
            model.floor[i] = cosine.min()
            continue
        # longer texts than any seen are asked what the longest seen ones reach; of shorter
        # ones, a share: the cosine of a text grows at most with the root of its n-grams
        first = known[0]
        for size in range(16):
            if np.isnan(model.floor[i, size]):
                model.floor[i, size] = model.floor[i, size - 1] if size > first else model.floor[i, first] * 2.0 ** ((size - first) / 2)
        # short texts hold few n-grams: never ask more of them than of longer ones
        model.floor[i] = np.minimum.accumulate(model.floor[i][::-1])[::-1]
    return model


def fit_language_id(docs: DataFrame, fit_rows: int = FIT_ROWS, dims: int = DIMS) -> CentroidModel | None:
    """Centroids from labelled documents (text, lang), about ``fit_rows`` of them by a hash.

    Every language gives an equal part of the sample, or all it has. None if no
    document has both a language and a letter.
    """
    labelled = docs.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 20)) / float(1 << 20)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = max(1, fit_rows // len(sizes))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, max(each, 25) / n) if n > each else 1.0)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, ngram_counts(text, dims)) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            found = [(lang, np.minimum(c, 65535).astype("<u2").tobytes()) for lang, c in found if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["lang", "counts"])

    sample = labelled.filter(order < share[F.col("lang")]).mapInArrow(counted, "lang string, counts binary").collect()
    rows = [(r["lang"], np.frombuffer(bytes(r["counts"]), "<u2")) for r in sample]
    return fit_centroids(rows) if rows else None


def judged(model: CentroidModel | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and whether it is rejected, of each text."""
    lang, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    for start in range(0, len(texts) if model else 0, BATCH):
        counts = [ngram_counts(t.as_py(), len(model.idf)) for t in texts.slice(start, BATCH)]
        where = [i for i, c in enumerate(counts) if c is not None]
        if where:
            best, cosine, too_far = model.predict(np.array([counts[i] for i in where]))
            for i, b, s, f in zip(where, best, cosine, too_far):
                lang[start + i], score[start + i], far[start + i] = model.langs[b], s, f
    return lang, score, far


def identify(docs: DataFrame, model: CentroidModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    A null text or one without a letter is ``und`` with score 0 and rejected, and
    so is every text if there is no model. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = shared_object(docs.sparkSession, model)
    at = docs.columns.index(text)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in batches:
            lang, score, far = judged(known, batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "rejected"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(predicted, ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"]))


def learned_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(fold(F.col("doc_id"), 5) != 0)


def keep_identified(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    model = fit_language_id(learned_rows(docs), fit_rows)
    shared = shared_object(docs.sparkSession, model)

    def accepted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pickle.loads(shared.value)
        for texts in batches:
            yield pa.array(~judged(known, texts)[2], pa.bool_())

    # only the text goes to Python, and one truth value comes back
    return docs.filter(F.arrow_udf(accepted, "boolean")("text"))
