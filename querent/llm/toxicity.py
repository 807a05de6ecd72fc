"""Toxicity by weak supervision.

Voters look at a text: words of a mined lexicon, and patterns. A generative model
of their votes, fitted without trusting any of them, estimates how often each
speaks and how often it is right for toxic and clean texts, and how strongly
voters repeat each other; its posterior labels train a linear classifier.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import fold, shared_object
from querent.session import stored

#: Labelled rows the models are fitted on, half of them toxic if there are as many.
FIT_ROWS = 16_000
LEXICON = 32
FEATURES = 256
THRESHOLD = 0.3
MIN_DOCS = 3
#: Evidence (log ratio times surplus of documents) that a term needs as a feature and as a voter.
FEATURE_EVIDENCE, VOTER_EVIDENCE = 12.0, 18.0
PATTERNS = ("two_terms", "no_term", "shouting", "exclaiming", "clean_caps")
#: Lengths of the starts of words that are terms, too.
STARTS = (4, 5)
#: Separators of words: everything in ASCII but letters and the apostrophe.
SPLIT = bytes(c if c >= 128 or chr(c).isalpha() or c == 39 else 32 for c in range(256))


def term_set(text: str | None) -> set[bytes]:
    """Lower-case words of a whole text, and the starts of longer words with a star.

    Starts catch stems that take many endings.
    """
    if not text:
        return set()
    words = set(text.lower().encode(errors="replace").translate(SPLIT).split())
    return words.union(*({w[:n] + b"*" for w in words if len(w) > n} for n in STARTS))


def shape(text: str | None) -> list[float]:
    """Shares of capitals among letters and of exclamation marks among words, and the log length."""
    if not text:
        return [0.0, 0.0, 0.0]
    data = np.frombuffer(text.encode(errors="replace"), np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    lower = int(((data >= 97) & (data <= 122)).sum())
    marks = int((data == 33).sum())
    return [upper / max(upper + lower, 1), min(1.0, 6 * marks / len(data)), float(np.log1p(len(data))) / 10]


@dataclass
class ToxicityModel:
    lexicon: list[bytes]
    terms: list[bytes]
    weights: np.ndarray
    bias: float
    accuracies: dict[str, tuple[float, float]]
    correlations: np.ndarray

    def features(self, text: str | None) -> np.ndarray:
        return text_features(term_set(text), shape(text), self._index(), self.lexicon_set())

    def lexicon_set(self) -> set[bytes]:
        return set(self.lexicon)

    def _index(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.terms)}


def text_features(found: set[bytes], form: list[float], index: dict[bytes, int], lexicon: set[bytes]) -> np.ndarray:
    out = np.zeros(len(index) + 3 + len(form))
    for term in found & index.keys():
        out[index[term]] = 1
    hits = len(found & lexicon)
    out[len(index)] = hits > 0
    out[len(index) + 1] = hits > 1
    out[len(index) + 2] = hits > 2
    out[len(index) + 3 :] = form
    return out


def votes(found: set[bytes], form: list[float], lexicon: list[bytes]) -> list[int]:
    """One vote per lexicon term and pattern: 1 toxic, -1 clean, 0 none."""
    hits = [1 if term in found else 0 for term in lexicon]
    n = sum(hits)
    upper, marks, _ = form
    return [*hits, 1 if n > 1 else 0, -1 if n == 0 else 0, 1 if upper > 0.5 and n else 0, 1 if marks > 0.3 and n else 0, -1 if upper < 0.1 and n == 0 else 0]


def label_model(ballots: np.ndarray, labels: np.ndarray, rounds: int = 25):
    """Posteriors, rates and correlations from votes (rows x voters) by expectation maximisation.

    The given labels are one more voter, whose accuracy is estimated as well.
    Voters are taken as independent given the class at first; the correlation of
    what remains then discounts the evidence of voters that repeat each other.
    """
    everything = np.concatenate([ballots, np.where(labels > 0, 1, -1)[:, None]], axis=1)
    q = np.where(labels > 0, 0.9, 0.1)
    shares = np.ones(everything.shape[1])
    is_vote = [(everything == v).astype(float) for v in (-1, 0, 1)]
    correlation = np.eye(everything.shape[1])
    for turn in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        rates = np.array([[(v.T @ w + 0.1) / (w.sum() + 0.3) for v in is_vote] for w in (1 - q, q)])
        if turn == rounds // 2:
            signed = everything.astype(float)
            expected = q[:, None] * (rates[1, 2] - rates[1, 0]) + (1 - q)[:, None] * (rates[0, 2] - rates[0, 0])
            left = signed - expected
            scale = np.sqrt(np.maximum((left**2).mean(axis=0), 1e-6))
            correlation = (left.T @ left) / len(left) / np.outer(scale, scale)
            shares = 1 / np.maximum(np.clip(correlation, 0, 1).sum(axis=0), 1)
        ratio = np.log(rates[1]) - np.log(rates[0])
        logit = np.log(prior / (1 - prior)) + sum(v @ (ratio[i] * shares) for i, v in enumerate(is_vote))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, rates, correlation


def linear_classifier(x: np.ndarray, q: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30):
    """Logistic regression on soft labels by Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (weight * (p - q)) + penalty * w
        curve = (x1 * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel | None:
    """From documents (doc_id, text) and labels (doc_id, toxic); None if a class has no row.

    About ``fit_rows`` labelled ids are drawn by a hash, half of each class or all
    it has; rows are weighted back to the true shares. An id labelled twice
    counts as toxic if one label says so; null labels and ids say nothing.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = {y: min(1.0, fit_rows / 2 / n) for y, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.filter(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # at most about fit_rows ids: a bounded broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id"))

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([sorted(term_set(t)) for t in texts], pa.list_(pa.binary())), pa.array([shape(t) for t in texts], pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "terms", "shape"],
            )

    columns = chosen.select("text", "doc_id", "toxic")
    kind = columns.schema["doc_id"].dataType.simpleString()
    sample = stored(columns.mapInArrow(termed, f"doc_id {kind}, toxic int, terms array<binary>, shape array<double>"), "toxic-sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    counts = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    counts = counts.filter(F.col("n") >= MIN_DOCS)
    bad, good = (F.col("bad") + 0.5) / (totals[1] + 1.0), (F.col("n") - F.col("bad") + 0.5) / (totals[0] + 1.0)
    # how much a term says: its log ratio, times the share of the class that has it
    counts = counts.withColumn("tells", F.log(bad / good) * (F.col("bad") - (F.col("n") - F.col("bad")) * totals[1] / float(totals[0])))
    counts = counts.withColumn("pure", F.col("bad") / totals[1] > 4 * (F.col("n") - F.col("bad")) / float(totals[0]))
    terms = [bytes(r["term"]) for r in counts.filter(F.col("tells") >= FEATURE_EVIDENCE).orderBy(F.col("tells").desc(), "term").select("term").limit(FEATURES).collect()]
    lexicon = [bytes(r["term"]) for r in counts.filter(F.col("pure") & (F.col("tells") >= VOTER_EVIDENCE)).orderBy(F.col("tells").desc(), "term").select("term").limit(LEXICON).collect()]

    index, in_lexicon = {t: i for i, t in enumerate(terms)}, set(lexicon)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(set(found), form) for found, form in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            ballots = [np.array(votes(found, form, lexicon), np.int8).tobytes() for found, form in rows]
            seen = [text_features(found, form, index, in_lexicon).astype("<f4").tobytes() for found, form in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ballots, pa.binary()), pa.array(seen, pa.binary())], names=["doc_id", "toxic", "ballot", "x"])

    rows = sample.mapInArrow(voted, f"doc_id {kind}, toxic int, ballot binary, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    ballots = np.array([np.frombuffer(bytes(r["ballot"]), np.int8) for r in rows])
    x = np.array([np.frombuffer(bytes(r["x"]), "<f4") for r in rows], dtype=np.float64)
    y = np.array([r["toxic"] for r in rows])
    q, rates, correlation = label_model(ballots, y)
    real = np.where(y == 1, 1 / share[1], 1 / share[0])
    weights, bias = linear_classifier(x, q, real * len(real) / real.sum())
    names = [t.decode(errors="replace") for t in lexicon] + list(PATTERNS) + ["label"]
    accuracies = {name: (float(rates[0, 0, i]), float(rates[1, 2, i])) for i, name in enumerate(names)}
    return ToxicityModel(lexicon, terms, weights, bias, accuracies, correlation)


def text_scores(model: ToxicityModel | None, texts: pa.Array) -> np.ndarray:
    """The score of each text."""
    score = np.zeros(len(texts))
    if not model:
        return score
    index, lexicon = {t: i for i, t in enumerate(model.terms)}, set(model.lexicon)
    for i, value in enumerate(texts):
        own = value.as_py()
        x = text_features(term_set(own), shape(own), index, lexicon)
        score[i] = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: 0 to 1, higher the likelier toxic; 0 without a model.

    A null text scores as an empty one. A column of this name is replaced.
    """
    docs = docs.drop("score")
    shared = shared_object(docs.sparkSession, model)
    at = docs.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in batches:
            score = text_scores(known, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(scored, ", ".join([*fields, "score double"]))


def learned_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(fold(F.col("doc_id"), 4) != 2)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns."""
    model = fit_toxicity(docs, learned_labels(labels), fit_rows)
    shared = shared_object(docs.sparkSession, model)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pickle.loads(shared.value)
        for texts in batches:
            yield pa.array(text_scores(known, texts), pa.float64())

    # only the text goes to Python, and one number comes back
    return docs.filter(F.arrow_udf(scored, "double")("text") < threshold)
