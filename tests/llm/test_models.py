"""Language model, language ID, toxicity and quality: brute force and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querent.llm import language_model, langid, quality_classifier, toxicity
from querent.llm.common import fold
from tests.llm.helpers import CLASH, documents, odd_rows, prose

INSULTS = ["blockhead", "nitwit", "dunce", "oaf"]


def corpus(n=240):
    rng, rows = random.Random(8), []
    for i in range(n):
        words = prose(i, rng.randint(20, 90), "de" if i % 4 == 0 else "en").split()
        if i % 6 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        if i % 7 == 0:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "de" if i % 4 == 0 else "en", f"s{i % 3}"))
    return rows


def labels(spark, n=240):
    return spark.createDataFrame([(i, int(i % 7 != 0), int(i % 6 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


def test_folds(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)


# language model


def base_scores(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t, _, _ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, found in tokens for w in found if not held(i))
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (str(i), held(i), len(found), sum(counts[w] > 0 for w in found), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in found), 6))
        for i, found in tokens
    )


@pytest.mark.parametrize("rows", [corpus(), odd_rows(), odd_rows()[:1], []], ids=["corpus", "odd", "null", "empty"])
def test_language_model_base(spark, rows):
    got = language_model.score_texts(documents(spark, rows)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == base_scores(rows)
    assert all(r["score"] <= 0 for r in got)


def test_language_model_beats_its_base_on_held_out_texts(spark):
    got = [r for r in language_model.score_texts(documents(spark, corpus(600))).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.98 * sum(r["base_score"] for r in got)


def test_probabilities_sum_to_one():
    tokens = np.zeros(language_model.CLASSES)
    tokens[[0, 1, 2, 40]] = [10, 20, 5, 12]
    model = language_model.Model([b"aa", b"bb"], tokens, (tokens > 0) * 4.0, 0.5)
    classes, c = np.array([40, 40, 40, 40, 40]), np.array([6.0, 3.0, 2.0, 1.0, 0.0])
    assert (10 ** language_model.within_class(model, classes, c)).sum() == pytest.approx(1)
    slots = np.arange(8, dtype=np.uint16).reshape(2, 4)
    model.weights[:8] = np.random.default_rng(1).normal(size=(8, language_model.CLASSES))
    assert np.exp(language_model.log_softmax(model.weights, model.bias, slots)).sum(axis=1) == pytest.approx(np.ones(2), abs=1e-5)


def test_classes_and_features_of_the_history():
    assert language_model.CLASSES == 64
    hashes = language_model.block_hashes([b"", b"one", b"two", b"three", b"four", b"bold"])
    slots = lambda tokens: language_model.history_slots(*hashes, np.array(tokens), np.array([len(tokens)]))[-1]
    assert len(slots([1, 2, 3, 4])) == language_model.FEATURES == 6
    # the word three before counts, and so does the ending two before
    assert (slots([1, 2, 3, 4]) != slots([5, 2, 3, 4])).sum() == 1
    assert (slots([1, 2, 3, 4]) != slots([1, 5, 3, 4])).sum() == 3


def test_words_of_a_class_follow_the_history(spark):
    """Two words of one class, each after its own word: counts alone give either one half."""
    pairs = [("north", "zarking"), ("south", "zolking")]
    # other words, twice as frequent, take the classes of their own
    rng, common = random.Random(4), [f"w{i}" for i in range(language_model.HEAD)]
    rows = [(i, " ".join(w for _ in range(50) for w in (*common, *rng.choice(pairs))), "en", "s") for i in range(60)]
    assert len({language_model.ending_class(b.encode()) for _, b in pairs}) == 1
    got = [r for r in language_model.score_texts(documents(spark, rows)).collect() if r["held_out"]]
    inside = sum(r["score"] - r["class_score"] for r in got) / (50 * len(got))
    # north and south, and the word after them, cost a half each by counts; only the first is free of the history
    assert inside > 1.5 * math.log10(0.5)


def test_words_and_unknown_ones_of_a_class_sum_to_one():
    tokens, types = np.zeros((2, language_model.CLASSES, language_model.BINS))
    cell, shared = language_model.HEAD + 1, language_model.OWN + 2
    tokens[cell, [0, 1, shared]], types[cell, [0, 1, shared]] = [9, 7, 6], [1, 1, 3]
    model = language_model.Model([], tokens, types, 0.5, {b"aa": 0, b"bb": 1})
    model.weights += np.random.default_rng(1).normal(size=model.weights.shape)
    bins, c = np.array([0, 1, shared, shared, shared, shared]), np.array([9.0, 7.0, 3.0, 2.0, 1.0, 0.0])
    classes, slots = np.full(6, cell), np.tile(np.arange(6, dtype=np.uint16), (6, 1))
    own = language_model.within_class(model, classes, c, bins)
    assert (10 ** language_model.log_bins(model, slots, classes, bins, own, c > 0)).sum() == pytest.approx(1, abs=1e-5)


def test_sums_by_slot_and_crc32_of_parts_are_those_of_plain_loops():
    rng = np.random.default_rng(5)
    gradient = rng.normal(size=(900, language_model.CLASSES)).astype(np.float32)
    # one slot with most tokens, some with a few, many alone, and slots that two features share
    slots = np.array([np.where(rng.random(900) < share, 7, rng.integers(0, many, 900)) for share, many in ((0.8, 30), (0.0, 8000), (0.3, 300))])
    total, hit, of_feature, many = language_model.summed_by_slot(gradient, slots)
    for own, at in zip(slots, of_feature):
        assert sorted(hit[at]) == sorted(set(own)) and many[at].sum() == 900
        for i in at:
            assert many[i] == (own == hit[i]).sum()
            assert total[i] == pytest.approx(gradient[own == hit[i]].sum(axis=0), abs=1e-3)
    words = [b"", b"a", b"ab", b"abc", b"abcdefgh", "äöü".encode(), bytes(range(1, 9))]
    tails, beginnings = language_model.crc32_of_parts(pa.array([b"zz", *words], pa.binary()).slice(1))
    assert tails.tolist() == [zlib.crc32(w[-2:]) for w in words]
    assert beginnings.tolist() == [zlib.crc32(w[:3]) for w in words]


@pytest.mark.parametrize("count", [1, 4, 90, 1500])
def test_sums_by_slot_stand_in_the_room_given(count):
    rng, features = np.random.default_rng(6), language_model.FEATURES
    room = np.full(((features + 1) * 1500, language_model.CLASSES), np.nan, np.float32)
    gradient = rng.normal(size=(count, language_model.CLASSES)).astype(np.float32)
    # tokens in pairs: more slots have a second token than there are tokens
    slots = np.array([rng.permutation(np.arange(count) // 2) for _ in range(features)]) + language_model.SLOTS
    total, hit, of_feature, many = language_model.summed_by_slot(gradient, slots, room)
    assert np.shares_memory(total, room) and many.sum() == slots.size
    for own, at in zip(slots, of_feature):
        assert sorted(hit[at]) == sorted(set(own))
        for i in at:
            assert total[i] == pytest.approx(gradient[own == hit[i]].sum(axis=0), abs=1e-5)


def test_updates_of_a_short_last_step_and_of_no_tokens():
    rng, steps = np.random.default_rng(7), language_model.BIN_STEP_TOKENS
    model = language_model.Model([], np.ones(language_model.CLASSES), np.ones(language_model.CLASSES), 0.5)
    slots = rng.integers(0, 3, size=(steps + 5, language_model.FEATURES)).astype(np.uint16) + np.uint16(language_model.SLOTS)
    goals, classes = rng.integers(0, language_model.BINS, steps + 5), rng.integers(0, language_model.CLASSES, steps + 5)
    found = []
    for parts in ([slice(None), slice(0, 0)], [slice(0, steps), slice(steps, None)]):
        weights, power = model.weights.copy(), np.zeros(language_model.ROWS, np.float32)
        for part in parts:
            language_model.local_updates(model, weights, model.bin_bias, slots[part], goals[part], power, classes[part])
        found.append((weights, power))
    assert (found[0][0] == found[1][0]).all() and (found[0][1] == found[1][1]).all()
    assert found[0][1].sum() == slots.size and np.isfinite(found[0][0]).all()


def test_softmax_of_sums_out_of_range_of_the_exponential():
    weights = np.zeros((4, language_model.CLASSES), np.float32)
    weights[1, 3], weights[2] = 500, -400
    slots = np.array([[0, 0], [1, 1], [2, 2], [1, 2]], np.uint16)
    found = language_model.log_softmax(weights, np.zeros(language_model.CLASSES, np.float32), slots)
    assert np.exp(found).sum(axis=1) == pytest.approx(np.ones(4), abs=1e-5)
    chosen = language_model.log_chosen(weights, np.zeros(language_model.CLASSES, np.float32), slots, np.full(4, 3))
    assert chosen == pytest.approx(found[:, 3], abs=1e-5) and chosen[1] == 0


def test_places_of_words_in_classes_and_bins_are_found_by_their_crc32():
    words = [b"", *(f"w{i}".encode() for i in range(3000))]
    model = language_model.Model(words[1:40], np.ones(language_model.CLASSES), np.ones(language_model.CLASSES), 0.5, {w: i for i, w in enumerate(words[100:140])})
    _, classes, bins = language_model.block_words(model, pa.array(words, pa.binary()))
    assert classes.tolist() == [0] + [model.head.get(w) or language_model.ending_class(w) for w in words[1:]]
    assert bins.tolist() == [model.own.get(w, language_model.shared_bin(w)) for w in words]


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    slots = rng.integers(0, 50, size=(4000, 4)).astype(np.uint16)
    goals = slots[:, 0].astype(int) % 10
    model = language_model.Model([], np.ones(language_model.CLASSES), np.ones(language_model.CLASSES), 0.5)
    loss = lambda: -language_model.log_softmax(model.weights, model.bias, slots)[np.arange(4000), goals].mean()
    before, power = loss(), np.zeros(language_model.SLOTS, np.float32)
    for _ in range(20):
        language_model.local_updates(model, model.weights, model.bias, slots, goals, power)
    assert loss() < 0.5 * before


def test_small_blocks_give_the_same_base(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 600)
    got = language_model.score_texts(documents(spark, corpus(60))).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == base_scores(corpus(60))


# language ID


def test_language_id_held_out(spark):
    docs = documents(spark, corpus())
    model = langid.fit_language_id(langid.learned_rows(docs))
    got = langid.identify(docs.select("doc_id", "lang", "text"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["rejected"] for r in got)
    foreign = documents(spark, [(1, "ㅎㅏㄴ 漢字 文字 漢字 " * 30, None, None), (2, "q" * 400, None, None)])
    assert all(r["rejected"] for r in langid.identify(foreign, model).collect())


def test_foreign_and_short_texts_are_rejected_and_own_short_ones_kept():
    known = [(lang, langid.ngram_counts(text)) for _, text, lang, _ in corpus()]
    model = langid.fit_centroids(known)
    judge = lambda texts: model.predict(np.array([langid.ngram_counts(t) for t in texts]))[2]
    foreign = ["Questa mattina siamo andati al mercato per comprare della frutta", "Bu sabah taze meyve almak icin pazara gittik", "aamulla kova ukkospilvi"]
    assert judge([" ".join([t] * k) for t in foreign for k in (1, 2, 5)]).all()
    assert judge([prose(i, 5) for i in range(50)]).mean() < 0.1
    assert (model.floor > 0).all()


def test_ngram_counts_of_whole_texts(monkeypatch):
    text = prose(3, 3000)
    whole = langid.ngram_counts(text)
    assert whole.sum() == sum(len(f" {text} ") - order + 1 for order in langid.ORDERS)
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert (langid.ngram_counts(text) == whole).all()


@pytest.mark.parametrize("take", [0, None])
def test_language_id_odd_rows(spark, take):
    rows = odd_rows()[:take]
    docs = documents(spark, rows)
    model = langid.fit_language_id(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        has_letter = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] in ("en", "de")) == has_letter and (has_letter or r["lang_pred"] == "und" and r["rejected"])
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["rejected"] for r in kept.collect()} <= {"x"}


# toxicity


def test_toxicity_held_out(spark):
    docs = documents(spark, corpus())
    model = toxicity.fit_toxicity(docs, toxicity.learned_labels(labels(spark)))
    assert {w.encode() for w in INSULTS} <= set(model.lexicon)
    got = toxicity.score_toxicity(docs.select("doc_id", "text"), model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 6 == 0) for r in held)


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    vote = lambda hit, false: np.where(rng.random(4000) < np.where(y, hit, false), 1, 0)
    good, poor, third = vote(0.8, 0.02), vote(0.3, 0.25), vote(0.6, 0.05)
    ballots = np.stack([good, poor, third, poor], axis=1)
    q, rates, correlation = toxicity.label_model(ballots, np.where(rng.random(4000) < 0.95, y, ~y).astype(int))
    assert ((q > 0.5) == y).mean() > 0.96
    assert rates[1, 2, 0] == pytest.approx(0.8, abs=0.06) and rates[0, 2, 1] == pytest.approx(0.25, abs=0.05)
    assert correlation[1, 3] > 0.99 and abs(correlation[0, 2]) < 0.2


@pytest.mark.parametrize("take", [0, None])
def test_toxicity_odd_rows(spark, take):
    rows = odd_rows()[:take]
    docs = documents(spark, rows)
    odd = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (5, 1, None), (5, 1, 0), (None, 1, 1), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (odd, odd.limit(0)):
        model = toxicity.fit_toxicity(docs, known)
        got = toxicity.score_toxicity(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.keep_clean(docs, odd)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} <= {"x"}


# quality


def test_quality_held_out(spark):
    docs = documents(spark, corpus())
    model = quality_classifier.fit_quality(docs, quality_classifier.learned_quality(labels(spark)))
    got = quality_classifier.score_quality(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["keep"] == (r["doc_id"] % 7 != 0) for r in held]) > 0.95
    assert all(0 <= r[name] <= 1 for r in got for name in ("score", "text_score", "metadata_score"))


def test_views_teach_each_other():
    """With few labels, the pool's guessed labels lift a view above what it learns alone."""
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.5
    a = np.where(y, 1.0, -1.0)[:, None] + rng.normal(size=(3000, 1)) * 0.6
    b = np.concatenate([np.where(y, 0.4, -0.4)[:, None] + rng.normal(size=(3000, 1)) * 0.5, rng.normal(size=(3000, 30))], axis=1)
    few = np.arange(3000) < 40
    model = quality_classifier.co_train([a[few], b[few]], y[few].astype(float), [a[1000:], b[1000:]], np.arange(40) % 4 == 0)
    w, bias = quality_classifier.logistic(b[few], y[few].astype(float))
    alone = (((b[~few] @ w + bias) > 0) == y[~few]).mean()
    taught = (((b[~few] @ model.metadata[0] + model.metadata[1]) > 0) == y[~few]).mean()
    assert taught > alone


@pytest.mark.parametrize("take", [0, None])
def test_quality_odd_rows(spark, take):
    rows = odd_rows()[:take]
    docs = documents(spark, rows)
    odd = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (5, None, 0), (5, 1, 0), (None, 1, 1), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (odd, odd.limit(0)):
        got = quality_classifier.score_quality(docs, quality_classifier.fit_quality(docs, known)).collect()
        assert len(got) == len(rows) and all(r["score"] is None or 0 <= r["score"] <= 1 for r in got)
    assert set(CLASH) <= set(docs.columns)
