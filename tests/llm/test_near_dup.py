import random
import re
from collections import Counter

import numpy as np
import pytest

from querent.llm import near_dup
from tests.llm.helpers import documents, odd_rows, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    width = min(5, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else Counter()


def probability_jaccard(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys())
    return total


def edited(text, seed, changes):
    rng, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def brute_classes(rows, threshold=0.8):
    first = {}
    for i, text, _, _ in rows:
        if i is not None and text is not None:
            first[text] = min(i, first.get(text, i))
    root = {i: i for i in first.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for t, i in first.items()}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a].keys() & sets[b].keys() and probability_jaccard(sets[a], sets[b]) >= threshold - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((str(i), str(find(first[t]) if i is not None and t is not None else first.get(t, i) if t is not None else i)) for i, t, _, _ in rows)


def test_similarity_of_weighted_sets():
    rng = random.Random(1)
    for _ in range(60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(3, 40))]
        other = words[:]
        for _ in range(rng.randint(0, 8)):
            other[rng.randrange(len(other))] = rng.choice("abcxyz")
        a, b = " ".join(words), " ".join(other)
        mine = near_dup.similarity(near_dup.weighted_shingles(a), near_dup.weighted_shingles(b))
        assert mine == pytest.approx(probability_jaccard(shingles(a), shingles(b)))


def test_registers_agree_as_often_as_texts_are_similar():
    base = prose(3, 200)
    texts = [base, edited(base, 1, 4), edited(base, 2, 20)]
    sets = [near_dup.weighted_shingles(t) for t in texts]
    owner = np.repeat(np.arange(3), [len(k) for k, _ in sets])
    held = near_dup.registers(owner, np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets]).astype(float), 3, 4000)
    for other in (1, 2):
        agree = (held[0] & np.uint64(0xFFFFFFFF) == held[other] & np.uint64(0xFFFFFFFF)).mean()
        assert agree == pytest.approx(near_dup.similarity(sets[0], sets[other]), abs=0.04)


def test_a_sketch_does_not_depend_on_its_neighbours():
    sets = [near_dup.weighted_shingles(prose(s, 50)) for s in range(3)]
    alone = near_dup.registers(np.zeros(len(sets[1][0]), int), sets[1][0], sets[1][1].astype(float), 1, 60)
    owner = np.repeat(np.arange(3), [len(k) for k, _ in sets])
    together = near_dup.registers(owner, np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets]).astype(float), 3, 60)
    assert (alone[0] == together[1]).all()


def test_long_texts_are_cut_between_words(monkeypatch):
    text = (prose(7, 2000) + "\n" + "x" * 3000 + "\t end").encode()
    whole = near_dup.text_words(text)
    monkeypatch.setattr(near_dup, "CHUNK", 100)
    assert (near_dup.text_words(text) == whole).all()
    assert len(whole) == len(re.findall(rb"[^\x20\x09-\x0d]+", text))


def test_classes_equal_brute_force(spark):
    rows, rng = [], random.Random(9)
    for group in range(25):
        base = prose(group, rng.randint(8, 150))
        rows.append((len(rows) * 3, base, "en", "a"))
        for copy in range(rng.randint(0, 6)):
            rows.append((len(rows) * 3, edited(base, copy, rng.randint(0, 7)) if copy % 3 else base, "en", "a"))
    # a chain: each like the next, the ends unlike
    link = prose(500, 150)
    for step in range(6):
        rows.append((len(rows) * 3, link, "en", "a"))
        link = edited(link, 70 + step, 3)
    # a passage that many texts share
    passage = prose(600, 60)
    rows += [(2000 + i, f"{prose(700 + i, 60)} {passage}", "en", "a") for i in range(20)]
    rng.shuffle(rows)
    made = near_dup.near_duplicate_classes(documents(spark, rows))
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in made.collect()) == brute_classes(rows)


@pytest.mark.parametrize("take", [0, 1, None])
def test_odd_rows(spark, take):
    rows = odd_rows()[:take]
    docs = documents(spark, rows)
    got = near_dup.near_duplicate_classes(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == brute_classes(rows)
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({c for i, c in brute_classes(rows) if i != "None"} | {i for i, _ in brute_classes(rows) if i == "None"})


def test_components_of_a_long_path(spark):
    nodes = spark.range(40).selectExpr("id as node", "id as root")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 29)] + [(33, 31)], "a long, b long")
    roots = {r["node"]: r["root"] for r in near_dup._roots(nodes, links).collect()}
    assert all(roots[i] == 0 for i in range(30)) and roots[33] == 31 and roots[35] == 35


def test_one_id_with_two_texts(spark):
    a, b = prose(801, 80), prose(802, 80)
    rows = [(1, a, "en", "a"), (1, b, "en", "a"), (2, edited(b, 1, 1), "en", "a"), (3, edited(b, 2, 1), "en", "a"), (4, prose(803, 80), "en", "a")]
    docs = documents(spark, rows)
    got = sorted((r["doc_id"], r["class_id"], r["text_id"]) for r in near_dup.near_duplicate_classes(docs).collect())
    # B's links to 2 and 3 stay; A is alone but carries the same name
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 4, 4)]
    kept = sorted((r["doc_id"], r["text"]) for r in near_dup.keep_one_of_each(docs).collect())
    assert kept == sorted([(1, a), (1, b), (4, rows[4][1])])  # A has no copy and stays
    again = near_dup.keep_one_of_each(documents(spark, rows + [rows[1], rows[0]]))
    assert sorted((r["doc_id"], r["text"]) for r in again.collect()) == kept


def test_copies_of_one_text_need_no_pairs_among_them(spark, monkeypatch):
    """Each copy is near to the first text, not to other copies: compared with it, they leave no pairs of copies."""
    rng = random.Random(12)
    first = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(100, " ".join(first), "en", "a")]
    for i in range(40):
        words = list(first)
        for at in range(rng.randrange(80), 400, 80):
            words[at] = f"c{i}x{at}"
        rows.append((i, " ".join(words), "en", "a"))
    pairs = []

    def counted(df, purpose):
        made = stored(df, purpose)
        if purpose == "near-likely":
            pairs.append(made.count())
        return made

    stored = near_dup.stored
    monkeypatch.setattr(near_dup, "stored", counted)
    classes = near_dup.near_duplicate_classes(documents(spark, rows)).collect()
    assert {r.class_id for r in classes} == {0} and len(classes) == 41
    assert sum(pairs) == 0
