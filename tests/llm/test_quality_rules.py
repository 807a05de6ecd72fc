import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.llm import quality_rules
from tests.llm.helpers import documents, odd_rows, prose


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check_counts(spark, rows):
    got = quality_rules.text_counts(documents(spark, rows).withColumn("raw", F.col("text")), "doc_id", "raw").select("raw", *quality_rules.COUNTS).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute_counts(r["raw"]), r["raw"]


def test_counts_of_random_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", "é", "🙂", "#", "|", " ", " ", "\n", "\t", "\x0b", " ", "c d e"], k=rng.randint(0, 120))) for _ in range(300)]
    check_counts(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])


def test_counts_of_odd_rows(spark):
    check_counts(spark, odd_rows() + [(20, "x y z " * 5000, "en", "a"), (21, "a b c\n" * 3, None, None)])


def test_pairs_where_packing_merges_hashes(spark):
    """A text so long in bits that packing leaves few bits of the hash still counts right."""
    words = [f"w{i % 700}" for i in range(2100)]
    check_counts(spark, [(1, " ".join(words), "en", "a")])


def test_distance_is_that_of_the_best_scatter(spark):
    """Planted outliers lie far, and the centre and scatter are those of the rest."""
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal(np.zeros(5), np.eye(5) + 0.6, size=800)
    bad = rng.normal(9, 0.3, size=(120, 5))
    rows = [("g", *map(float, x)) for x in np.concatenate([good, bad])]
    names = ", ".join(f"x_{i} double" for i in range(5))
    made = quality_rules.robust_distances(spark.createDataFrame(rows, f"group string, {names}")).collect()
    distance = np.array([r["distance"] for r in made])
    outlier = np.array([r["x_0"] > 6 for r in made])
    assert distance[outlier].min() > 100 and np.quantile(distance[~outlier], 0.99) < 30
    points = np.array([[r[f"x_{i}"] for i in range(5)] for r in made])[~outlier]
    off = points - good.mean(axis=0)
    true = np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(good.T)), off)
    assert np.corrcoef(true, distance[~outlier])[0, 1] > 0.95


def test_verdicts(spark):
    rows = [(i, prose(i, 60 + i % 90), "en", "a" if i % 5 else "b") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "#$%" for w in prose(i, 90).split()), "en", "a") for i in range(10)]
    rows += [(2000 + i, prose(i, 12), "en", "a") for i in range(5)] + [(3000, "one two three " * 40, "en", "a")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules.quality_outliers(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(400)) and not any(got[1000 + i]["kept"] for i in range(10))
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (2000, 2004, 3000))
    plan = quality_rules.quality_outliers(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("take", [0, 1, None])
def test_odd_rows(spark, take):
    rows = odd_rows()[:take]
    got = quality_rules.quality_outliers(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    # groups too small to judge reject nobody
    assert all(r["kept"] != r["base_failed"] for r in got)


def test_groups_are_pooled_when_small(spark):
    rows = [(i, prose(i, 80), "en", f"s{i}") for i in range(120)] + [(500 + i, prose(i, 80, "de"), None, None) for i in range(130)]
    got = quality_rules.quality_outliers(documents(spark, rows)).filter(F.col("distance").isNull()).count()
    assert got == 0
