import collections

import pytest

from querent.llm import mixing
from tests.llm.helpers import CLASH, documents, odd_rows, prose


def shared_targets(sizes, weights=(5, 2, 1), cap=3):
    """Round after round: share what is open by weight, stop those above their cap."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_names, left = {}, list(names), float(sum(sizes.values()))
    while open_names:
        share = left / sum(weight[s] for s in open_names)
        above = [s for s in open_names if share * weight[s] >= cap * sizes[s]]
        if not above:
            target.update({s: share * weight[s] for s in open_names})
            break
        for s in above:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            open_names.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 400, "c": 90}, {"a": 1, "b": 1, "c": 1000, "d": 3, None: 50}, {"x": 0, "y": 7}, {"z": 0}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
    assert got == pytest.approx(shared_targets(sizes))


def corpus():
    return [(i, prose(i, 20 + i % 60), "en", "abcdef"[i % 3 if i % 2 else 5]) for i in range(400)]


def test_near_targets_and_whole_documents(spark):
    mix = mixing.draw_mix(documents(spark, corpus()), block_words=300)
    rows = mixing.taken_words(mix).collect()
    taken, target = collections.Counter(), {}
    source = {i: s for i, _, _, s in corpus()}
    for r in rows:
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert len(rows) == 400
    for s, t in target.items():
        assert t - 40 <= taken[s] <= t


def test_a_document_longer_than_a_block_leaves_no_gap(spark):
    """Each source ends below its target by less than its smallest document left out."""
    rows = [(i, prose(i, 20 + i % 60), "en", "ab"[i % 2]) for i in range(200)]
    rows += [(1000, prose(1000, 3000), "en", "a"), (1001, prose(1001, 3000), "en", "b")]
    source = {i: s for i, _, _, s in rows}
    taken, target, skipped = collections.Counter(), {}, {}
    for r in mixing.taken_words(mixing.draw_mix(documents(spark, rows), block_words=300, seed=1)).collect():
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        if r["taken"] < r["size"] * (1 + r["target"] // r["source_size"]):
            skipped[s] = min(skipped.get(s, r["size"]), r["size"])
    assert all(target[s] - skipped[s] < taken[s] <= target[s] for s in target if s in skipped)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = documents(spark, corpus())
    key = lambda mix: sorted((r["doc_id"], r["taken"], tuple(r["shards"])) for r in mixing.taken_words(mix).collect())
    assert key(mixing.draw_mix(docs.repartition(7), block_words=300)) == key(mixing.draw_mix(docs.coalesce(1), block_words=300))


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_splitting_tree(shards):
    blocks = [40, 3, 17, 0]
    quotas = mixing.split_quotas(blocks, shards, seed=3)
    assert [sum(q[i] for q in quotas) for i in range(4)] == blocks and min(min(q) for q in quotas) >= 0
    sizes = [sum(q) for q in quotas]
    assert max(sizes) - min(sizes) <= shards.bit_length()
    assert quotas == mixing.split_quotas(blocks, shards, seed=3)


def test_blocks_go_to_shards_by_quota(spark):
    mix = mixing.draw_mix(documents(spark, corpus()), block_words=100, shards=4)
    drawn = [(r["source"], d["shard"]) for r in mix.blocks.collect() for d in r["drawn"]]
    sizes = collections.Counter(shard for _, shard in drawn)
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 3


def test_rows_of_the_mix(spark):
    docs = documents(spark, corpus())
    made = mixing.mix_documents(docs, block_words=300)
    assert made.columns == docs.columns and set(CLASH) <= set(made.columns)
    count = collections.Counter(r["doc_id"] for r in made.collect())
    planned = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.taken_words(mixing.draw_mix(docs, block_words=300)).collect()}
    assert count == collections.Counter({i: n for i, n in planned.items() if n})


@pytest.mark.parametrize("take", [0, 3, None])
def test_odd_rows(spark, take):
    rows = odd_rows()[:take]
    docs = documents(spark, rows)
    got = mixing.taken_words(mixing.draw_mix(docs)).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_documents(docs).columns == docs.columns


def test_no_python_runs(spark):
    plan = mixing.draw_mix(documents(spark, corpus())).documents._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
