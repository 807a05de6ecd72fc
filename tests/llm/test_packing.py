import random
import zlib

import numpy as np
import pytest

from querent.llm import packing
from tests.llm.helpers import documents, odd_rows, prose


def naive_best_fit(lengths, window):
    open_room = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(open_room) if room >= length]
        at = min(fitting, key=lambda i: open_room[i]) if fitting else None
        if at is None:
            open_room.append(window)
            at = len(open_room) - 1
        open_room[at] -= length
    return sorted(open_room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 33, 64])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, windows = packing.best_fit_plan(counts, window)
    used = np.zeros((windows, window), int)
    for length, segments in plan.items():
        rank = 0
        for upto, first, each, offset in segments:
            for r in range(rank, upto):
                at = offset + (r - rank) % each * length
                used[first + (r - rank) // each, at : at + length] += 1
            rank = upto
        assert rank == counts[length]
    assert used.max() == 1
    # no gap before the end of a window, and the windows of the naive way
    room = window - used.sum(axis=1)
    assert all(row[: window - r].all() for row, r in zip(used, room))
    assert sorted(room.tolist()) == naive_best_fit(lengths, window)


def test_tree_finds_the_tightest():
    tree = packing.RoomTree(20)
    for room in (3, 7, 7, 19):
        tree.add(room, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 8, 20)] == [3, 3, 7, 19, None]


def test_fast_ids_equal_the_library(spark):
    bpe = packing.ByteBpe(*packing.default_tokenizer())
    rng = random.Random(5)
    alphabet = "ab  \n\t'sS.1é€—  漢🙂\x1c\x85͸"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(600)] + [prose(1, 300), "a <|endoftext|> b", ""]
    for text in texts:
        assert bpe.ids(text).tolist() == bpe.exact.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("take", [0, None])
def test_documents_come_back_whole(spark, take):
    rows = odd_rows()[:take]
    got = packing.pack_documents(documents(spark, rows)).collect()
    bpe = packing.ByteBpe(*packing.default_tokenizer())
    ids = {}
    for doc_id, text, _, _ in rows:
        ids[doc_id] = [*bpe.ids(text or "").tolist(), 1]
    by_sequence = {}
    for r in got:
        raw = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(raw) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _, _, _ in rows)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
