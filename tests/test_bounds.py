"""What a task holds is bounded by pieces, not by what a batch holds; files do not grow with databases."""

import pyarrow as pa

from querent.operators import bm25, postings, topk
from tests.test_bm25 import ask, found, make
from workload import inputs


def batch(n):
    words = [[f"w{i % 7}", f"w{i % 5}", "all", "all"][: i % 5] for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["item_id", "tokens"])


def test_words_are_counted_in_pieces(monkeypatch):
    whole = pa.Table.from_batches(list(bm25._count_terms([batch(100)]))).to_pylist()
    monkeypatch.setattr(bm25, "PIECE_WORDS", 10)
    parts = list(bm25._count_terms([batch(100)]))
    assert len(parts) > 10 and sum(int(sum(r.as_py() or [0])) for p in parts for r in p.column("tfs")) == 200
    assert pa.Table.from_batches(parts).to_pylist() == whole


def test_items_are_scanned_in_pieces(spark, monkeypatch):
    docs = [f"x{i % 9} y{i % 4} z" for i in range(60)]
    index = bm25.build_bm25_index(make(spark, docs, ["a", "b"] * 30))
    asked = ask(spark, [("a", "x1 y2"), (None, "z x3")])
    whole = found(bm25.bm25_topk(index, asked, 5))
    held = batch(100)
    monkeypatch.setattr(topk, "PIECE_BYTES", held.nbytes // 10)
    assert len(list(topk._pieces([held]))) >= 10
    assert found(bm25.bm25_topk(index, asked, 5)) == whole


def test_postings_are_written_without_a_row_each(spark):
    """Lists, not rows: a word of every document takes a row a task and block."""
    docs = ["all the same words"] * 400
    index = bm25.build_bm25_index(make(spark, docs, ["a"] * 400))
    made = postings.build_postings(index)
    assert made.rows.count() == 1600
    assert made.lists.count() <= 4 * spark.sparkContext.defaultParallelism * topk.TASKS_PER_CORE < 1600
    assert {r.n for r in made.maxima.collect()} == {400}


def test_repeated_ids_do_not_raise_theta(spark):
    """Two documents of one id: their scores must not be added up when blocks are skipped."""
    common = [f"c v{i}" for i in range(40)]
    docs = ["r s", "r s"] + ["r s t"] * 3 + common
    rows = [(0 if i < 2 else i, i, "a", d) for i, d in enumerate(docs)]
    corpus = spark.createDataFrame(rows, "item_id long, corpus_idx long, db_id string, text string")
    index = bm25.build_bm25_index(corpus)
    made = postings.build_postings(index)
    asked = ask(spark, [("a", "r s c"), (None, "c v3")])
    for within in (False, True):
        plain = sorted(map(tuple, bm25.bm25_topk(index, asked, 4, within=within, fill=False).collect()))
        assert sorted(map(tuple, postings.bm25_topk_pruned(index, made, asked, 4, within=within).collect())) == plain


def test_examples_have_no_folder_a_database(spark, tmp_path):
    said = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(60) for t in range(4)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for files in (inputs.examples_index(spark, str(tmp_path)).docs.inputFiles(), inputs.examples_vectors(spark, str(tmp_path)).inputFiles()):
        assert files and not any("db_id=" in f for f in files)
