"""Best-fit decreasing packing of token sequences.

Documents are cut into full windows and a rest. Rests are placed longest first,
each into the open window with the least room that still holds it; a segment
tree indexed by remaining room finds that window. Pieces of one length are
interchangeable, so the plan runs over the counts of the lengths (at most as
many numbers as a window has tokens, times the parts lengths are counted in),
and the pieces find their place by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.session import stored

WINDOW = 2048
END_ID = 1
CACHE_WORDS = 200_000
PART_ROWS = 1_000_000
#: Parts each length is ranked in at least: many pieces of one length do not meet in one task.
LEAST_PARTS = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Characters both tokenizer libraries class alike in any version; other texts take the slow way.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞€Α-ΡΣ-ϿА-я]*")


class ByteBpe:
    """Token ids of the tokenizer file; plain texts through its faster twin.

    ``vocabulary`` names the JSON file, ``ranks`` the same vocabulary as ranks
    (or None). Ids are those of ``tokenizers`` with ``add_special_tokens=False``.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


_LOADED: dict[tuple, ByteBpe] = {}


def _loaded(files: tuple) -> ByteBpe:
    """One tokenizer a worker process, whatever the number of its tasks."""
    if files not in _LOADED:
        _LOADED.clear()
        _LOADED[files] = ByteBpe(*files)
    return _LOADED[files]


def default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers

    return (
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def token_pieces(docs: DataFrame, tokenizer=default_tokenizer, window: int = WINDOW) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: full windows and rests.

    A document's ids are those of its text (null: empty) and one end id.
    ``tokenizer`` returns the files and the pattern where it runs.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(tokenizer())
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([bpe.ids(text.as_py() or ""), end])
                raw = memoryview(ids.tobytes())
                for start in range(0, len(ids), window):
                    length = min(window, len(ids) - start)
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc_id, start, length, crc, len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


class RoomTree:
    """Segment tree over remaining room 0..size: how many open window groups each leaf holds."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += change
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least room of ``need`` or more that some open window has."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> tuple[dict[int, list[tuple]], int]:
    """Best-fit decreasing over ``{length: pieces}``.

    Returns per length the segments ``(upto_rank, first_window, per_window,
    offset)`` in rank order, and the number of windows. Windows filled alike are
    kept as one group ``(first, how_many)``; placing splits a group at most once.
    """
    tree = RoomTree(window)
    open_groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    plan: dict[int, list[tuple]] = {}
    windows = 0

    def keep(room: int, first: int, many: int) -> None:
        if room and many:
            open_groups[room].append((first, many))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank, segments = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:
                # Each new window takes as many as it holds before the next one opens.
                each = window // length
                full, rest = divmod(left, each)
                if full:
                    segments.append((rank + full * each, windows, each, 0))
                    keep(window - each * length, windows, full)
                    windows += full
                    rank += full * each
                if rest:
                    segments.append((rank + rest, windows, rest, 0))
                    keep(window - rest * length, windows, 1)
                    windows += 1
                break
            first, many = open_groups[room].pop()
            tree.add(room, -1)
            # The tightest window stays the tightest one until it cannot take another.
            each = room // length
            full, rest = divmod(left, each)
            used = min(many, full)
            if used:
                rank += used * each
                segments.append((rank, first, each, window - room))
                left -= used * each
                keep(room - each * length, first, used)
            if used < many:
                if left:
                    rank += rest
                    segments.append((rank, first + used, rest, window - room))
                    keep(room - rest * length, first + used, 1)
                    left, used = 0, used + 1
                keep(room, first + used, many - used)
        plan[length] = segments
    return plan, windows


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is 1 to ``window``.

    The same pieces get the same places in every run. An empty table gives an
    empty result. Equal pieces are interchangeable.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    total = pieces.count()
    parts = max(LEAST_PARTS, -(-total // PART_ROWS))
    order = F.xxhash64(*[F.col(c) for c in pieces.columns])
    dealt = pieces.withColumn("__order", order).withColumn("__part", F.pmod(F.hash("__order"), F.lit(parts)).cast("int"))
    counted = dealt.groupBy("length", "__part").agg(F.count("*").alias("n")).collect()
    of_length: dict[int, int] = defaultdict(int)
    before = []
    for row in sorted(counted, key=lambda r: (r["length"], r["__part"])):
        before.append((row["length"], row["__part"], of_length[row["length"]]))
        of_length[row["length"]] += row["n"]
    plan, _ = best_fit_plan(dict(of_length), window)
    schema = "length long, __part int, __before long, __to array<struct<upto: long, first: long, each: long, offset: long>>"
    table = spark.createDataFrame([(length, part, n, plan[length]) for length, part, n in before], schema)
    # Rows that a part holds by chance more than others: at most PART_ROWS of one length on average.
    within = Window.partitionBy("length", "__part").orderBy("__order")
    ranked = dealt.withColumn("__rank", F.row_number().over(within).cast("long") - 1).join(table, ["length", "__part"])
    rank = F.col("__rank") + F.col("__before")
    ranked = ranked.withColumn("__rank", rank)
    segment = F.element_at(F.filter("__to", lambda s: F.col("__rank") < s["upto"]), 1)
    done = F.coalesce(F.array_max(F.transform(F.filter("__to", lambda s: F.col("__rank") >= s["upto"]), lambda s: s["upto"])), F.lit(0))
    ranked = ranked.withColumn("__segment", segment).withColumn("__in", F.col("__rank") - done)
    s = F.col("__segment")
    return ranked.select(
        *pieces.columns,
        (s["first"] + F.floor(F.col("__in") / s["each"])).alias("sequence_id"),
        (s["offset"] + F.col("__in") % s["each"] * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer=default_tokenizer, window: int = WINDOW) -> DataFrame:
    """All documents as pieces packed into sequences of at most ``window`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null text counts as empty (its end id is packed); repeated rows are
    packed as often as they come; other columns are ignored.
    """
    return pack(stored(token_pieces(docs, tokenizer, window), "token-pieces"), window)
