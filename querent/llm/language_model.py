"""Hashed maximum-entropy language model with a class-factored softmax.

Outcomes are those of the unigram base: the words of the training texts, the end
of a text, and unknown words. A token's probability is that of its class given
the history, times that of its bin given class and history, times that of the
word given its bin:

- classes: frequent words have one of their own, all others share one by their
  ending; the class follows a softmax over hashed features of the history
  (words, word pairs, endings, and words skipped over), trained by gradient
  updates made in parallel and averaged by Spark between rounds;
- bins of a class: its frequent words have one of their own, all others share
  one by their beginning; the bin follows a second softmax, over the same
  features together with the class, trained alike;
- a word that shares its bin: counts over all training tokens, discounted by what
  Good-Turing leaves to unknown words. The vocabulary grows with the input and the
  model does not, so this last factor knows no history.

Texts are read once into blocks of token numbers with the words they use. Counts
are joined by word to the distinct words of a block, never to single tokens, and
blocks are scored in numpy.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import shared_object
from querent.session import stored

HEAD = 39
ENDINGS = 24
CLASSES = HEAD + 1 + ENDINGS
SLOTS = 1 << 13
FEATURES = 6
#: Bins of a class: words with one of their own, and bins that the others share.
OWN = 48
SHARED = 16
BINS = OWN + SHARED
#: The most frequent words, which get classes and bins of their own as far as these reach.
FREQUENT = 4096
#: Rows of weights: features of the class, then features of the bin.
ROWS = 2 * SLOTS
#: The second softmax has few tokens a feature: it steps by mean gradients, damped by some tokens.
BIN_RATE, BIN_DAMPING, BIN_STEP_TOKENS = 2.0, 8.0, 2048
ROUNDS = 2
STEP_TOKENS = 8192
RATE = 0.25
BLOCK_BYTES = 8 << 20
#: Tokens whose exponents are made at a time; exponents below which none goes out of range.
NEAR_TOKENS, SAFE = 1024, 60.0
#: Slots with so many tokens that no more than this have as many are summed one by one.
FEW_SLOTS = 16
#: Tokens whose features are held at a time; texts are not split.
CHUNK_TOKENS = 1 << 16
#: A count and the place of its word in a block share one long; blocks hold under 2**21 words.
PLACE_BITS = 42
END = b""
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: What crc32 does with one more byte.
_CRC = np.array([zlib.crc32(bytes([255 ^ i])) ^ 0xFF000000 for i in range(256)], np.uint32)
BLOCK = (
    "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, tokens binary, "
    "words array<binary>, trained array<int>"
)


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split knows exactly the six white-space bytes."""
    return (text or "").encode(errors="replace").lower().split()


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``BLOCK_BYTES`` of text: a word list, and texts as places in it.

    Place 0 is the end of a text, which follows each.
    """
    schema = pa.schema(
        [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
         ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("trained", pa.list_(pa.int32()))]
    )

    def flush() -> pa.RecordBatch:
        all_tokens = np.concatenate(parts)
        lengths = [len(p) for p in parts]
        training = np.repeat(~np.array(held), lengths)
        trained = np.bincount(all_tokens[training], minlength=len(place)).astype(np.int32)
        raw = all_tokens.astype("<i4").tobytes()
        # the name of a block depends on its rows alone
        name = hashlib.blake2b(raw + repr(ids).encode(), digest_size=8)
        for word in place:
            name.update(word + b" ")
        block = int.from_bytes(name.digest(), "little", signed=True)
        row = [block, ids, held, lengths, zstandard.compress(raw, 1), list(place), trained.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    def numbering() -> dict[bytes, int]:
        """Gives a word that it does not hold the next number."""
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        numbers[END] = 0
        return numbers

    place = numbering()
    ids, held, parts, size = [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = tokens_of(text.as_py())
            found.append(END)
            numbers = np.fromiter(map(place.__getitem__, found), np.int32, len(found))
            ids.append(doc_id)
            held.append(held_out(doc_id))
            parts.append(numbers)
            size += 6 * len(numbers)
            if size >= BLOCK_BYTES:
                yield flush()
                place = numbering()
                ids, held, parts, size = [], [], [], 0
    if ids:
        yield flush()


def ending_class(word: bytes) -> int:
    return HEAD + 1 + zlib.crc32(word[-2:]) % ENDINGS


def shared_bin(word: bytes) -> int:
    return OWN + zlib.crc32(word[:3]) % SHARED


class Model:
    """Weights and constants of the model; of fixed size, whatever the corpus.

    Tokens and types are counted by class and bin, or by class alone if no word
    has a bin of its own: then all share the last bin.
    """

    def __init__(self, head: list[bytes], tokens: np.ndarray, types: np.ndarray, discount: float, own: dict[bytes, int] | None = None):
        self.head = {w: i + 1 for i, w in enumerate(head)}
        self.own = own or {}
        self.tokens, self.types = np.zeros((CLASSES, BINS)), np.zeros((CLASSES, BINS))
        at = slice(None) if np.ndim(tokens) == 2 else (slice(None), -1)
        self.tokens[at], self.types[at] = tokens, types
        self.discount = discount
        by_class = self.tokens.sum(axis=1) + 0.5
        self.weights = np.zeros((ROWS, CLASSES), np.float32)
        self.bias = np.log(by_class / by_class.sum()).astype(np.float32)
        # bins of their own that no word has are no outcomes
        some = np.where((self.types > 0) | (np.arange(BINS) >= OWN), self.tokens + 0.5, 1e-13)
        self.bin_bias = np.log(some / some.sum(axis=1, keepdims=True)).astype(np.float32)
        # what a bin leaves to unknown words
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(self.tokens > 0, discount * self.types / self.tokens, 1.0)
        self.unknown = np.where(np.arange(BINS) < OWN, 0.0, left)

    def classes(self, words: list[bytes], tails: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Class of each word of a block, given the crc32 of its ending; the end of a text is class 0.

        ``own``: places among which all words with a class of their own are.
        """
        return self._placed(words, HEAD + 1 + tails % ENDINGS, self.head, own, 0)

    def bins(self, words: list[bytes], beginnings: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Bin of each word of a block within its class, given the crc32 of its beginning. ``own`` as for classes."""
        return self._placed(words, OWN + beginnings % SHARED, self.own, own)

    @staticmethod
    def _placed(words: list[bytes], shared: np.ndarray, own: dict[bytes, int], among: np.ndarray | None, end: int | None = None) -> np.ndarray:
        for i in range(len(words)) if among is None else among.tolist():
            place = own.get(words[i])
            if place is not None:
                shared[i] = place
        if end is not None:
            shared[0] = end
        return shared

    def perhaps_own(self, crc: np.ndarray) -> np.ndarray:
        """Places of the words, by their crc32, that may have a class or a bin of their own: all that have, and few others."""
        some = np.zeros(1 << 16, bool)
        some[np.array([zlib.crc32(w) & 0xFFFF for known in (self.head, self.own) for w in known], np.int64)] = True
        return np.flatnonzero(some[crc & 0xFFFF])


def crc32_of_parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of the last two and of the first three bytes of each word, byte by byte for all at once."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    start, length = ends[:-1], np.diff(ends)
    out = []
    for first, size in ((np.maximum(length - 2, 0), np.minimum(length, 2)), (np.zeros_like(length), np.minimum(length, 3))):
        crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
        for k in range(3):
            some = np.flatnonzero(size > k)
            crc[some] = _CRC[(crc[some] ^ data[(start + first)[some] + k]) & np.uint32(0xFF)] ^ (crc[some] >> np.uint32(8))
        out.append((crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64))
    return out[0], out[1]


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def history_slots(word_hash: np.ndarray, ending_hash: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashed features of the history of every token, tokens x ``FEATURES``.

    The last word, the last two, the one before the last (skipping one), the one
    two before (skipping two), the last ending, and the last two endings. Before a
    text stands its end.
    """
    w, e = word_hash[tokens], ending_hash[tokens]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(len(tokens)) - np.repeat(starts, lengths)

    def back(values: np.ndarray, k: int) -> np.ndarray:
        moved = np.concatenate([np.zeros(k, np.uint64), values[:-k]]) if len(values) > k else np.zeros(len(values), np.uint64)
        moved[at < k] = 0
        return moved

    w1, w2, w3, e1, e2 = back(w, 1), back(w, 2), back(w, 3), back(e, 1), back(e, 2)
    kinds = (w1 + np.uint64(1), w1 * _GOLD + w2 + np.uint64(2), w2 + np.uint64(3), w3 + np.uint64(4), e1 + np.uint64(5), e1 * _GOLD + e2 + np.uint64(6))
    out = np.empty((len(tokens), FEATURES), np.uint16)
    for k, kind in enumerate(kinds):
        out[:, k] = (_spread(kind * _GOLD + np.uint64(k)) >> np.uint64(20)) & np.uint64(SLOTS - 1)
    return out


def chunks(tokens: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Texts of a block in groups of about ``CHUNK_TOKENS``: their places among tokens and among texts."""
    ends = np.cumsum(lengths)
    first, start = 0, 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, start + CHUNK_TOKENS, side="right")))
        yield slice(start, int(ends[last - 1])), slice(first, last)
        first, start = last, int(ends[last - 1])


def block_hashes(words: list[bytes], tails: np.ndarray | None = None, crc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their endings, from the crc32 of the endings and of the words if these are known."""
    if tails is None:
        tails = crc32_of_parts(pa.array(words, pa.binary()))[0]
    if crc is None:
        crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    return _spread((crc.astype(np.uint64) + np.uint64(1)) * _GOLD), _spread((tails.astype(np.uint64) + np.uint64(7)) * _GOLD)


def block_words(model: Model, column: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Hashes, classes and bins of the words of a block."""
    words = column.to_numpy(zero_copy_only=False).tolist()
    crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    tails, beginnings = crc32_of_parts(column)
    own = model.perhaps_own(crc)
    return block_hashes(words, tails, crc), model.classes(words, tails, own), model.bins(words, beginnings, own)


def bin_slots(slots: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of weights for the bin: each feature of the history with the class."""
    mixed = (_spread((classes.astype(np.uint64) + np.uint64(1)) * _GOLD) % np.uint64(SLOTS)).astype(np.uint16)
    return (slots ^ mixed[:, None]) + np.uint16(SLOTS)


def raised(
    weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, classes: np.ndarray | None = None, out: np.ndarray | None = None
) -> Iterator[tuple[slice, np.ndarray]]:
    """Exponents of the softmax of some tokens; those of a token may differ from the sums by a constant.

    ``slots``: features x tokens. With ``classes``, ``bias`` has a row for each
    class. Tokens come as many at a time as stay near the processor, with their
    places; without ``out`` the next ones overwrite them.
    """
    count = slots.shape[1]
    taken = np.empty((min(NEAR_TOKENS, count), CLASSES), np.float32)
    own = np.empty_like(taken) if out is None else out
    for start in range(0, count, NEAR_TOKENS):
        places = slice(start, min(start + NEAR_TOKENS, count))
        at = slots[:, places]
        rows, more = own[: at.shape[1]] if out is None else out[places], taken[: at.shape[1]]
        weights.take(at[0], 0, rows, "clip")
        for one in at[1:]:
            weights.take(one, 0, more, "clip")
            rows += more
        if classes is None:
            rows += bias
        else:
            bias.take(classes[places], 0, more, "clip")
            rows += more
        # sums that no exponential takes out of range need no shift
        if not -SAFE < rows.min() <= rows.max() < SAFE:
            rows -= rows.max(axis=1, keepdims=True)
        yield places, rows


def by_feature(slots: np.ndarray) -> np.ndarray:
    """Features x tokens, as places that need no conversion where they are used."""
    return np.ascontiguousarray(slots.T, dtype=np.intp)


def row_sums(rows: np.ndarray) -> np.ndarray:
    """Without BLAS, whose threads wait busily for so short a sum."""
    return np.einsum("ij->i", rows)


def column_sums(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij->j", rows)


def log_softmax(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    score = np.empty((len(slots), CLASSES), np.float32)
    for _, rows in raised(weights, bias, by_feature(slots), classes, score):
        rows -= np.log(row_sums(np.exp(rows)))[:, None]
    return score


def log_chosen(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, goals: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """``log_softmax`` of the goal of each token only."""
    found = np.empty(len(goals), np.float32)
    for places, rows in raised(weights, bias, by_feature(slots), classes):
        chosen = rows[np.arange(len(rows)), goals[places]]
        found[places] = chosen - np.log(row_sums(np.exp(rows, out=rows)))
    return found


def summed_by_slot(gradient: np.ndarray, slots: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Gradients of the tokens of each slot of each feature, summed.

    ``slots``: features x tokens, all of one softmax. Returns the sums, their
    slots, the places of each feature's sums, and how many tokens are in each. Sums
    stand by their number of tokens, the most first, so that the first, second,
    third ... tokens of all that have one are added at once. ``room``: where sums
    and what is added to them may stand, a row for each slot of each token and one
    for each token; sums are good until it is used again.
    """
    features, count = slots.shape
    if room is None:
        room = np.empty(((features + 1) * count, gradient.shape[1]), np.float32)
    each = np.arange(features)[:, None]
    # features times slots of a softmax are below 2**16: one sort by feature and slot
    key = ((slots & (SLOTS - 1)) + each * SLOTS).astype(np.uint16).ravel()
    order = np.argsort(key, kind="stable")
    size = np.bincount(key, minlength=features * SLOTS)
    having = np.flatnonzero(size > 0)
    size = size[having]
    first = np.cumsum(size) - size
    hit = slots.ravel()[order[first]]
    order = (order.reshape(features, count) - each * count).ravel()
    by_size = np.argsort((count - size).astype(np.uint16), kind="stable")
    place = np.empty_like(by_size)
    place[by_size] = np.arange(len(by_size))
    of_feature = np.split(place, np.searchsorted(having, np.arange(1, features) * SLOTS))
    first, hit, size = first[by_size], hit[by_size], size[by_size]
    total, added, near = room[: len(size)], room[-count:], min(NEAR_TOKENS, count)
    gradient.take(order[first], 0, total, "clip")
    having = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")
    for nth in range(1, size[0]):
        some = having[nth]
        if some <= FEW_SLOTS:
            for i in range(some):
                rest = order[first[i] + nth : first[i] + size[i]]
                total[i] += column_sums(gradient.take(rest, 0, added[: len(rest)], "clip"))
            break
        for start in range(0, some, near):
            at = slice(start, min(start + near, some))
            total[at] += gradient.take(order[first[at] + nth], 0, added[: at.stop - start], "clip")
    return total, hit, of_feature, size


def _rows(table: np.ndarray) -> np.ndarray:
    """Rows as single items, which numpy puts in place faster."""
    return table.view(np.dtype((np.void, table.shape[1] * table.itemsize)))[:, 0]


def local_updates(
    model: Model, weights: np.ndarray, bias: np.ndarray, slots: np.ndarray, goals: np.ndarray, power: np.ndarray, classes: np.ndarray | None = None
) -> None:
    """AdaGrad steps over the tokens of a block, in place. ``power`` sums squared gradients by slot.

    With ``classes``, goals are bins, ``bias`` has a row for each class and stays
    as it is, and ``power`` counts tokens by slot.
    """
    size = min(STEP_TOKENS if classes is None else BIN_STEP_TOKENS, max(1, len(goals)))
    places, held_rows = by_feature(slots), _rows(weights)
    held = np.empty((size, CLASSES), np.float32)
    room = np.empty(((len(places) + 1) * size, CLASSES), np.float32)
    for start in range(0, len(goals), size):
        part, goal = places[:, start : start + size], goals[start : start + size]
        gradient = held[: len(goal)]
        for at, rows in raised(weights, bias, part, None if classes is None else classes[start : start + size], gradient):
            np.exp(rows, out=rows)
            rows *= (1 / row_sums(rows))[:, None]
            rows.ravel()[np.arange(len(rows)) * CLASSES + goal[at]] -= 1
        if classes is None:
            bias -= RATE * 0.1 * (column_sums(gradient) / np.float32(len(goal)))
        summed, hit, of_feature, many = summed_by_slot(gradient, part, room)
        more = np.einsum("ij,ij->i", summed, summed) / np.float32(CLASSES) if classes is None else many
        rate = np.empty(len(hit), np.float32)
        for at in of_feature:
            own = hit[at]
            power[own] += more[at]
            rate[at] = RATE / np.sqrt(power[own] + 1.0) if classes is None else BIN_RATE / (power[own] + BIN_DAMPING)
        summed *= rate[:, None]
        for at in of_feature:
            # a feature has no more slots than tokens, and the gradient is summed
            own, step, old = hit[at], gradient[: len(at)], room[-len(goal) :][: len(at)]
            held_rows[own] = _rows(np.subtract(weights.take(own, 0, old, "clip"), summed.take(at, 0, step, "clip"), out=step))


def _trainer(shared):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        weights, bias = model.weights.copy(), model.bias.copy()
        power, seen, total = np.zeros(ROWS, np.float32), np.zeros(ROWS, np.float64), 0
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column(2)[i].values.to_numpy()
                tokens = np.frombuffer(zstandard.decompress(batch.column(3)[i].as_py()), "<i4")
                hashes, classes, bins = block_words(model, batch.column(4)[i].values)
                learn = ~np.array(batch.column(1)[i].as_py(), bool)
                for part, of in chunks(tokens, lengths):
                    use = np.repeat(learn[of], lengths[of])
                    slots = history_slots(*hashes, tokens[part], lengths[of])[use]
                    goals = classes[tokens[part][use]]
                    local_updates(model, weights, bias, slots, goals, power)
                    seen += np.bincount(slots.ravel(), minlength=ROWS)
                    total += len(slots)
                    inner = goals > HEAD
                    slots = bin_slots(slots[inner], goals[inner])
                    local_updates(model, weights, model.bin_bias, slots, bins[tokens[part][use][inner]], power, goals[inner])
                    seen += np.bincount(slots.ravel(), minlength=ROWS)
        if total:
            moved = weights - model.weights
            slots = np.flatnonzero(seen)
            sent = np.vstack([moved[slots] * seen[slots, None].astype(np.float32), (bias - model.bias) * np.float32(total)]).astype("<f4")
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * CLASSES), len(sent), [None, pa.py_buffer(sent)])
            rows = pa.RecordBatch.from_arrays(
                [pa.array(np.append(slots, -1), pa.int32()), pa.array(np.append(seen[slots], total), pa.float64()),
                 raw.cast(pa.binary())],
                names=["slot", "seen", "moved"],
            )
            yield from (rows.slice(i, 1024) for i in range(0, rows.num_rows, 1024))

    return train


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum what the tasks moved, by slot; a partition holds whole slots."""
    seen: dict[int, float] = {}
    moved: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            seen[slot] = seen.get(slot, 0.0) + n
            moved[slot] = moved.get(slot, 0) + np.frombuffer(raw, "<f4").astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.int32()), pa.array([(moved[s] / seen[s]).astype("<f4").tobytes() for s in seen], pa.binary())],
        names=["slot", "moved"],
    )


def train_classes(blocks: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Rounds of local gradient updates, averaged by slot; each round sees its own part of the blocks.

    One epoch over all training tokens. What a task sends is of fixed size, as is
    what the driver gathers: one row for each slot.
    """
    spark = blocks.sparkSession
    needed = blocks.select("block", "held", "lengths", "tokens", "words")
    for turn in range(rounds):
        shared = shared_object(spark, model)
        own = needed.filter(F.pmod("block", F.lit(rounds)) == turn)
        sent = own.mapInArrow(_trainer(shared), "slot int, seen double, moved binary")
        means = sent.repartition(8, "slot").mapInArrow(_summed, "slot int, moved binary").toArrow()
        for slot, raw in zip(means.column("slot").to_pylist(), means.column("moved").to_pylist()):
            change = np.frombuffer(raw, "<f4")
            if slot < 0:
                model.bias = model.bias + change
            else:
                model.weights[slot] += change
        shared.unpersist()
    return model


def text_blocks(docs: DataFrame) -> DataFrame:
    """Stored blocks of all texts of ``docs`` (doc_id, text)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(read.mapInArrow(_as_blocks, BLOCK), "lm-blocks")


def word_counts(blocks: DataFrame) -> DataFrame:
    """``(word, c)`` over all training tokens. A word comes once per block, so none is hot."""
    each = blocks.select(F.explode(F.arrays_zip("words", "trained")).alias("w")).select("w.*").filter("trained > 0")
    return each.groupBy(F.col("words").alias("word")).agg(F.sum("trained").cast("long").alias("c"))


def _start(counts: DataFrame) -> tuple[Model, int, int]:
    """An untrained model, the training tokens and the known words, from the counts."""
    words = counts.filter(F.length("word") > 0)
    frequent = [(bytes(r["word"]), r["c"]) for r in words.orderBy(F.col("c").desc(), "word").limit(FREQUENT).collect()]
    tail = F.when(F.length("word") > 2, F.expr("substring(word, length(word) - 1, 2)")).otherwise(F.col("word"))
    by_form = counts.withColumn("class", F.when(F.length("word") == 0, 0).otherwise(F.crc32(tail) % ENDINGS + HEAD + 1).cast("int"))
    by_form = by_form.withColumn("bin", (F.crc32(F.expr("substring(word, 1, 3)")) % SHARED + OWN).cast("int"))
    sums = by_form.groupBy("class", "bin").agg(
        F.sum("c").alias("tokens"), F.count("*").alias("types"),
        F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("twice"),
    ).collect()
    tokens, types = np.zeros((CLASSES, BINS)), np.zeros((CLASSES, BINS))
    for r in sums:
        tokens[r["class"], r["bin"]], types[r["class"], r["bin"]] = r["tokens"], r["types"]
    # frequent words move from where their form puts them to places of their own
    head, own, used = [w for w, _ in frequent[:HEAD]], {}, np.zeros(CLASSES, int)
    for i, (word, c) in enumerate(frequent):
        cell = ending_class(word)
        if i < HEAD:
            place = i + 1, BINS - 1
        elif used[cell] < OWN:
            place = cell, used[cell]
            own[word] = int(used[cell])
            used[cell] += 1
        else:
            continue
        for table, n in ((tokens, c), (types, 1)):
            table[cell, shared_bin(word)] -= n
            table[place] += n
    once, twice = sum(r["once"] for r in sums), sum(r["twice"] for r in sums)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    return Model(head, tokens, types, discount, own), int(tokens.sum()), int(types.sum())


def within_class(model: Model, classes: np.ndarray, c: np.ndarray, bins: np.ndarray | int = BINS - 1) -> np.ndarray:
    """log10 probability of each word in its bin: discounted counts, the rest for unknown words.

    A frequent word is alone in its class or bin; unknown words of a bin without
    any word have it to themselves.
    """
    tokens = model.tokens[classes, bins]
    alone = (classes <= HEAD) | (np.asarray(bins) < OWN)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(c > 0, (c - model.discount) / tokens, model.unknown[classes, bins])
    return np.where(alone, 0.0, np.log10(np.maximum(p, 1e-300)))


def log_bins(model: Model, slots: np.ndarray, classes: np.ndarray, bins: np.ndarray, own: np.ndarray, known: np.ndarray) -> np.ndarray:
    """log10 probability of words given their class and history. ``own``: of each in its bin.

    Unknown words are one outcome of their class: what all its bins leave.
    """
    slots = bin_slots(slots, classes)
    out = log_chosen(model.weights, model.bin_bias, slots, bins, classes) / math.log(10) + own
    new = np.flatnonzero(~known)
    found = log_softmax(model.weights, model.bin_bias, slots[new], classes[new])
    left = (np.exp(found) * model.unknown[classes[new]]).sum(axis=1)
    out[new] = np.log10(np.maximum(left, 1e-300))
    return out


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, class_score double"
)


def _scorer(shared, train_tokens: int, known_words: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column(2)[i].values.to_numpy()
                tokens = np.frombuffer(zstandard.decompress(batch.column(3)[i].as_py()), "<i4")
                hashes, classes, bins = block_words(model, batch.column(4)[i].values)
                c, known = np.zeros(len(classes)), batch.column(5)[i].values.to_numpy()
                c[known >> PLACE_BITS] = known & ((1 << PLACE_BITS) - 1)
                base = np.log10((c + 1) / (train_tokens + known_words + 1))
                own = within_class(model, classes, c, bins)
                by_class, inside = np.empty(len(tokens)), np.zeros(len(tokens))
                for part, of in chunks(tokens, lengths):
                    slots, places, found = history_slots(*hashes, tokens[part], lengths[of]), tokens[part], by_class[part]
                    goal = classes[places]
                    for start in range(0, len(goal), STEP_TOKENS):
                        step = slice(start, start + STEP_TOKENS)
                        found[step] = log_chosen(model.weights, model.bias, slots[step], goal[step]) / math.log(10)
                    inner = np.flatnonzero(goal > HEAD)
                    for start in range(0, len(inner), STEP_TOKENS):
                        step = inner[start : start + STEP_TOKENS]
                        at = places[step]
                        inside[part][step] = log_bins(model, slots[step], goal[step], bins[at], own[at], c[at] > 0)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                total = lambda values: np.add.reduceat(values, starts)
                class_score = total(by_class)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(6)[i].values, batch.column(1)[i].values, pa.array(lengths, pa.int64()), pa.array(total((c > 0)[tokens].astype(np.int64)), pa.int64()),
                     pa.array(np.full(len(lengths), train_tokens), pa.int64()), pa.array(total(base[tokens])), pa.array(class_score + total(inside)), pa.array(class_score)],
                    names=[f.split()[0] for f in SCORES.split(", ")],
                )

    return score


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Base and model scores of every whole text of ``docs`` (doc_id, text), learned from those not held out.

    A null text counts as empty (its end is a token); repeated rows are scored
    alike and count as often as they come; other columns are ignored. Without
    training tokens the base knows no word and the model only its classes. An
    empty table gives an empty result.
    """
    blocks = text_blocks(docs)
    counts = stored(word_counts(blocks), "lm-counts")
    model, train_tokens, known_words = _start(counts)
    model = train_classes(blocks, model, rounds)
    used = blocks.select("block", F.posexplode("words").alias("place", "word"))
    packed = F.shiftleft(F.col("place").cast("long"), PLACE_BITS).bitwiseOR(F.col("c"))
    known = used.join(counts, "word").select("block", packed.alias("known"))
    lists = known.groupBy("block").agg(F.collect_list("known").alias("known"))
    whole = blocks.select("block", "held", "lengths", "tokens", "words", "doc_ids").join(lists, "block", "left")
    none = F.array().cast("array<long>")
    whole = whole.select("block", "held", "lengths", "tokens", "words", F.coalesce("known", none).alias("known"), "doc_ids")
    shared = shared_object(docs.sparkSession, model)
    return whole.mapInArrow(_scorer(shared, train_tokens, known_words), SCORES)
