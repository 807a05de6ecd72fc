"""Near-duplicates by ProbMinHash.

Texts are weighted sets of five-word shingles; weights are counts. Each shingle
sends arrivals of a Poisson process with its weight as rate to random registers;
a register keeps its earliest arrival, and a shingle stops once its next arrival
is later than all registers of its text. Two texts agree in a register with the
probability of their probability Jaccard similarity

    J = sum over common d of 1 / sum over d' of max(a[d'] / a[d], b[d'] / b[d]).

Registers are banded. Texts that share a band are candidates: each is compared
exactly with the text of its buckets that meets most others; candidates whose
classes still differ then meet in bounded blocks, by more registers first and exactly if those leave
room for the threshold. Classes are the connected components of the pairs that
reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import fresh
from querent.session import stored

SHINGLE = 5
THRESHOLD = 0.8
#: Pairs at similarity 0.8 share no band with a probability of 5e-6.
BANDS, ROWS = 40, 6
#: Registers of the second sketch, of which four bits each are kept.
SHARP = 1024
#: Fewer agreeing registers than this a pair at 0.8 shows with a probability of 3e-7.
SHARP_DEVIATIONS = 5.0
BLOCK_TEXTS = 128
BLOCK_SKETCHES = 1024
CHUNK = 1 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK // 4)
        tables = []
        for base in (_PRIME, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a UTF-8 text, and where they start."""
    b = np.frombuffer(data, np.uint8)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _power_tables(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    raw = (sums[end] - sums[start]) * down[start]
    return mixed(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def text_words(data: bytes) -> np.ndarray:
    """Word hashes of one text of any length; long texts are cut between words."""
    if len(data) <= CHUNK:
        return word_hashes(data)[0]
    parts, at = [], 0
    while at < len(data):
        upto = at + CHUNK
        while upto < len(data) and data[upto] not in b" \t\n\x0b\x0c\r":
            upto += 1
        parts.append(word_hashes(data[at:upto])[0])
        at = upto
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for every five words in a row; a shorter text is one shingle."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(_PRIME) + words[k : k + len(total)])
    return total


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets ``(sorted keys, counts)``."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    wa, wb = a[1][ia].astype(float), b[1][ib].astype(float)
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    ratio = wa / wb
    if (ratio == ratio[0]).all():
        common = len(wa) if ratio[0] == 1 and (wa == 1).all() else None
        if common is not None:
            return common / (common + only_a + only_b)
    order = np.argsort(ratio, kind="stable")
    wa, wb, ratio = wa[order], wb[order], ratio[order]
    # d' with a greater ratio count by a, those with a smaller or equal one by b
    up_to = np.searchsorted(ratio, ratio, side="right")
    sum_a, sum_b = np.concatenate([[0], np.cumsum(wa)]), np.concatenate([[0], np.cumsum(wb)])
    by_a = sum_a[-1] - sum_a[up_to] + only_a
    by_b = sum_b[up_to] + only_b
    return float((1 / (by_a / wa + by_b / wb)).sum())


def weighted_shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    data = (text or "").encode(errors="surrogatepass")
    return np.unique(shingle_hashes(text_words(data)), return_counts=True)


def registers(owner: np.ndarray, keys: np.ndarray, weight: np.ndarray, texts: int, many: int) -> np.ndarray:
    """The ProbMinHash registers of ``texts`` weighted sets given as one list of elements.

    A register holds the bits of its earliest arrival time and, below, bits of
    the shingle that arrived. Arrivals go round by round; elements whose next
    arrival is later than every register of their text stop.
    """
    held = np.full(texts * many, EMPTY, np.uint64)
    time = np.zeros(len(keys))
    turn = 0
    while len(keys):
        turn += 1
        bits = mixed(keys + np.uint64(turn * _PRIME & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        register = (mixed(bits) % np.uint64(many)).astype(np.int64)
        arrival = time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        np.minimum.at(held, owner * many + register, arrival | (keys & np.uint64(0xFFFFFFFF)))
        latest = (held.reshape(texts, many).max(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.float32)
        limit = np.where(np.isnan(latest), np.inf, latest)
        go_on = time <= limit[owner]
        owner, keys, weight, time = owner[go_on], keys[go_on], weight[go_on], time[go_on]
    return held.reshape(texts, many)


def band_hashes(held: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of the shingles that hold its registers."""
    values = (held & np.uint64(0xFFFFFFFF)).reshape(len(held), bands, rows)
    total = np.tile(np.arange(bands, dtype=np.uint64), (len(held), 1))
    for k in range(rows):
        total = mixed(total * np.uint64(_PRIME) + values[:, :, k])
    return total.view(np.int64)


def _sketched(bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                size, stop = 0, at
                group: list[bytes] = []
                while stop < len(texts) and (not group or size < CHUNK):
                    group.append((texts[stop].as_py() or "").encode(errors="surrogatepass"))
                    size += len(group[-1])
                    stop += 1
                sets = [np.unique(shingle_hashes(text_words(data)), return_counts=True) for data in group]
                owner = np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])
                held = registers(owner, np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets]).astype(float), len(sets), bands * rows)
                hashes = band_hashes(held, bands, rows)
                lists = [h.tolist() if len(k) else [] for h, (k, _) in zip(hashes, sets)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, stop - at), batch.column(2).slice(at, stop - at), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "digest", "bands"]
                )
                at = stop

    return sketch


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, digest, bands)`` of every whole text; no digest for null, no bands without words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest(F.col("text")).alias("digest"))
    return texts.mapInArrow(_sketched(bands, rows), "doc_id long, digest binary, bands array<long>")


def text_digest(text):
    """SHA-256 of the UTF-8 text, in Spark, so texts can be found again by it; null for null."""
    return F.unhex(F.sha2(text, 256))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key (the first column) at a time, from a partition sorted by it."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            if start < end:
                if held and keys[start] != key:
                    yield pa.Table.from_batches(held)
                    held = []
                key = keys[start]
                held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _compared(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            texts, sets, near = {}, {}, ([], [])
            for a, b, text in zip(*(run.column(i).to_pylist() for i in (2, 3, 4))):
                if b is None:
                    texts[a] = text
                    continue
                for end in (a, b):
                    if end not in sets:
                        sets[end] = weighted_shingles(texts[end])
                if similarity(sets[a], sets[b]) >= threshold - 1e-9:
                    near[0].append(a)
                    near[1].append(b)
            if near[0]:
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()) for n in near], names=["a", "b"])

    return compare


def similar_pairs(pairs: DataFrame, texts: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of ``pairs`` (a, b) those whose texts reach the threshold.

    ``texts`` is (doc_id, text) and ``blocks`` (node, block), one row an id. The
    pairs between two blocks are compared in one place, where each text of theirs
    comes once; blocks hold about ``BLOCK_TEXTS`` texts.
    """
    placed = pairs.join(blocks.select(F.col("node").alias("a"), F.col("block").alias("block_a")), "a")
    placed = placed.join(blocks.select(F.col("node").alias("b"), F.col("block").alias("block_b")), "b")
    meeting = F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b"))
    placed = placed.select(meeting.alias("meeting"), "a", "b")
    needed = placed.select("meeting", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(texts, "doc_id")
    empty = F.lit(None)
    rows = needed.select("meeting", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), empty.cast("long").alias("b"), "text")
    rows = rows.unionByName(placed.select("meeting", F.lit(1).alias("kind"), "a", "b", empty.cast("string").alias("text")))
    return rows.repartition("meeting").sortWithinPartitions("meeting", "kind").mapInArrow(_compared(threshold), "a long, b long")


def _sharp_sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            # up to 256 texts, and no more than CHUNK bytes beyond the first
            reach = np.cumsum(lengths[start : start + 256])
            stop = start + max(1, int(np.searchsorted(reach, CHUNK, side="right")))
            part = batch.slice(start, stop - start)
            start = stop
            sets = [weighted_shingles(t.as_py()) for t in part.column(1)]
            owner = np.repeat(np.arange(len(sets)), [len(k) for k, _ in sets])
            keys = mixed(np.concatenate([k for k, _ in sets]) + np.uint64(_PRIME))
            held = registers(owner, keys, np.concatenate([w for _, w in sets]).astype(float), len(sets), SHARP)
            bits = (held & np.uint64(15)).astype(np.uint8)
            packed = bits[:, ::2] | bits[:, 1::2] << 4
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([row.tobytes() for row in packed], pa.binary())], names=["member", "sharp"])


def _sifted(threshold: float, nearest: bool):
    """Pairs of different classes that meet in their first common band and agree in enough registers.

    ``nearest``: of the pairs of one meeting only those that are the best of one of their texts.
    """
    expected = threshold + (1 - threshold) / 16
    enough = SHARP * expected - SHARP_DEVIATIONS * np.sqrt(SHARP * expected * (1 - expected))

    def meetings(run: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        bucket, band, same, block, member, root = (run.column(i).to_numpy() for i in range(1, 7))
        bands = np.array(run.column(7).to_pylist(), dtype=np.int64)
        sharp = np.frombuffer(b"".join(run.column(8).to_pylist()), np.uint8).reshape(run.num_rows, -1)
        for start in range(0, run.num_rows, 64):
            rows = slice(start, start + 64)
            equal = bands[rows, None, :] == bands[None, :, :]
            meet = equal.argmax(axis=2) == band[rows, None]
            meet &= (bucket[rows, None] == bucket[None]) & (root[rows, None] != root[None])
            meet &= (member[rows, None] < member[None]) & ((block[rows, None] == block[None]) == same[rows, None])
            x, y = np.nonzero(meet)
            x += start
            for at in range(0, len(x), 4096):
                i, j = x[at : at + 4096], y[at : at + 4096]
                differ = sharp[i] ^ sharp[j]
                agree = (differ & 15 == 0).sum(axis=1) + (differ >> 4 == 0).sum(axis=1)
                keep = agree >= enough
                yield member[i[keep]], member[j[keep]], agree[keep]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            found = list(meetings(run)) if run.num_rows > 1 else []
            a, b, agree = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            if nearest and len(a):
                order = np.argsort(-agree, kind="stable")
                a, b = a[order], b[order]
                chosen = np.union1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])
                a, b = a[chosen], b[chosen]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return sift


def _centres(shared: DataFrame) -> DataFrame:
    """``(node, centre)``: of the texts that a text shares buckets with, the one that meets most texts.

    ``shared`` is (bucket, member, n), n the members of the bucket. Copies that were
    changed each in its own way are nearer to what they were made from than to each
    other, and that text meets more of them than any copy does: compared with it
    they join one class, and no pairs between copies are left to compare.
    """
    meets = shared.groupBy("member").agg(F.sum("n").alias("meets"))
    most = F.max(F.struct("meets", (-F.col("member")).alias("least"))).alias("most")
    heads = shared.join(meets, "member").groupBy("bucket").agg(most).select("bucket", "most.*")
    centres = shared.select("bucket", "member").join(heads, "bucket").groupBy("member")
    return centres.agg(F.max(F.struct("meets", "least")).alias("most")).select(F.col("member").alias("node"), (-F.col("most.least")).alias("centre"))


def _several(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several classes, with the number of blocks of the bucket."""
    rooted = shared.join(roots.withColumnRenamed("node", "member"), "member").select("bucket", "band", "member", "root")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high")
    several = several.select("bucket", F.ceil(F.col("n") / BLOCK_SKETCHES).cast("int").alias("blocks"))
    return stored(rooted.join(several, "bucket"), "near-several")


def _sharp(members: DataFrame, texts: DataFrame, bands: DataFrame) -> DataFrame:
    """``(member, bands, sharp)``: the second sketch of the texts that still have to be compared."""
    texts = texts.withColumnRenamed("doc_id", "member").join(members.select("member").distinct(), "member", "left_semi")
    made = texts.select("member", "text").mapInArrow(_sharp_sketched, "member long, sharp binary")
    return stored(made.join(bands.withColumnRenamed("text_id", "member"), "member"), "near-sharp")


def _across(rows: DataFrame, sharp: DataFrame, threshold: float, nearest: bool) -> DataFrame:
    """Likely pairs of one bucket whose classes differ, each once.

    Buckets of several classes are cut into blocks by a hash of their members; two
    blocks meet in one place, so no place holds more than two blocks, and only the
    pairs that may reach the threshold become rows.
    """
    block = F.pmod(F.hash("member"), F.col("blocks"))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select(
        F.xxhash64("bucket", low, high).alias("meeting"), "bucket", "band", (low == high).alias("same"), F.col("block").cast("long").alias("block"), "member", "root"
    ).join(sharp, "member")
    rows = rows.select("meeting", "bucket", "band", "same", "block", "member", "root", "bands", "sharp")
    return rows.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_sifted(threshold, nearest), "a long, b long")


def _roots(current: DataFrame, links: DataFrame) -> DataFrame:
    """``current`` (node, root) after joining the classes that ``links`` (a, b) connect; the least root stays.

    Links between nodes become links between roots. In each round a root moves to
    the least of its neighbours, then to the root of that root; links inside a
    class go. Rounds grow with the logarithm of a component's width. Tables are
    written between rounds, so lineage stays short.
    """
    ends = links.join(current.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a")
    ends = ends.join(current.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b")
    while True:
        between = ends.filter("root_a <> root_b").select(F.greatest("root_a", "root_b").alias("root"), F.least("root_a", "root_b").alias("to"))
        between = stored(between.distinct(), "class-links")
        if between.isEmpty():
            return current
        moves = stored(between.groupBy("root").agg(F.min("to").alias("to")), "class-moves")
        while True:
            further = moves.select(F.col("root").alias("to"), F.col("to").alias("further"))
            jumped = moves.join(further, "to", "left").select("root", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
            jumped = stored(jumped, "class-moves")
            moves = jumped.select("root", "to")
            if jumped.filter("moved").isEmpty():
                break
        current = stored(current.join(moves, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "classes")
        high, low = (moves.select(F.col("root").alias(end), F.col("to").alias(f"{end}_to")) for end in ("root", "to"))
        ends = between.join(high, "root", "left").join(low, "to", "left")
        ends = ends.select(F.coalesce("root_to", "root").alias("root_a"), F.coalesce("to_to", "to").alias("root_b"))


def _classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """``near_duplicate_classes`` with ``digest``, ``class_node`` and ``text_node``.

    Equal texts are folded first. Every text is compared with one text of its
    buckets, see ``_centres``; that makes no more pairs than texts. Texts that share a
    bucket although their classes differ then meet in blocks, see ``_across``:
    once for the nearest partner of each, then for all that is left.
    """
    prints = stored(sketches(docs, bands, band_rows), "sketches")
    texts = prints.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    equal = texts.groupBy("digest").agg(F.min("doc_id").alias("text_id"))
    # A node is a distinct text, numbered once and stored; one id with two texts
    # makes two nodes. Classes are named by the least id of their texts at the end.
    equal = stored(equal.select("digest", "text_id", F.monotonically_increasing_id().alias("node")), "equal-texts")
    first = texts.join(equal, (F.col("doc_id") == F.col("text_id")) & texts["digest"].eqNullSafe(equal["digest"])).select("node", "bands")
    first = first.groupBy(F.col("node").alias("text_id")).agg(F.first("bands").alias("bands"))
    members = stored(first.select(F.posexplode("bands").alias("band", "bucket"), F.col("text_id").alias("member")), "band-rows")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(members.join(sizes, "bucket"), "band-shared")
    nodes = stored(_centres(shared), "near-nodes")

    # texts with the same centre lie in the same blocks
    sizes = nodes.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK_TEXTS).cast("int").alias("blocks"))
    blocks = nodes.join(sizes, "centre").select("node", F.xxhash64("centre", F.pmod(F.hash("node"), F.col("blocks"))).alias("block"))
    blocks = stored(blocks, "near-blocks")
    # texts of the nodes, found by id and digest together, so copies of a hot text spread
    wanted = equal.join(nodes, "node", "left_semi").withColumnRenamed("digest", "node_digest")
    own = docs.select(F.col("doc_id").cast("long").alias("row_id"), "text", text_digest(F.col("text")).alias("digest"))
    own = own.join(wanted, (F.col("row_id") == F.col("text_id")) & (F.col("digest") == F.col("node_digest")))
    own = own.groupBy(F.col("node").alias("doc_id")).agg(F.first("text").alias("text"))
    own = stored(own, "near-texts")

    pairs = nodes.filter("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = stored(similar_pairs(pairs, own, blocks, threshold), "near-links")
    roots = _roots(nodes.select("node", F.col("node").alias("root")), links)
    # the nearest partners first: they join most classes, and few pairs are left between them
    sharp = None
    for nearest in (True, False):
        rows = _several(shared, roots)
        sharp = _sharp(rows, own, first) if sharp is None else sharp
        likely = stored(_across(rows, sharp, threshold, nearest).distinct(), "near-likely")
        more = stored(similar_pairs(likely, own, blocks, threshold), "near-links")
        roots = _roots(roots, more)

    # classes are named by the least id of their texts, negative nodes included
    class_of = roots.join(equal.select("node", "text_id"), "node")
    names = class_of.groupBy("root").agg(F.min("text_id").alias("class_id"))
    class_of = class_of.join(names, "root").select("node", "class_id", F.col("root").alias("class_node"))
    classed = prints.join(equal, "digest", "left").join(class_of, "node", "left")
    text_id = F.coalesce("text_id", "doc_id")
    return classed.select(
        "doc_id",
        F.coalesce("class_id", text_id).alias("class_id"),
        text_id.alias("text_id"),
        "digest",
        F.coalesce("class_node", "node").alias("class_node"),
        F.col("node").alias("text_node"),
    )


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """``(doc_id, class_id, text_id)``, one row for every row of ``docs`` (doc_id, text).

    ``text_id`` is the least id with an equal text, ``class_id`` the least id of
    the class's texts. One id with two different texts gives two texts, each
    classed by its own links; both may carry the same ``class_id``. Texts without
    words are alike only if equal; null texts are each alone; a null id is
    classed, but never gives its name to a class with others. Repeated rows stay.
    """
    return _classes(docs, threshold, bands, band_rows).select("doc_id", "class_id", "text_id")


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, one of its least id, with all its columns.

    A class keeps one row: of its least id, the text of least node. One id with
    two texts in different classes keeps both. Documents without an id are kept:
    nothing names them; documents with a null text are each alone, one row an id.
    Of rows that repeat the kept row one stays.
    """
    classes = _classes(docs, threshold)
    head = classes.filter((F.col("doc_id") == F.col("class_id")) & F.col("digest").isNotNull())
    best = head.groupBy("class_node").agg(F.min(F.struct("text_node", "doc_id", "digest")).alias("r")).select("r.doc_id", "r.digest")
    counts = classes.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    key, print_, often = fresh(docs, "first_id"), fresh(docs, "first_digest"), fresh(docs, "first_n")
    firsts = best.join(counts, ["doc_id", "digest"]).select(F.col("doc_id").alias(key), F.col("digest").alias(print_), F.col("n").alias(often))
    firsts = stored(firsts, "near-firsts")
    digest = fresh(docs, "row_digest")
    marked = docs.withColumn(digest, text_digest(F.col("text")))
    same = (F.col("doc_id").cast("long") == F.col(key)) & (F.col(digest) == F.col(print_))
    once = marked.join(firsts.filter(F.col(often) == 1), same, "left_semi")
    repeated = marked.join(firsts.filter(F.col(often) > 1), same, "left_semi").dropDuplicates(["doc_id", digest])
    empty = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNull()).dropDuplicates(["doc_id"])
    kept = once.unionByName(repeated).drop(digest)
    return kept.unionByName(empty).unionByName(docs.filter(F.col("doc_id").isNull()))
