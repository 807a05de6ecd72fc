"""Mixing sources to target weights with exact block quotas.

Every source is cut into blocks by a hash of its rows, which also permutes it.
A source with a target beyond its size gives whole copies first; the rest comes
from its permuted blocks, and from single documents of the block that would
overshoot and of those after it, until none left fits. A splitting tree then divides the drawn blocks among output shards:
at each node the blocks of all sources are split between two halves of the
shards by a multivariate hypergeometric draw, so each shard has an exact quota
of blocks of every source. Blocks are drawn disjointly by quota and rows are
shuffled within their shard. DataFrame functions only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import n_words
from querent.session import stored

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 200_000
SHARDS = 8
SEED = 17


@dataclass(frozen=True)
class Mix:
    """A mix that has been drawn: tables by source, and by source and block."""

    sources: DataFrame
    blocks: DataFrame
    picked: DataFrame
    documents: DataFrame


def row_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    all words; a target stops at ``cap`` times its source's size and the excess
    is shared again by weight. A source is capped exactly if its cap by weight is
    below the share that the caps before it leave; one row per source, so one
    window over all of them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    most = F.col("source_size") * F.lit(float(cap))
    table = sizes.withColumn("weight", weight).withColumn("most", most)
    line = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = line.rowsBetween(Window.unboundedPreceding, -1)
    rest = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    table = table.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    share = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("most")).otherwise(share * F.col("weight"))
    return table.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_size", "target")


def split_quotas(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of every source for every shard, by a tree of multivariate hypergeometric draws.

    A node of ``m`` shards holding ``n`` blocks gives its left half
    ``n * (m // 2) // m`` of them; how many of each source is drawn without
    replacement. Sources are the colours.
    """
    rng = np.random.Generator(np.random.PCG64(seed))

    def draw(colours: list[int], take: int) -> list[int]:
        left, out = sum(colours), []
        for n in colours:
            left -= n
            got = int(rng.hypergeometric(n, left, take)) if n and take and left else min(n, take)
            out.append(got)
            take -= got
        return out

    def split(node: list[int], count: int) -> list[list[int]]:
        if count == 1:
            return [node]
        half = count // 2
        low = draw(node, sum(node) * half // count)
        return split(low, half) + split([n - m for n, m in zip(node, low)], count - half)

    return split(list(blocks), shards)


def _literal_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table as an expression."""
    text = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(text))


def _filled(rows: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """``(source, block, key)`` of single units that fill what whole blocks leave open.

    In each round, the units that fit into the gap of their source are taken in
    the order of blocks and hashes as far as all of them fit. Every round takes
    some; the last leaves no unit that fits. Sums by block are what a source is
    ordered by, so no task holds all its units.
    """
    gaps = blocks.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("block_size"))), F.lit(0))).alias("left"))
    gaps = stored(gaps.select(F.col("source").alias("g_source"), "left"), "mix-gaps")
    later = blocks.filter(~F.col("fits")).select(F.col("source").alias("e_source"), F.col("block").alias("e_block"), "edge")
    units = rows.join(later, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    units = units.groupBy("source", "block", "key").agg(F.sum("size").alias("unit"), F.first("edge").alias("edge"))
    # units without words come with their block
    units = units.filter(F.col("edge") | (F.col("unit") > 0)).drop("edge")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.col("block")), "block")
    line = Window.partitionBy("source", "block").orderBy("key")
    taken = None
    while True:
        fit = units.join(gaps, F.col("source").eqNullSafe(F.col("g_source"))).filter(F.col("unit") <= F.col("left"))
        units = stored(fit.select("source", "block", "key", "unit"), "mix-units")
        if units.isEmpty():
            return units.select("source", "block", "key") if taken is None else taken.select("source", "block", "key")
        sums = units.groupBy("source", "block").agg(F.sum("unit").alias("all")).withColumn("before", F.sum("all").over(order) - F.col("all"))
        sums = sums.join(gaps, F.col("source").eqNullSafe(F.col("g_source"))).filter(F.col("before") <= F.col("left"))
        sums = sums.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "before", "left")
        now = units.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
        now = now.filter(F.col("before") + F.col("unit") <= F.col("left")).withColumn("upto", F.col("before") + F.sum("unit").over(line))
        now = stored(now.filter(F.col("upto") <= F.col("left")).select("source", "block", "key", "unit"), "mix-picked")
        taken = now if taken is None else taken.unionByName(now)
        sizes = now.groupBy(F.col("source").alias("n_source")).agg(F.sum("unit").alias("n"))
        gaps = gaps.join(sizes, F.col("g_source").eqNullSafe(F.col("n_source")), "left")
        gaps = stored(gaps.select("g_source", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")), "mix-gaps")
        gone = now.select(F.col("source").alias("t_source"), F.col("block").alias("t_block"), F.col("key").alias("t_key"))
        same = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("block") == F.col("t_block")) & (F.col("key") == F.col("t_key"))
        units = units.join(gone, same, "left_anti")


def draw_mix(
    docs: DataFrame,
    weights=WEIGHTS,
    cap: int = CAP,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> Mix:
    """Decide what of ``docs`` (doc_id, text, source) is taken how often and to which shards.

    ``documents``: doc_id, source, size, key, block, one row per row of the
    input. ``blocks``: per source and block the shard of each copy. ``sources``:
    size and target. Rows of one id and text count as one unit: all of them are
    taken, or none. Texts without words have size 0 and come with their block.
    Reruns agree, whatever the partitions.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), row_key(seed).alias("key")
    )
    sized = stored(sized, "mix-sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, cap)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    copies = F.least(copies, F.lit(cap))
    sources = sources.withColumns({"copies": copies, "n_blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")})
    sources = stored(sources.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-sources")

    of_source = sources.select(F.col("source").alias("s_source"), "source_size", "target", "copies", "n_blocks", "rest")
    same_source = F.col("source").eqNullSafe(F.col("s_source"))
    rows = sized.join(of_source, same_source).drop("s_source").withColumn("block", F.pmod("key", "n_blocks"))

    # whole blocks in permuted order as long as they fit
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.first("rest").alias("rest"), F.first("copies").alias("copies"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.col("block")), "block")
    upto = F.sum("block_size").over(order)
    blocks = blocks.withColumn("upto", upto)
    blocks = blocks.withColumn("fits", F.col("upto") <= F.col("rest")).withColumn(
        "edge", ~F.col("fits") & (F.col("upto") - F.col("block_size") <= F.col("rest"))
    )
    blocks = stored(blocks, "mix-blocks")
    picked = _filled(rows, blocks, seed)
    some = picked.select(F.col("source").alias("f_source"), F.col("block").alias("f_block")).distinct()
    blocks = blocks.join(some, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("block") == F.col("f_block")), "left")
    blocks = blocks.withColumn("partly", F.col("edge") | F.col("f_block").isNotNull()).drop("f_source", "f_block")

    # every drawn copy of a block is a unit of the splitting tree
    drawn = F.col("copies") + F.when(F.col("fits") | F.col("partly"), 1).otherwise(0)
    each = blocks.select("source", "block", "partly", "copies", F.explode(F.when(drawn > 0, F.sequence(F.lit(1), drawn))).alias("copy"))
    place = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), F.col("copy"), F.col("block")), "copy", "block")
    each = each.withColumn("at", F.row_number().over(place).cast("long") - 1)
    counts = each.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    quotas = split_quotas([r["n"] for r in counts], shards, seed)
    ends = np.cumsum(np.array(quotas, dtype=np.int64).reshape(shards, -1), axis=0)
    ends_table = _literal_table(
        spark,
        [{"q_source": r["source"], "is_null": r["source"] is None, "ends": ends[:, i].tolist()} for i, r in enumerate(counts)],
        "q_source: string, is_null: boolean, ends: array<bigint>",
    )
    each = each.join(ends_table, F.col("source").eqNullSafe(F.col("q_source")))
    shard = F.size(F.filter("ends", lambda end: end <= F.col("at")))
    each = each.withColumn("shard", shard)
    placed = each.groupBy("source", "block").agg(
        F.array_sort(F.collect_list(F.struct("copy", "shard", (F.col("partly") & (F.col("copy") > F.col("copies"))).alias("partly")))).alias("drawn")
    )
    placed = stored(placed, "mix-placed")
    return Mix(sources, placed, picked, _with_copies(rows, placed, picked))


def _with_copies(rows: DataFrame, placed: DataFrame, picked: DataFrame) -> DataFrame:
    """``rows`` (with source, block, key) and ``shards``: the output shard of each copy taken."""
    placed = placed.select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "drawn")
    picked = picked.select(F.col("source").alias("k_source"), F.col("block").alias("k_block"), F.col("key").alias("k_key"))
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block"))
    one = F.col("source").eqNullSafe(F.col("k_source")) & (F.col("block") == F.col("k_block")) & (F.col("key") == F.col("k_key"))
    rows = rows.join(placed, same, "left").join(picked, one, "left")
    own = F.filter("drawn", lambda d: ~d["partly"] | F.col("k_key").isNotNull())
    shards = F.coalesce(F.transform(own, lambda d: d["shard"]), F.array().cast("array<int>"))
    return rows.withColumn("shards", shards).drop("p_source", "p_block", "drawn", "k_source", "k_block", "k_key")


def taken_words(mix: Mix) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, shards)``, one row per document."""
    return mix.documents.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards"
    )


def mix_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **how) -> DataFrame:
    """The rows of the mix, with all columns of ``docs``: a document once for each copy taken.

    Output partitions are the shards; within one, rows are shuffled by a hash.
    """
    mix = draw_mix(docs, shards=shards, seed=seed, **how)
    # columns get plain names while helper columns are beside them; decisions are
    # joined by source and block, small tables next to the texts
    own = [F.col(name).alias(f"c{i}") for i, name in enumerate(docs.columns)]
    rows = docs.select(*own, F.col("source").alias("source"), row_key(seed).alias("key"))
    of_source = mix.sources.select(F.col("source").alias("s_source"), "n_blocks")
    rows = rows.join(of_source, F.col("source").eqNullSafe(F.col("s_source")))
    rows = rows.withColumn("block", F.pmod("key", "n_blocks")).drop("s_source", "n_blocks")
    rows = _with_copies(rows, mix.blocks, mix.picked)
    kept = [f"c{i}" for i in range(len(docs.columns))]
    rows = rows.select(*kept, "key", F.posexplode("shards").alias("copy", "shard"))
    local = F.xxhash64(F.lit(seed + 2), "key", "copy")
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", local)
    return rows.select(*[F.col(k).alias(name) for k, name in zip(kept, docs.columns)])
