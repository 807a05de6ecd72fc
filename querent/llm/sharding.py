"""Consistent hashing with virtual nodes and bounded loads.

Each shard owns many points of a ring of hash values; a key belongs to the first
point clockwise of its own hash. A shard takes no more rows than its bound; what
overflows goes on clockwise to the next shard with room.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.session import stored

CELL_ROWS = 1_000_000


def ring_points(spark: SparkSession, shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """``(position, shard)`` of all virtual nodes, clockwise; a fixed number of rows."""
    nodes = spark.range(shards * virtual_nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("position"),
    )
    return sorted((row["position"], row["shard"]) for row in nodes.collect())


def bounds(rows: int, shards: int, epsilon: float) -> list[int]:
    """Most rows of each shard. With ``epsilon`` 0 they add up to all rows, one apart at most."""
    if epsilon > 0:
        return [int(np.ceil((1 + epsilon) * rows / shards))] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def overflow_plan(counts: dict[tuple[int, int], int], points, shards: int, limit: list[int]):
    """Where the rows of each cell go: ``{cell: [(upto_rank, shard, slot_of_first)]}``.

    A cell is ``(arc, part of the arc)``. In round r, what is left of a cell asks
    the r-th distinct shard clockwise from its arc, cells in ring order; a shard
    takes what it has room for. A row asks every shard at most once.
    """
    owners = [shard for _, shard in points]
    clockwise = []
    for arc in range(len(owners)):
        seen: list[int] = []
        step = 0
        while len(seen) < shards and step < len(owners):
            shard = owners[(arc + step) % len(owners)]
            if shard not in seen:
                seen.append(shard)
            step += 1
        clockwise.append(seen)
    room, used = list(limit), [0] * shards
    placed = {cell: 0 for cell in counts}
    plan: dict[tuple[int, int], list[tuple[int, int, int]]] = {cell: [] for cell in counts}
    for turn in range(shards):
        for cell in sorted(counts):
            left = counts[cell] - placed[cell]
            if left and turn < len(clockwise[cell[0]]):
                shard = clockwise[cell[0]][turn]
                take = min(left, room[shard])
                if take:
                    placed[cell] += take
                    plan[cell].append((placed[cell], shard, used[shard]))
                    room[shard] -= take
                    used[shard] += take
    return plan


def shard_by_ring(
    rows: DataFrame, key: str, shards: int = 8, virtual_nodes: int = 128, epsilon: float = 0.0
) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` and ``home_shard`` (the ring's owner before overflow).

    ``epsilon`` is the slack of the bound: a shard takes at most
    ceil((1 + epsilon) * rows / shards) rows; with 0 the bounds add up exactly
    and counts differ by one at most. Slots are gapless from 0 in each shard. The
    row's hash decides ties, rows equal in all columns are interchangeable; a
    null key has a place on the ring like any other. An empty table gives an
    empty result. Columns of these names are replaced.

    Rows are counted by cell (an arc of the ring, cut into parts of about
    ``CELL_ROWS``), the driver plans on the counts alone, and ranks are taken
    within cells. A row takes its part of the arc from a hash of the whole row,
    so rows of one key spread as well.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "home_shard")
    points = ring_points(spark, shards, virtual_nodes)
    positions = [position for position, _ in points]

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(positions, np.int64), position.to_numpy(np.int64), side="left")
        return pd.Series((at % len(positions)).astype(np.int32))

    placed = rows.withColumns(
        {"__arc": arc_of(F.xxhash64(F.lit("key"), F.col(key))), "__order": F.xxhash64(*[F.col(c) for c in rows.columns])}
    )
    placed = stored(placed, "ring-rows")
    total = placed.count()
    parts = max(1, -(-total // (CELL_ROWS * len(points))))
    placed = placed.withColumn("__part", F.pmod(F.hash("__order"), F.lit(parts)).cast("int"))
    counts = {(r["__arc"], r["__part"]): r["n"] for r in placed.groupBy("__arc", "__part").agg(F.count("*").alias("n")).collect()}
    plan = overflow_plan(counts, points, shards, bounds(total, shards, epsilon))
    schema = "__arc int, __part int, home_shard int, __to array<struct<upto: long, shard: int, slot: long>>"
    table = spark.createDataFrame(
        [(arc, part, points[arc][1], segments) for (arc, part), segments in plan.items()], schema
    )
    within = Window.partitionBy("__arc", "__part").orderBy("__order")
    ranked = placed.withColumn("__rank", F.row_number().over(within).cast("long") - 1)
    joined = ranked.join(table, ["__arc", "__part"])
    first = F.element_at(F.filter("__to", lambda s: F.col("__rank") < s["upto"]), 1)
    before = F.coalesce(F.array_max(F.transform(F.filter("__to", lambda s: F.col("__rank") >= s["upto"]), lambda s: s["upto"])), F.lit(0))
    return joined.select(
        *rows.columns,
        first["shard"].alias("shard"),
        (first["slot"] + F.col("__rank") - before).alias("slot"),
        "home_shard",
    )


def owner(points: list[tuple[int, int]], position: int) -> int:
    """The shard that owns a position of the ring, for checks."""
    return points[bisect_left([p for p, _ in points], position) % len(points)][1]
