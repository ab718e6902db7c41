"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``points`` places on a ring. A row's key hashes to a place and belongs to the
next point clockwise; rows that find its shard full go on clockwise to the next shard with room.
Capacities add up to at least all rows, so no shard holds more than its capacity.

Rows reach the ring in the order of its arcs and, inside an arc, in a fixed order of their
content, so how many of each arc's rows go where follows from the counts of the arcs alone, a
table of ``shards x points`` numbers whatever the data. A row then needs only its rank inside
its arc, which comes from a range partitioning and the counts of its parts: no arc, shard or key
is ever sorted in one task, also not where one key holds a third of all rows.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, Window, functions as F

from dqspark.session import materialize

SHARDS = 8
POINTS = 128
PART_ROWS = 50_000
#: Places on the ring are 63-bit numbers.
RING = 1 << 63


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order."""
    def place(shard: int, point: int) -> int:
        digest = hashlib.sha256(f"shard {shard} point {point}".encode()).digest()
        return int.from_bytes(digest[:8], "big") >> 1
    return sorted((place(s, p), s) for s in range(shards) for p in range(points))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: an even share, enlarged by ``slack``.

    Without slack the shares are exact: they differ by one at most and add up to ``rows``.
    """
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple]:
    """Where the rows of each arc go: (arc, first rank, rows, shard, first slot) in ring order."""
    left, taken, out = list(room), [0] * len(room), []
    for arc in range(len(nodes)):
        rank, rest, at = 0, counts.get(arc, 0), arc
        while rest:
            shard = nodes[at % len(nodes)][1]
            n = min(rest, left[shard])
            if n:
                out.append((arc, rank, n, shard, taken[shard]))
                left[shard] -= n
                taken[shard] += n
                rank, rest = rank + n, rest - n
            at += 1
    return out


def assign(rows: DataFrame, key: str, content: str, shards: int = SHARDS, points: int = POINTS,
           slack: float = 0.0, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with its ``shard`` and ``slot``, the place inside the shard, gapless from 0.

    ``key`` decides the place on the ring; null is a key like any other. ``content`` orders the
    rows of an arc; rows equal in both may take each other's place, and each gets a slot of its
    own. The result depends on the rows only, up to such rows. An empty table stays empty.
    Columns ``rows`` already has keep their values; ``shard`` and ``slot`` must not be among them.
    """
    spark = rows.sparkSession
    nodes = ring(shards, points)
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1)
    placed = rows.select(F.struct(*rows.columns).alias("_row"), hashed.alias("_place"),
                         F.xxhash64(F.lit("order"), content).alias("_order"))
    placed = placed.withColumn("_arc", _arc(nodes, "_place"))
    order = ["_arc", "_place", "_order", "_tie"]
    parts = max(1, -(-rows.count() // part_rows))
    placed = placed.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(
        parts, *order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "ring")

    counts = placed.groupBy("_part", "_arc").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_arc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", "_arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # at most shards x points counts
    held = {a: n for a, n in counts.groupBy("_arc").agg(F.sum("n")).collect()}
    runs = fill(held, nodes, capacities(sum(held.values()), shards, slack))
    runs = spark.createDataFrame(
        runs, "_arc int, _from long, _rows long, shard int, _slot long")

    inside = Window.partitionBy("_part", "_arc").orderBy("_place", "_order", "_tie")
    ranked = placed.withColumn("_n", F.row_number().over(inside) - 1).join(
        base, ["_part", "_arc"]).withColumn("_rank", F.col("_base") + F.col("_n"))
    ranked, runs = ranked.alias("r"), runs.alias("s")
    put = ranked.join(runs, [F.col("r._arc") == F.col("s._arc"), F.col("_rank") >= F.col("_from"),
                             F.col("_rank") < F.col("_from") + F.col("_rows")])
    return put.select("_row.*", "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def _arc(nodes: list[tuple[int, int]], place: str):
    """Number of the first point at or after a place; the ring is cut into cells of few points."""
    cells = 4 * len(nodes)
    width = -(-RING // cells)
    inside: list[list[int]] = [[] for _ in range(cells)]
    for p, _ in nodes:
        inside[p // width].append(p)
    before = [0]
    for points in inside:
        before.append(before[-1] + len(points))
    table = F.from_json(F.lit(json.dumps({"before": before, "inside": inside})),
                        "before array<int>, inside array<array<bigint>>")
    cell = (F.expr(f"{place} div {width}")).cast("int")
    lower = F.size(F.filter(F.get(table["inside"], cell), lambda p: p < F.col(place)))
    return F.pmod(F.get(table["before"], cell) + lower, F.lit(len(nodes))).cast("int")
