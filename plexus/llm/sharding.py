"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``virtual`` points on the ring. A row's point is the hash of its
key; the arc before a virtual node belongs to that node's shard. Shards hold
exactly their bound; what overflows a full shard goes on clockwise to the next
virtual node whose shard has room.

Rows of an arc have the same way around the ring, so the overflow is settled on
the counts of the arcs: virtual * shards numbers, whatever the number of rows.
A row only needs its rank within its arc. That is by the hash of its key and
content, and by these; so the result follows from the rows alone, however they
are dealt over partitions. Ranks are counted in ``lanes`` per arc, each a range
of those hashes. Rows that are equal in all that counts stand in one lane, but
are numbered in parts, one in each part of their own partitions: any order of
them gives the same result.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexus.llm.rows import pick
from plexus.plans.scratch import held, materialise


def ring(shards: int, virtual: int, spark) -> list[tuple[int, int]]:
    """(point, shard) in ring order; points are hashes of the virtual nodes' numbers."""
    nodes = spark.range(shards * virtual).select(F.xxhash64(F.lit("node"), (F.col("id") % shards), F.floor(F.col("id") / shards)), (F.col("id") % shards).cast("int"))
    return sorted((r[0], r[1]) for r in nodes.collect())


def settle(nodes: list[tuple[int, int]], counts: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deal the arcs' rows to shards: (arc, first rank, end rank, shard, first slot).

    First every arc fills its own shard as far as there is room, in ring
    order; then the overflow walks clockwise, first come first served.
    """
    room, slot = list(bounds), [0] * len(bounds)
    out, waiting = [], [deque() for _ in nodes]

    def put(arc: int, a: int, b: int, shard: int) -> int:
        n = min(b - a, room[shard])
        if n:
            out.append((arc, a, a + n, shard, slot[shard]))
            slot[shard] += n
            room[shard] -= n
        return a + n

    for i, (_, shard) in enumerate(nodes):
        n = counts[i]
        if (a := put(i, 0, n, shard)) < n:
            waiting[i].append((i, a, n))
    walking: deque = deque()
    for turn in range(2 * len(nodes)):
        i = turn % len(nodes)
        shard = nodes[i][1]
        while walking and room[shard]:
            arc, a, b = walking.popleft()
            if (a := put(arc, a, b, shard)) < b:
                walking.appendleft((arc, a, b))
        walking += waiting[i]
        waiting[i].clear()
    if walking:
        raise ValueError("the bounds are less than the rows")
    return out


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", virtual: int = 64, slack: float = 0.0, lanes: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    slack 0: the bounds add up to the number of rows, so the counts of shards
    are at most one apart (law ``rows``). With slack a bound is (1 + slack)
    times the mean, no law holds (null), and fewer rows move as shards are
    added. size is the UTF-8 length of the text plus 16, null texts being as
    empty. slot counts the rows of a shard from 0 without a gap. Null ids are a
    key like any other; repeated rows take slots of their own; ids may be of
    any type, other columns may have any names; an empty table gives an empty
    result. grown_shard is null: it belongs to another law.

    To the driver come shards * virtual * lanes counts at most.
    """
    nodes = ring(shards, virtual, docs.sparkSession)
    points = np.array([p for p, _ in nodes], dtype=np.int64)
    t = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"))
    mark = F.xxhash64(F.lit("place"), "doc_id", "text_crc32", "size")
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.xxhash64(F.lit("row"), "doc_id").alias("point"),
        F.pmod(F.shiftright(mark, 40), F.lit(lanes)).cast("int").alias("lane"),
        mark.alias("mark"),
        F.pmod(F.spark_partition_id(), F.lit(64)).alias("part"),
    )
    same, equal = ["arc", "lane", "mark", "doc_id", "size", "text_crc32"], ["arc", "lane", "mark", "size", "text_crc32", "part"]

    def arcs(batches):
        for b in batches:
            arc = np.searchsorted(points, b.column(3).to_numpy(zero_copy_only=False)) % len(points)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(arc.astype(np.int32)), *(b.column(i) for i in (4, 5, 6))], names=["doc_id", "size", "text_crc32", "arc", "lane", "mark", "part"])

    kept = rows.schema.fields
    rows = materialise(rows.mapInArrow(arcs, T.StructType([*kept[:3], T.StructField("arc", T.IntegerType()), *kept[4:]])), "arcs")
    groups = held(rows.groupBy(*same, "part").agg(F.count("*").alias("m")))
    counted = sorted(tuple(r) for r in groups.groupBy("arc", "lane").agg(F.sum("m")).collect())
    counts = np.zeros(len(nodes), dtype=np.int64)
    before = np.zeros(len(nodes) * lanes, dtype=np.int64)
    for arc, lane, n in counted:
        before[arc * lanes + lane] = counts[arc]
        counts[arc] += n
    total = int(counts.sum())
    bounds = [int((1 + slack) * total / shards) + 1 for _ in range(shards)] if slack else [total // shards + (s < total % shards) for s in range(shards)]
    dealt = sorted(settle(nodes, counts.tolist(), bounds))
    far = 1 << 44
    keys = np.array([d[0] * far + d[1] for d in dealt], dtype=np.int64)
    to = np.array([d[3] for d in dealt], dtype=np.int32)
    shift = np.array([d[4] - d[1] for d in dealt], dtype=np.int64)

    def places(batches):
        for b in batches:
            arc, lane, k = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4, 5))
            rank = before[arc * lanes + lane] + k
            at = np.searchsorted(keys, arc * far + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(to[at]), pa.array(rank + shift[at])], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    # Where a group of equal rows begins in its lane, then each row's number in its part of the group.
    in_lane = Window.partitionBy("arc", "lane").orderBy("mark", "doc_id", "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("start", F.coalesce(F.sum("m").over(in_lane), F.lit(0))).drop("m").withColumnRenamed("doc_id", "own_id")
    ranked = rows.withColumn("i", F.row_number().over(Window.partitionBy(*same, "part").orderBy("size")) - 1)
    ranked = ranked.join(starts, [*(ranked[c] == starts[c] for c in equal), ranked["doc_id"].eqNullSafe(starts["own_id"])]).select(ranked["doc_id"], ranked["size"], ranked["text_crc32"], ranked["arc"], ranked["lane"], (F.col("start") + F.col("i")).cast("long").alias("k"))
    placed = ranked.mapInArrow(places, T.StructType([*kept[:3], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))
    return placed.select("doc_id", "size", "text_crc32", F.lit(None if slack else "rows").cast("string").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
