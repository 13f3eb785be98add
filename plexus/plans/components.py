"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.plans.scratch import drop, held, materialise


def _towards_minimum(pairs: DataFrame, small: bool) -> DataFrame:
    """One star step over directed rows (u, v): link the neighbours of u to the least of them and u.

    The least neighbour per node is a partial aggregate; it is joined back on a
    side with one row per node, so a hub's rows can be split between tasks.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, label) for every node named by a link; label is the least node of its component.

    links: two columns of one orderable type. Links with a null end and links
    from a node to itself name no other node; the latter give their node its
    own label, the former are ignored. Each round is written to the shared
    folder, in files by its counted rows; only its row count and checksum reach
    the driver. An empty table gives an empty result.
    """
    ends = held(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"))
    alone = ends.where("a = b").select(F.col("a").alias("node"))
    # A round has no more rows than the one before: each link goes over to at most one other, and each node to its least neighbour.
    most = 2 * ends.count()
    pairs = materialise(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", rows=most)
    before = None
    for _ in range(max_rounds):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _towards_minimum(both, small=False)
        after = materialise(_towards_minimum(large.select(F.col("a").alias("u"), F.col("b").alias("v")), small=True), "round", rows=most)
        drop(pairs)
        pairs = after
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError("connected components did not converge")
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("label")))
    return found.unionByName(alone.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
