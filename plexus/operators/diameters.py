"""Repair of diameters that could not be measured (0), and one diameter along each vessel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.functions.geom import dist3, xyz
from plexus.plans.scratch import drop, materialise


def spread(edge: DataFrame, known: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(v_id, vd) with a diameter for every vertex that edges lead to from one that has (more than 0): round by round the largest of its neighbours'."""
    both = edge.select(F.col("v0").alias("v_id"), F.col("v1").alias("to")).unionByName(edge.select(F.col("v1").alias("v_id"), F.col("v0").alias("to")))
    known = materialise(known, "known")
    left = known.where("vd = 0").count()
    for _ in range(max_rounds):
        if left == 0:
            return known
        have = known.where("vd > 0").select(F.col("v_id").alias("to"), F.col("vd").alias("near"))
        got = both.join(known.where("vd = 0").select("v_id"), "v_id", "left_semi").join(have, "to").groupBy("v_id").agg(F.max("near").alias("near"))
        now = materialise(known.join(got, "v_id", "left").select("v_id", F.coalesce("near", "vd").alias("vd")), "known")
        drop(known)
        known, before, left = now, left, now.where("vd = 0").count()
        if left == before:
            return known
    raise RuntimeError("diameters did not come to an end")


def fix_diameters(edge: DataFrame, point: DataFrame, alpha: float = 0.3, uniform: bool = True, max_ratio: float = 2.0, junction_max: bool = False) -> DataFrame:
    """The points (e_id, seq, x, y, z, d) with repaired diameters.

    Inner diameters of points nearer than ``alpha`` times them to an end of
    their edge aren't trusted, as junctions are wider. The first and last that
    are left fill the way to the ends; a vertex has the largest of those and of
    its own. Vertices without any take the largest of their neighbours', round
    by round; what is still unknown between known ones is interpolated by
    position. ``uniform`` gives the inner points of an edge of four or more the
    diameter that keeps its volume. Last, the edges that meet at a vertex get
    one diameter there: the largest of those next to it with ``junction_max`` or
    if it exceeds ``max_ratio`` times the least, else the mean. An edge of two
    points counts in that mean with the mean of its ends.

    A part of the network without any diameter keeps its zeros, null diameters
    are taken as 0, points of edges that aren't there go.
    """
    by = Window.partitionBy("e_id")
    order = by.orderBy("seq")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = point.join(edge, "e_id").select("e_id", "v0", "v1", "seq", "x", "y", "z", F.coalesce("d", F.lit(0.0)).alias("d"))
    p = p.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(by))
    ends = {k: [f(a).over(every) for a in "xyz"] for k, f in (("first", F.first), ("last", F.last))}
    p = p.select("*", *(c.alias(f"{k}_{a}") for k, cs in ends.items() for a, c in zip("xyz", cs, strict=True)))
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    close = F.lit(False)
    for k in ends:
        close = close | (dist3(xyz(), [F.col(f"{k}_{a}") for a in "xyz"]) < alpha * F.col("d"))
    p = p.withColumn("d", F.when(inner & close, 0.0).otherwise(F.col("d")))
    good = F.when(inner & (F.col("d") > 0), F.col("d"))
    at = F.when(inner & (F.col("d") > 0), F.col("i"))
    p = p.select("e_id", "v0", "v1", "seq", "x", "y", "z", "d", "i", "n", F.first(good, True).over(every).alias("d0"), F.last(good, True).over(every).alias("d1"), F.min(at).over(by).alias("i0"), F.max(at).over(by).alias("i1"))
    p = p.withColumn("d", F.when(inner & (F.col("i") < F.col("i0")), F.col("d0")).when(inner & (F.col("i") > F.col("i1")), F.col("d1")).otherwise(F.col("d")))
    p = materialise(p, "filled")

    first, last = F.col("i") == 0, F.col("i") == F.col("n") - 1
    tip = lambda which, v, k: p.where(which).select(F.col(v).alias("v_id"), F.greatest("d", F.coalesce(k, F.lit(0.0))).alias("vd"))
    known = tip(first, "v0", "d0").unionByName(tip(last, "v1", "d1")).groupBy("v_id").agg(F.max("vd").alias("vd"))
    known = spread(edge, known)
    a, b = (known.select(F.col("v_id").alias(v), F.col("vd").alias(f"e{k}")) for k, v in enumerate(("v0", "v1")))
    p = p.join(a, "v0").join(b, "v1").withColumn("d", F.when(first, F.col("e0")).when(last, F.col("e1")).otherwise(F.col("d")))

    unknown = F.when((F.col("d") == 0) & (F.col("e0") > 0) & (F.col("e1") > 0), F.col("i"))
    p = p.withColumn("z0", F.min(unknown).over(by) - 1).withColumn("z1", F.max(unknown).over(by) + 1)
    p = p.withColumn("a", F.max(F.when(F.col("i") == F.col("z0"), F.col("d"))).over(by)).withColumn("b", F.max(F.when(F.col("i") == F.col("z1"), F.col("d"))).over(by))
    between = (F.col("i") > F.col("z0")) & (F.col("i") < F.col("z1"))
    p = p.withColumn("d", F.when(between, F.col("a") + (F.col("b") - F.col("a")) * (F.col("i") - F.col("z0")) / (F.col("z1") - F.col("z0"))).otherwise(F.col("d")))

    if uniform:
        step = dist3(xyz(), [F.lag(c).over(order) for c in "xyz"])
        p = p.withColumn("step", step).withColumn("pd", F.lag("d").over(order))
        sums = {
            "lsum": F.sum("step"),
            "vsum": F.sum(F.col("step") * (F.col("pd") * F.col("pd") + F.col("d") * F.col("d")) / 2),
            "l0": F.max(F.when(F.col("i") == 1, F.col("step"))),
            "l1": F.max(F.when(last, F.col("step"))),
        }
        p = p.select("*", *(c.over(by).alias(k) for k, c in sums.items()))
        rest = F.col("lsum") - F.col("l0") / 2 - F.col("l1") / 2
        d2 = (F.col("vsum") - F.col("e0") * F.col("e0") * F.col("l0") / 2 - F.col("e1") * F.col("e1") * F.col("l1") / 2) / F.when(rest > 0, rest)
        p = p.withColumn("d", F.when(inner & (F.col("n") >= 4) & (rest > 0), F.sqrt(F.greatest(d2, F.lit(0.0)))).otherwise(F.col("d")))
    p = materialise(p.select("e_id", "v0", "v1", "seq", "x", "y", "z", "d", "i", "n", "e0", "e1"), "uniform")

    pair = (F.col("e0") + F.col("e1")) / 2
    beside = lambda v, at: p.where(at).select(F.col(v).alias("v_id"), F.when(F.col("n") > 2, F.col("d")).alias("d"), F.when(F.col("n") > 2, F.col("d")).otherwise(pair).alias("m"))
    next0 = (F.col("n") > 2) & (F.col("i") == 1) | (F.col("n") <= 2) & first
    next1 = (F.col("n") > 2) & (F.col("i") == F.col("n") - 2) | (F.col("n") <= 2) & last
    meet = beside("v0", next0).unionByName(beside("v1", next1)).groupBy("v_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.avg("m").alias("mean"))
    wide = F.lit(True) if junction_max else F.col("hi") > max_ratio * F.col("lo")
    meet = meet.select("v_id", F.when(F.coalesce(wide & F.col("hi").isNotNull(), F.lit(False)), F.col("hi")).otherwise(F.col("mean")).alias("vd"))
    a, b = (meet.select(F.col("v_id").alias(v), F.col("vd").alias(f"m{k}")) for k, v in enumerate(("v0", "v1")))
    out = p.join(a, "v0").join(b, "v1")
    return out.select("e_id", "seq", "x", "y", "z", F.when(first, F.col("m0")).when(last, F.col("m1")).otherwise(F.col("d")).alias("d"))
