"""Networks rewritten by rules that look at several edges at once: loops, contractions, joints between loose ends."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.functions.geom import cell, dot3, near_cells, norm3
from plexus.operators.network import degree
from plexus.plans.scratch import drop, materialise


def repeated_edges(edge: DataFrame, point: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(e_id) of the two-point edges that a later edge between the same vertices repeats, and (v_id, factor) by which diameters there grow.

    An edge whose next repeat has two points as well hands its diameter on: factor 1.414 at both ends.
    """
    size = edge.join(point.groupBy("e_id").agg(F.count("*").alias("npts")), "e_id")
    later = F.lead("npts").over(Window.partitionBy(F.least("v0", "v1"), F.greatest("v0", "v1")).orderBy("e_id"))
    gone = size.withColumn("later", later).where("npts = 2 and later is not null")
    handed = gone.where("later = 2").select(F.explode(F.array("v0", "v1")).alias("v_id")).groupBy("v_id").agg(F.pow(F.lit(1.414), F.count("*")).alias("factor"))
    return gone.select("e_id"), handed


def deloop(edge: DataFrame, vertex: DataFrame, point: DataFrame) -> DataFrame:
    """e_id of the edges that stay: repeats of two-point edges go, then every triangle of two-point edges is broken.

    A triangle with a corner that no other edge reaches loses its edges at such
    corners, any other its longest edge (of equal ones that of the least e_id).
    Corners are counted before anything is dropped, so the order of the
    triangles doesn't matter. Edges lead from the vertex of fewer links to that
    of more, so that a hub doesn't pair all its edges.
    """
    again, _ = repeated_edges(edge, point)
    short = edge.where("v0 <> v1").join(point.groupBy("e_id").agg(F.count("*").alias("npts")).where("npts = 2"), "e_id").join(again, "e_id", "left_anti")
    links = edge.select(F.explode(F.array_distinct(F.array("v0", "v1"))).alias("v_id")).groupBy("v_id").agg(F.count("*").alias("k"))
    at = vertex.join(links, "v_id")
    ends = short.select("e_id", "v0", "v1")
    for i in "01":
        ends = ends.join(at.select(F.col("v_id").alias(f"v{i}"), F.struct("k", "v_id").alias(f"r{i}"), *(F.col(c).alias(f"{c}{i}") for c in "xyz")), f"v{i}")
    far = norm3([F.col(f"{c}0") - F.col(f"{c}1") for c in "xyz"])
    arcs = materialise(ends.select("e_id", F.least("r0", "r1").alias("a"), F.greatest("r0", "r1").alias("b"), far.alias("len")), "arcs")
    name = lambda i, a, b: arcs.select(F.col("e_id").alias(f"e{i}"), F.col("a").alias(a), F.col("b").alias(b), F.col("len").alias(f"l{i}"))
    loops = name(1, "p", "q").join(name(2, "p", "r"), "p").where("q < r").join(name(3, "q", "r"), ["q", "r"])
    two = lambda v: (F.col(f"{v[0]}.k") == 2) | (F.col(f"{v[1]}.k") == 2)
    corner = (F.col("p.k") == 2) | (F.col("q.k") == 2) | (F.col("r.k") == 2)
    longest = F.greatest(*(F.struct(F.col(f"l{i}").alias("l"), (-F.col(f"e{i}")).alias("e")) for i in (1, 2, 3)))["e"]
    cut = F.array_compact(F.array(*(F.when(two(v), F.col(e)) for e, v in (("e1", "pq"), ("e2", "pr"), ("e3", "qr")))))
    broken = loops.select(F.explode(F.when(corner, cut).otherwise(F.array(-longest))).alias("e_id"))
    return edge.select("e_id").join(again.unionByName(broken).distinct(), "e_id", "left_anti")


def reduce_edges(edge: DataFrame, vertex: DataFrame, point: DataFrame, limit: float, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertex, edge and point after short thick edges (length / mean diameter at most ``limit``) were contracted one by one in the order of e_id.

    An edge is contracted if both ends have at most three links, its second
    end more than one, and no two other edges at its ends lead to one vertex.
    Its first vertex moves to the middle with the mean diameter of its ends,
    and takes over the second one's edges; lengths and diameters are those
    from before. Loops stay.

    In each round those candidates are settled that are the first within two
    links of either end, which gives what the one-by-one order gives. A
    contraction gives its vertex no fewer links than it had and changes no
    other's, so an edge with an end of over three links, or whose second end
    has no other, is never contracted and stops being a candidate at once.
    """
    from plexus.operators.network import edge_dimensions

    tip = point.groupBy("e_id").agg(F.min_by("d", "seq").alias("d0"), F.max_by("d", "seq").alias("d1"))
    size = edge_dimensions(point).select("e_id", (F.col("length") / F.col("mean_diam")).alias("ratio"))
    now = edge.join(tip, "e_id").join(size, "e_id").select("e_id", "v0", "v1", "d0", "d1", ((F.col("ratio") <= limit) & (F.col("v0") != F.col("v1"))).alias("open"))
    e, v = materialise(now, "edges"), materialise(vertex.select("v_id", "x", "y", "z"), "vertices")
    before = e
    for _ in range(max_rounds):
        links = e.select(F.explode(F.array("v0", "v1")).alias("v")).groupBy("v").agg(F.count("*").alias("k"))
        for i in "01":
            e = e.join(links.select(F.col("v").alias(f"v{i}"), F.col("k").alias(f"k{i}")), f"v{i}")
        e = materialise(e.select("e_id", "v0", "v1", "d0", "d1", (F.col("open") & (F.col("k0") <= 3) & (F.col("k1") <= 3) & (F.col("k1") != 1)).alias("open")), "open")
        drop(before)
        if e.where("open").isEmpty():
            break
        both = e.select("e_id", F.col("v0").alias("v"), F.col("v1").alias("w"), "open").unionByName(e.select("e_id", F.col("v1").alias("v"), F.col("v0").alias("w"), "open"))
        first = both.groupBy("v").agg(F.min(F.when(F.col("open"), F.col("e_id"))).alias("m"), F.count("*").alias("k"))
        around = both.join(first.select(F.col("v").alias("w"), "m"), "w").groupBy("v").agg(F.min("m").alias("m2")).join(first, "v").select("v", "k", F.least("m", "m2").alias("m"))
        ready = e.where("open")
        for i in "01":
            ready = ready.join(around.select(F.col("v").alias(f"v{i}"), F.col("k").alias(f"k{i}"), F.col("m").alias(f"m{i}")), f"v{i}")
        ready = materialise(ready.where("e_id = least(m0, m1)").select("e_id", "v0", "v1", "d0", "d1", "k0", "k1"), "ready")
        far = lambda i: ready.select(F.col("e_id").alias("id"), F.col(f"v{i}").alias("v")).join(both.select("v", "w", F.col("e_id").alias("other")), "v").where("other <> id").select("id", "w").distinct()
        shared = far(0).join(far(1), ["id", "w"]).select(F.col("id").alias("e_id")).distinct()
        go = materialise(ready.where("k0 <= 3 and k1 <= 3 and k1 <> 1").join(shared, "e_id", "left_anti"), "contracted")
        # Contracted edges share no vertex, so each vertex is renamed or moved at most once.
        moved = go.select(F.explode(F.array("v0", "v1")).alias("v"), F.col("v0").alias("to"), ((F.col("d0") + F.col("d1")) / 2).alias("d"))
        out = e.join(go.select("e_id"), "e_id", "left_anti").join(ready.select("e_id", F.lit(True).alias("done")), "e_id", "left")
        for i in "01":
            out = out.join(moved.select(F.col("v").alias(f"v{i}"), F.col("to").alias(f"t{i}"), F.col("d").alias(f"n{i}")), f"v{i}", "left")
        out = out.select("e_id", F.coalesce("t0", "v0").alias("v0"), F.coalesce("t1", "v1").alias("v1"), F.coalesce("n0", "d0").alias("d0"), F.coalesce("n1", "d1").alias("d1"), (F.col("open") & F.col("done").isNull()).alias("open"))
        p = v.select(F.col("v_id").alias("v1"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
        middle = go.select("v0", "v1").join(p, "v1").select(F.col("v0").alias("v_id"), *(f"{c}1" for c in "xyz"))
        near = v.join(go.select(F.col("v1").alias("v_id")), "v_id", "left_anti").join(middle, "v_id", "left")
        near = near.select("v_id", *(F.when(F.col(f"{c}1").isNull(), F.col(c)).otherwise((F.col(c) + F.col(f"{c}1")) / 2).alias(c) for c in "xyz"))
        e2, v2 = materialise(out, "edges"), materialise(near, "vertices")
        for old in (e, v, ready, go):
            drop(old)
        e, v, before = e2, v2, e2
    else:
        raise RuntimeError("the contractions did not come to an end")
    tips = e
    for i in "01":
        tips = tips.join(v.select(F.col("v_id").alias(f"v{i}"), *(F.col(c).alias(f"{c}{i}") for c in "xyz")), f"v{i}")
    w = Window.partitionBy("e_id")
    rows = point.withColumn("lo", F.min("seq").over(w)).withColumn("hi", F.max("seq").over(w)).join(tips, "e_id")
    pick = lambda c: F.when(F.col("seq") == F.col("lo"), F.col(f"{c}0")).when(F.col("seq") == F.col("hi"), F.col(f"{c}1")).otherwise(F.col(c)).alias(c)
    return v, e.select("e_id", "v0", "v1"), rows.select("e_id", "seq", *(pick(c) for c in "xyzd"))


def loose_tips(edge: DataFrame, point: DataFrame) -> DataFrame:
    """(tip, e_id, v_id, x, y, z, d, ux, uy, uz, mean_diam): the ends of edges at vertices of one link, with the direction of the last segment."""
    w = Window.partitionBy("e_id").orderBy("seq")
    back = Window.partitionBy("e_id").orderBy(F.desc("seq"))
    mean = point.groupBy("e_id").agg(F.avg("d").alias("mean_diam"))

    def side(order, v, k):
        rows = point.select("e_id", *"xyzd", *(F.lead(c).over(order).alias(f"b{c}") for c in "xyz"), F.row_number().over(order).alias("r")).where("r = 1")
        way = [F.col(c) - F.col(f"b{c}") for c in "xyz"]
        return rows.join(edge, "e_id").select((2 * F.col("e_id") + k).alias("tip"), "e_id", F.col(v).alias("v_id"), *"xyzd", *((c / F.nullif(norm3(way), F.lit(0.0))).alias(f"u{a}") for c, a in zip(way, "xyz", strict=True)))

    tips = side(w, "v0", 0).unionByName(side(back, "v1", 1))
    return tips.join(degree(edge).where("n_links = 1").select("v_id"), "v_id", "left_semi").join(mean, "e_id").where("ux is not null")


def turning(e0: np.ndarray, e1: np.ndarray, p0: np.ndarray, p1: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sum of the squares of the three angles by which a way turns that comes along e0 to p0, goes over p to p1 and on against e1."""
    ways = (e0, p - p0, p1 - p, -e1)
    out = 0.0
    for u, v in zip(ways, ways[1:], strict=False):
        n = np.linalg.norm(u, axis=-1) * np.linalg.norm(v, axis=-1)
        out = out + np.arccos(np.clip((u * v).sum(axis=-1) / np.maximum(n, 1e-300), -1, 1)) ** 2
    return out


#: A joint is no longer than so many times the gap that it closes.
STRETCH = 1.5


def joints(p0: np.ndarray, p1: np.ndarray, e0: np.ndarray, e1: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """For each pair the point as far from p0 as from p1 at which the way turns least.

    Such points form the plane that halves the gap. The least is sought there
    among the points of a square grid, for all pairs at once; a grid of half
    the width then stands around each pair's best point, until its width is
    ``tolerance`` of the gap. The first grid covers all joints that are no
    longer than STRETCH times the gap; longer ones don't count.
    """
    if not len(p0):
        return np.zeros((0, 3))
    gap = p1 - p0
    size = np.linalg.norm(gap, axis=1)
    # Two directions across the gap: rows of an orthogonal basis whose first vector is the gap's.
    basis = np.linalg.svd(gap[:, None, :])[2][:, 1:]
    most = np.sqrt((STRETCH / 2) ** 2 - 0.25)
    steps = np.linspace(-1, 1, 17)
    grid = np.stack(np.meshgrid(steps, steps, indexing="ij"), axis=-1).reshape(-1, 2)
    best, width = np.zeros((len(p0), 2)), most
    pick = np.arange(len(p0))
    while width > tolerance:
        at = best[:, None, :] + width * grid
        p = ((p0 + p1) / 2)[:, None, :] + size[:, None, None] * np.einsum("nks,nsa->nka", at, basis)
        cost = turning(e0[:, None, :], e1[:, None, :], p0[:, None, :], p1[:, None, :], p)
        cost = np.where((at**2).sum(axis=2) <= most**2 + 1e-12, cost, np.inf)
        best = at[pick, cost.argmin(axis=1)]
        width /= 2
    return (p0 + p1) / 2 + size[:, None] * np.einsum("ns,nsa->na", best, basis)


def join_loose_ends(edge: DataFrame, point: DataFrame, reach: float = 100.0, max_diameter: float = 14.0, least: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(tip0, tip1, v0, v1, score, x, y, z, d): joints between loose ends, in the order of the tips; (x, y, z, d) is a joint's middle point.

    Each tip in turn takes the free later tip of the best score
    ((1 + cos a0) / 2) ((1 + cos a1) / 2) / distance of at least ``least`` (1 / reach),
    then the least tip. In each round those tips take theirs that no earlier
    open tip could take, nor its choice; that is the outcome of taking turns.
    """
    tips = materialise(loose_tips(edge, point).where(F.col("mean_diam") <= max_diameter), "tips")
    at = tips.select("tip", "v_id", *"xyzd", "ux", "uy", "uz", *(cell(F.col(a), reach).alias(f"c{a}") for a in "xyz"))
    other = tips.select(F.col("tip").alias("tip1"), F.col("v_id").alias("w_id"), *(F.col(c).alias(f"q{c}") for c in "xyzd"), *(F.col(f"u{c}").alias(f"w{c}") for c in "xyz"), *(cell(F.col(a), reach).alias(f"k{a}") for a in "xyz"))
    way = [F.col(f"q{c}") - F.col(c) for c in "xyz"]
    rows = near_cells(at).join(other, ["kx", "ky", "kz"]).where("tip < tip1").withColumn("far", norm3(way)).where((F.col("far") <= reach) & (F.col("far") > 0))
    along = lambda u, sign: (1 + sign * dot3(way, [F.col(f"{u}{c}") for c in "xyz"]) / F.col("far")) / 2
    rows = rows.withColumn("score", along("u", 1) * along("w", -1) / F.col("far")).where(F.col("score") >= (1 / reach if least is None else least))
    pairs = materialise(rows.select(F.col("tip").alias("tip0"), "tip1", "v_id", "w_id", "score", *"xyzd", *(f"q{c}" for c in "xyzd"), *(f"{u}{c}" for u in "uw" for c in "xyz")), "pairs")
    live, taken = pairs.select("tip0", "tip1", "score"), []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        best = live.groupBy("tip0").agg(F.max_by("tip1", F.struct("score", -F.col("tip1"))).alias("tip1"))
        earliest = live.groupBy("tip1").agg(F.min("tip0").alias("lo"))
        won = best.join(earliest, "tip1").where("lo = tip0").join(earliest.select(F.col("tip1").alias("tip0")), "tip0", "left_anti")
        won = materialise(won.select("tip0", "tip1"), "won")
        taken.append(won)
        gone = won.select(F.explode(F.array("tip0", "tip1")).alias("t"))
        for c in ("tip0", "tip1"):
            live = live.join(gone.withColumnRenamed("t", c), c, "left_anti")
        live = materialise(live, "live")
    else:
        raise RuntimeError("the joints did not come to an end")
    chosen = reduce(DataFrame.unionByName, taken, pairs.limit(0).select("tip0", "tip1"))

    def solve(batches):
        for b in batches:
            p0, p1, e0, e1 = (b[[f"{u}{c}" for c in "xyz"]].to_numpy() for u in ("", "q", "u", "w"))
            mid = joints(p0, p1, e0, e1)
            yield pd.DataFrame({"tip0": b["tip0"], "tip1": b["tip1"], "v0": b["v_id"], "v1": b["w_id"], "score": b["score"], "x": mid[:, 0], "y": mid[:, 1], "z": mid[:, 2], "d": (b["d"] + b["qd"]) / 2})

    return pairs.join(chosen, ["tip0", "tip1"], "left_semi").mapInPandas(solve, "tip0 long, tip1 long, v0 long, v1 long, score double, x double, y double, z double, d double")
