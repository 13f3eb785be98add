"""Networks: vertex (v_id, x, y, z), edge (e_id, v0, v1), point (e_id, seq, x, y, z, d)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexus.functions.geom import PI, cell, dist3, dot3, near_cells, norm3, sub3, xyz
from plexus.plans.components import connected_components
from plexus.plans.scratch import SMALL, drop, materialise


def by_edge():
    return Window.partitionBy("e_id").orderBy("seq")


def segments(point: DataFrame) -> DataFrame:
    """(e_id, seq, x, y, z, d, px, py, pz, pd): each point but the first, with its predecessor."""
    return point.select("e_id", "seq", "x", "y", "z", "d", *(F.lag(c).over(by_edge()).alias(f"p{c}") for c in "xyzd")).where("px is not null")


def edge_dimensions(point: DataFrame, pi: float = PI) -> DataFrame:
    """(e_id, npts, length, volume, mean_diam, equiv_diam) of each edge, over one shuffle."""
    step = dist3(xyz(), [F.col(f"p{a}") for a in "xyz"])
    rows = point.select("e_id", "x", "y", "z", "d", *(F.lag(c).over(by_edge()).alias(f"p{c}") for c in "xyzd")).withColumn("step", step)
    vol = pi * F.col("step") * (F.col("d") * F.col("d") / 4 + F.col("pd") * F.col("pd") / 4) / 2
    out = rows.groupBy("e_id").agg(F.count("*").alias("npts"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.coalesce(F.sum(vol), F.lit(0.0)).alias("volume"), F.avg("d").alias("mean_diam"))
    return out.withColumn("equiv_diam", F.when(F.col("length") > 0, 2 * F.sqrt(F.col("volume") / (pi * F.col("length")))))


def histogram(values: DataFrame, bin_: Column, weight: Column | None = None) -> DataFrame:
    """(bin, n, share[, weight, weight_share]) for every bin from 0 to one beyond the last that isn't empty."""
    sums = values.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), *([F.sum(weight).alias("weight")] if weight is not None else []))
    last = sums.agg(F.max("bin").alias("last"))
    bins = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 1)).alias("bin"))
    total = Window.partitionBy()
    out = bins.join(sums, "bin", "left").fillna(0)
    cols = ["bin", "n", (F.col("n") / F.sum("n").over(total)).alias("share")]
    if weight is not None:
        cols += ["weight", (F.col("weight") / F.sum("weight").over(total)).alias("weight_share")]
    return out.select(*cols)


def select_diameter(point: DataFrame, lo: float, hi: float, how: str = "mean") -> DataFrame:
    """e_id of edges by diameter: mean within [lo, hi], or a majority or all of the points within [lo, hi).

    The mean counts to nine decimals, as the last bits of a sum depend on the
    order of its rows, and a mean that equals lo or hi shall be in whatever the order.
    """
    d = F.col("d")
    agg = point.groupBy("e_id").agg(F.avg(d).alias("m"), F.count(F.when((d >= lo) & (d < hi), 1)).alias("k"), F.count("*").alias("n"))
    test = {"mean": F.round("m", 9).between(lo, hi), "majority": F.col("k") > F.floor(F.col("n") / 2), "all": F.col("k") == F.col("n")}[how]
    return agg.where(test).select("e_id")


def endpoints(edge: DataFrame, vertex: DataFrame) -> DataFrame:
    a = vertex.select(F.col("v_id").alias("v0"), *(F.col(c).alias(f"{c}0") for c in "xyz"))
    b = vertex.select(F.col("v_id").alias("v1"), *(F.col(c).alias(f"{c}1") for c in "xyz"))
    return edge.join(a, "v0").join(b, "v1")


def touching(edge: DataFrame, vertex: DataFrame, test: Column) -> DataFrame:
    """Edges either end of which is at a vertex that passes ``test``."""
    inside = vertex.where(test).select("v_id")
    ends = edge.select("e_id", F.col("v0").alias("v_id")).unionByName(edge.select("e_id", F.col("v1").alias("v_id")))
    return edge.join(ends.join(inside, "v_id", "left_semi").select("e_id"), "e_id", "left_semi")


def in_sphere(centre, radius: float, strict: bool = False) -> Column:
    c = [F.lit(float(v)) for v in centre]
    d2 = dot3(sub3(xyz(), c), sub3(xyz(), c))
    return d2 < radius * radius if strict else d2 <= radius * radius


def in_cube(centre, radius: float) -> Column:
    out = F.lit(True)
    for a, c in zip("xyz", centre, strict=True):
        out = out & (F.abs(F.col(a) - float(c)) <= radius)
    return out


def half_space_blocks(edge: DataFrame, vertex: DataFrame, cuts: tuple[float | None, float | None, float | None]) -> DataFrame:
    """(block, e_id): the closed half-space blocks that an edge has an end in; a vertex on a cut is in both."""
    rows = vertex.select("v_id", "x", "y", "z", F.lit(0).alias("block"))
    for i, (a, c) in enumerate(zip("xyz", cuts, strict=True)):
        if c is not None:
            sides = F.array_compact(F.array(F.when(F.col(a) <= c, 0), F.when(F.col(a) >= c, 1 << i)))
            rows = rows.withColumn("s", F.explode(sides)).select("v_id", "x", "y", "z", (F.col("block") + F.col("s")).alias("block"))
    ends = edge.select("e_id", F.col("v0").alias("v_id")).unionByName(edge.select("e_id", F.col("v1").alias("v_id")))
    return ends.join(rows.select("v_id", "block"), "v_id").select("block", "e_id").distinct()


def degree(edge: DataFrame) -> DataFrame:
    """(v_id, n_links); a loop counts twice."""
    return edge.select(F.explode(F.array("v0", "v1")).alias("v_id")).groupBy("v_id").agg(F.count("*").alias("n_links"))


def loose_ends(edge: DataFrame) -> DataFrame:
    """edge with free0, free1: whether an end has no other edge."""
    n = degree(edge)
    a, b = (n.select(F.col("v_id").alias(v), (F.col("n_links") == 1).alias(f"free{i}")) for i, v in enumerate(("v0", "v1")))
    return edge.join(a, "v0").join(b, "v1")


def prune(edge: DataFrame, point: DataFrame, ratio: float, limit: float, cycles: int = 1, least_diam: float = 0.0) -> DataFrame:
    """Drop edges with a loose end whose length is at most ``limit``, or at most ``ratio`` times the mean diameter; ``cycles`` times.

    Edges whose equivalent diameter is less than ``least_diam`` go before all that.
    """
    size = materialise(edge_dimensions(point).select("e_id", "length", "mean_diam", "equiv_diam"), "sizes")
    if least_diam > 0:
        edge = materialise(edge.join(size.where(F.col("equiv_diam") < least_diam).select("e_id"), "e_id", "left_anti"), "thick")
    for _ in range(cycles):
        loose = loose_ends(edge).where("free0 or free1").join(size, "e_id")
        gone = loose.where((F.col("length") <= limit) | (F.col("length") <= ratio * F.col("mean_diam"))).select("e_id")
        edge = materialise(edge.join(gone, "e_id", "left_anti"), "pruned")
    return edge


def parallel_edges(edge: DataFrame, point: DataFrame) -> DataFrame:
    """Of edges between the same two vertices the one of the largest mean diameter, then the least e_id."""
    d = point.groupBy("e_id").agg(F.avg("d").alias("m"))
    best = edge.join(d, "e_id").groupBy(F.least("v0", "v1").alias("a"), F.greatest("v0", "v1").alias("b"))
    return best.agg(F.max_by("e_id", F.struct("m", -F.col("e_id"))).alias("e_id")).select("e_id")


def edge_components(edge: DataFrame) -> DataFrame:
    """(e_id, component): the least v_id reachable."""
    labels = connected_components(edge, "v0", "v1")
    return edge.select("e_id", F.col("v0").alias("node")).join(labels, "node").select("e_id", F.col("label").alias("component"))


def largest_component(edge: DataFrame) -> DataFrame:
    """e_id of the component with the most edges, then the least id."""
    c = materialise(edge_components(edge), "components")
    first = c.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return c.join(F.broadcast(first), "component", "left_semi").select("e_id")


def fragments(edge: DataFrame, least: int) -> DataFrame:
    """e_id of edges in components of at least ``least`` edges."""
    c = materialise(edge_components(edge), "components")
    return c.join(c.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component"), "component", "left_semi").select("e_id")


def contract_chains(edge: DataFrame) -> DataFrame:
    """(e_id, chain): edges that meet at vertices of two links belong to one chain, named by its least e_id."""
    inner = degree(edge).where("n_links = 2").select("v_id")
    ends = edge.where("v0 <> v1").select("e_id", F.explode(F.array("v0", "v1")).alias("v_id")).join(inner, "v_id", "left_semi")
    links = ends.groupBy("v_id").agg(F.min("e_id").alias("a"), F.max("e_id").alias("b")).select("a", "b")
    found = connected_components(links)
    return edge.select("e_id").join(found, edge["e_id"] == found["node"], "left").select("e_id", F.coalesce("label", "e_id").alias("chain"))


def joined_vertices(edge: DataFrame) -> DataFrame:
    """v_id of the vertices at which two edges become one: those of two links, but for loops, and for the least vertex of a ring that has no other end."""
    inner = degree(edge).where("n_links = 2").select("v_id").join(edge.where("v0 = v1").select(F.col("v0").alias("v_id")), "v_id", "left_anti")
    inner = materialise(inner, "inner")
    chain = contract_chains(edge)
    ends = edge.join(chain, "e_id").select("chain", F.explode(F.array("v0", "v1")).alias("v_id")).join(inner.withColumn("inner", F.lit(True)), "v_id", "left")
    rings = ends.groupBy("chain").agg(F.count(F.when(F.col("inner").isNull(), 1)).alias("open"), F.min("v_id").alias("v_id")).where("open = 0").select("v_id")
    return inner.join(rings, "v_id", "left_anti")


def ranked_chains(edge: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(e_id, k, chain, place): each edge's place in its chain, from 0.

    k is 0 if the edge is walked from v0 to v1. An edge is two darts, one each
    way; a dart's successor leaves the vertex that it leads to, if edges join
    there. Pointers are doubled until all point to their chain's end, so rounds
    are few however long a chain is. Of its two ways a chain is walked the one
    that begins at the lesser vertex, then with the lesser edge.
    """
    join = materialise(joined_vertices(edge), "joints")
    dart = lambda k: edge.select((2 * F.col("e_id") + k).alias("dart"), F.col(f"v{k}").alias("tail"), F.col(f"v{1 - k}").alias("head"))
    darts = dart(0).unionByName(dart(1))
    leave = darts.join(join, F.col("tail") == F.col("v_id"), "left_semi").select(F.col("tail").alias("head"), F.col("dart").alias("next"))
    step = darts.join(leave, "head", "left").where(F.col("next").isNull() | (F.floor(F.col("next") / 2) != F.floor(F.col("dart") / 2)))
    jump = materialise(step.select("dart", F.coalesce("next", "dart").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("rank")), "jump")
    for _ in range(max_rounds):
        over = jump.select(F.col("dart").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("rank2"))
        now = materialise(jump.join(over, "to").select("dart", F.col("to2").alias("to"), (F.col("rank") + F.col("rank2")).alias("rank")), "jump")
        same = now.agg(F.sum("rank")).first()[0] == jump.agg(F.sum("rank")).first()[0]
        drop(jump)
        jump = now
        if same:
            break
    else:
        raise RuntimeError("the chains did not come to an end")
    # The last dart turned around is the first of the other way.
    turned = (F.col("to") + 1 - 2 * (F.col("to") % 2)).alias("other")
    first = darts.select(F.col("dart").alias("other"), F.struct("tail", "dart").alias("other_start"))
    ends = jump.where("dart = to").select("dart", turned).join(first, "other").select(F.col("dart").alias("to"), "other_start")
    walks = jump.join(ends, "to").withColumn("e_id", F.floor(F.col("dart") / 2))
    both = walks.groupBy("e_id").agg(F.max(F.struct("other_start", "dart", "to", "rank")).alias("w"))
    own = both.select("e_id", (F.col("w.dart") % 2).cast("int").alias("k"), "w.to", "w.rank")
    name = own.groupBy("to").agg(F.min("e_id").alias("chain"), F.max("rank").alias("most"))
    return own.join(name, "to").select("e_id", "k", "chain", (F.col("most") - F.col("rank")).alias("place"))


def join_chains(edge: DataFrame, point: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge, point) in which edges that meet at a vertex of two links are one, with their points in order along the way.

    A chain has the least of its e_ids and the vertices of its two ends; the
    point that two edges share is there once (that of the earlier edge). Rings
    keep their least vertex, loops stay as they are.
    """
    walked = materialise(ranked_chains(edge), "walked")
    way = walked.join(edge, "e_id").select("chain", "place", F.when(F.col("k") == 0, F.col("v0")).otherwise(F.col("v1")).alias("a"), F.when(F.col("k") == 0, F.col("v1")).otherwise(F.col("v0")).alias("b"))
    edges = way.groupBy(F.col("chain").alias("e_id")).agg(F.min_by("a", "place").alias("v0"), F.max_by("b", "place").alias("v1"))
    n = point.groupBy("e_id").agg(F.count("*").alias("npts"))
    before = F.coalesce(F.sum(F.col("npts") - 1).over(Window.partitionBy("chain").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = walked.join(n, "e_id").withColumn("before", before)
    rows = point.withColumn("i", F.row_number().over(by_edge()) - 1).join(sized, "e_id")
    at = F.when(F.col("k") == 0, F.col("i")).otherwise(F.col("npts") - 1 - F.col("i"))
    rows = rows.withColumn("at", at).where("at > 0 or place = 0")
    return edges, rows.select(F.col("chain").alias("e_id"), (F.col("before") + F.col("at")).alias("seq"), "x", "y", "z", "d")


def trace(vox: DataFrame, size: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertex, edge, point) of a skeleton: voxels of other than two neighbours are vertices, the ways between them edges.

    Every pair of 26-neighbours is an edge of two points to begin with (numbered
    by the first voxel and the offset), then edges are joined. Diameters are
    0; vertices that no edge names are voxels without a neighbour.
    """
    from plexus.functions.geom import N13, offsets
    from plexus.operators.regions import voxel_id

    own = vox.select("x", "y", "z", voxel_id(size).alias("id"))
    turn = F.expr("CASE " + " ".join(f"WHEN dx = {a} AND dy = {b} AND dz = {c} THEN {i}" for i, (a, b, c) in enumerate(N13)) + " END")
    there = own.select("x", "y", "z", F.col("id").alias("v1"))
    links = offsets(own, N13).select((F.col("id") * len(N13) + turn).alias("e_id"), F.col("id").alias("v0"), *((F.col(a) + F.col(f"d{a}")).alias(a) for a in "xyz")).join(there, ["x", "y", "z"]).select("e_id", "v0", "v1")
    links = materialise(links, "links")
    place = own.select(F.col("id").alias("v_id"), *((F.col(a) * float(s)).alias(a) for a, s in zip("xyz", spacing, strict=True)))
    tips = links.select("e_id", F.posexplode(F.array("v0", "v1")).alias("seq", "v_id")).join(place, "v_id").select("e_id", F.col("seq").cast("long").alias("seq"), "x", "y", "z", F.lit(0.0).alias("d"))
    edge, point = join_chains(links, tips)
    return place, edge, point


def superfluous(edge: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """e_id of short ends and loops that one sweep takes away.

    A short end leads from a vertex of one link to one of three or more and is
    shorter than ``least``. A vertex loses short ends (those of the least loose
    vertices first) only as long as more than two links are left, as a way
    through it has no end there; and one loop, that of the least e_id, if it has
    three links or more.
    """
    n = degree(edge)
    a, b = (n.select(F.col("v_id").alias(v), F.col("n_links").alias(f"n{i}")) for i, v in enumerate(("v0", "v1")))
    both = edge.join(a, "v0").join(b, "v1")
    tip = F.when(F.col("n0") == 1, F.col("v0")).otherwise(F.col("v1"))
    foot = F.when(F.col("n0") == 1, F.col("v1")).otherwise(F.col("v0"))
    ends = both.where("(n0 = 1 and n1 > 2) or (n1 = 1 and n0 > 2)").join(sizes.select("e_id", "length"), "e_id").where(F.col("length") < least)
    ranked = ends.select("e_id", foot.alias("foot"), F.greatest("n0", "n1").alias("links"), F.row_number().over(Window.partitionBy(foot).orderBy(tip, "e_id")).alias("k"))
    loops = both.where("v0 = v1 and n0 > 2").groupBy("v0").agg(F.min("e_id").alias("e_id")).select("e_id")
    return ranked.where("k <= links - 2").select("e_id").unionByName(loops)


def strip(edge: DataFrame, point: DataFrame, least: float, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(edge, point) without short ends and loops, in ``rounds`` sweeps at most; after each the edges that meet at a vertex of two links are one."""
    edge, point = join_chains(edge, point)
    for _ in range(rounds):
        edge, point = materialise(edge, "stripped"), materialise(point, "points")
        gone = materialise(superfluous(edge, edge_dimensions(point), least), "superfluous")
        if gone.isEmpty():
            break
        edge, point = (t.join(gone, "e_id", "left_anti") for t in (edge, point))
        edge, point = join_chains(edge, point)
    return edge, point


def join_networks(parts: DataFrame, tolerance: float = 0.051) -> DataFrame:
    """Edges (block, e_id, x0.., x1..) of several blocks without repeats: of edges whose ends match within the tolerance, either way round, the first (block, e_id) stays.

    Ends are matched on a grid of the tolerance's size: an equi-join on 27 cells, then the exact test.
    """
    flip = parts.select("block", "e_id", *(F.col(f"{a}1").alias(f"{a}0") for a in "xyz"), *(F.col(f"{a}0").alias(f"{a}1") for a in "xyz"))
    own = parts.select("block", "e_id", *(F.col(f"{a}{i}") for i in "01" for a in "xyz"), *(cell(F.col(f"{a}0"), tolerance).alias(f"c{a}") for a in "xyz"))
    other = parts.select(*flip.columns).unionByName(flip).select(F.col("block").alias("b2"), F.col("e_id").alias("e2"), *(F.col(f"{a}{i}").alias(f"q{a}{i}") for i in "01" for a in "xyz"), *(cell(F.col(f"{a}0"), tolerance).alias(f"k{a}") for a in "xyz"))
    near = F.lit(True)
    for i in "01":
        for a in "xyz":
            near = near & (F.abs(F.col(f"{a}{i}") - F.col(f"q{a}{i}")) < tolerance)
    earlier = F.col("b2") < F.col("block")
    gone = near_cells(own).join(other, ["kx", "ky", "kz"]).where(near & earlier).select("block", "e_id").distinct()
    return parts.join(gone, ["block", "e_id"], "left_anti")


def bounding_box(vertex: DataFrame) -> DataFrame:
    return vertex.agg(*(f(a).alias(f"{a}_{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def vessel_density(edge: DataFrame, vertex: DataFrame, sizes: DataFrame, lo, hi, dmin: float, dmax: float) -> DataFrame:
    """(n_branch, length): branch points in a half-open box, and length of edges with both ends inside and diameter within [dmin, dmax]."""
    box = F.lit(True)
    for a, p, q in zip("xyz", lo, hi, strict=True):
        box = box & (F.col(a) >= p) & (F.col(a) < q)
    inside = vertex.where(box).select("v_id")
    branch = degree(edge).where("n_links >= 3").join(inside, "v_id", "left_semi").agg(F.count("*").alias("n_branch"))
    both = edge.join(inside.withColumnRenamed("v_id", "v0"), "v0", "left_semi").join(inside.withColumnRenamed("v_id", "v1"), "v1", "left_semi")
    length = both.join(sizes, "e_id").where(F.col("equiv_diam").between(dmin, dmax)).agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))
    return branch.crossJoin(length)  # one row each


def sites(edge: DataFrame, vertex: DataFrame, sizes: DataFrame, site: DataFrame) -> DataFrame:
    """Per site (site, x0, y0, z0, r): edges with an end strictly inside the sphere, per cubic millimetre.

    Sites and ends meet on grid cells as large as the largest radius.
    """
    size = site.agg(F.max("r")).first()[0] or 1.0
    around = near_cells(site.select("*", *(cell(F.col(f"{a}0"), size).alias(f"c{a}") for a in "xyz"))).drop("cx", "cy", "cz")
    ends = edge.select("e_id", F.explode(F.array("v0", "v1")).alias("v_id")).join(vertex, "v_id").join(sizes.select("e_id", "length", "volume"), "e_id")
    d2 = sum(((F.col(a) - F.col(f"{a}0")) * (F.col(a) - F.col(f"{a}0")) for a in "xyz"), F.lit(0.0))
    ends = ends.select("*", *(cell(F.col(a), size).alias(f"k{a}") for a in "xyz"))
    hit = ends.join(around, ["kx", "ky", "kz"]).where(d2 < F.col("r") * F.col("r"))
    per_edge = hit.groupBy("site", "r", "e_id").agg(F.first("length").alias("length"), F.first("volume").alias("volume"))
    f = F.lit(1e9) / (4.0 / 3.0 * PI * F.pow("r", F.lit(3.0)))
    return per_edge.groupBy("site", "r").agg(F.count("*").alias("n"), F.sum("length").alias("len"), F.sum("volume").alias("vol")).select("site", (F.col("n") * f).alias("vess_per_mm3"), (F.col("len") * f).alias("len_per_mm3"), (F.col("vol") * f / 1e9).alias("vol_fraction"))


def fibres(edge: DataFrame, vertex: DataFrame) -> DataFrame:
    """(e_id, v0, v1, length_direct, ux, uy, uz)."""
    e = endpoints(edge, vertex)
    d = [F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"]
    n = norm3(d)
    return e.select("e_id", "v0", "v1", n.alias("length_direct"), *((c / n).alias(f"u{a}") for c, a in zip(d, "xyz", strict=True)))


def branch_angles(edge: DataFrame, vertex: DataFrame, width: float = 4.0) -> DataFrame:
    """(bin, n) of the angles between ordered pairs of fibres at vertices of three or more."""
    f = fibres(edge, vertex).where("length_direct > 0")
    out = f.select("e_id", F.col("v0").alias("v_id"), "ux", "uy", "uz").unionByName(f.select("e_id", F.col("v1").alias("v_id"), *((-F.col(f"u{a}")).alias(f"u{a}") for a in "xyz")))
    out = out.join(degree(edge).where("n_links >= 3").select("v_id"), "v_id", "left_semi")
    other = out.select("v_id", F.col("e_id").alias("e2"), *(F.col(f"u{a}").alias(f"w{a}") for a in "xyz"))
    pairs = out.join(other, "v_id").where("e_id <> e2")  # pairs at one junction: its degree squared, and degrees are small
    c = F.greatest(F.least(dot3([F.col(f"u{a}") for a in "xyz"], [F.col(f"w{a}") for a in "xyz"]), F.lit(1.0)), F.lit(-1.0))
    return pairs.groupBy(F.floor(F.degrees(F.acos(c)) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def direction_projection(edge: DataFrame, vertex: DataFrame) -> DataFrame:
    """(dx, dy, dz, mean): half the mean of |u . v| over fibres for each of 26 directions."""
    from plexus.functions.geom import N26, offsets

    f = offsets(fibres(edge, vertex).where("length_direct > 0"), N26)
    n = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    p = F.abs(dot3([F.col(f"u{a}") for a in "xyz"], [F.col(f"d{a}") for a in "xyz"])) / n
    return f.groupBy("dx", "dy", "dz").agg((F.sum(p) / (2 * F.count("*"))).alias("mean"))


def nearest_unconnected(edge: DataFrame, vertex: DataFrame, size: float) -> DataFrame:
    """(v_id, nearest, d2): the nearest vertex of the same cell that no edge joins to it."""
    own = vertex.select("v_id", "x", "y", "z", *(cell(F.col(a), size).alias(f"c{a}") for a in "xyz"))
    other = own.select(F.col("v_id").alias("w_id"), *(F.col(a).alias(f"q{a}") for a in "xyz"), "cx", "cy", "cz")
    pairs = own.join(other, ["cx", "cy", "cz"]).where("v_id <> w_id")
    linked = edge.select(F.col("v0").alias("v_id"), F.col("v1").alias("w_id")).unionByName(edge.select(F.col("v1").alias("v_id"), F.col("v0").alias("w_id"))).distinct()
    d2 = dot3(sub3(xyz(), [F.col(f"q{a}") for a in "xyz"]), sub3(xyz(), [F.col(f"q{a}") for a in "xyz"]))
    near = pairs.join(linked, ["v_id", "w_id"], "left_anti").groupBy("v_id").agg(F.min(F.struct(d2.alias("d2"), F.col("w_id"))).alias("m"))
    return near.select("v_id", F.col("m.w_id").alias("nearest"), F.col("m.d2").alias("d2"))


def jump_points(edge: DataFrame, point: DataFrame, size: float) -> DataFrame:
    """(e_id, seq, to_edge, to_seq, dist): of each edge's inner points the one nearest to a point of an edge that no vertex joins to it.

    Only points of the same grid cell are compared. Inner points that lie on
    such a point (distance 0) don't count; of equal ones the first stays, and
    leads to the least (e_id, seq). Edges without such a point aren't there.

    All edges look within a small radius first. An edge that finds a point there
    is settled, as its other points have none nearer; the rest look within twice
    the radius, up to the cell's diagonal.
    """
    last = Window.partitionBy("e_id")
    rows = point.select("e_id", "seq", *"xyz", F.max("seq").over(last).alias("last")).join(edge.select("e_id", "v0", "v1"), "e_id")
    rows = materialise(rows.select("e_id", "seq", "v0", "v1", *"xyz", (F.expr("seq > 0 and seq < last")).alias("inner"), *(cell(F.col(a), size).alias(f"c{a}") for a in "xyz")), "points")
    box = rows.agg(F.count("*"), *(F.max(a) - F.min(a) for a in "xyz")).first()
    wide = [w for w in box[1:] if w]
    most = 2.0 * size  # more than the diagonal
    radius = min(most, 0.5 * (math.prod(wide) / box[0]) ** (1 / len(wide))) if wide else most
    # Parts of the cells, so that a point's part and the few others that its radius touches hold all that it may meet.
    parts = lambda: max(1, int(size / (8 * radius)))
    part = lambda v, a, k: (F.col(f"c{a}") * k + F.greatest(F.least(F.floor((v - F.col(f"c{a}") * float(size)) * (k / size)), F.lit(k - 1)), F.lit(0))).cast("long")
    # Crowds in a wide box: halved until a point meets no more than some hundred others, on the average.
    while radius > size * 1e-3:
        cells = rows.groupBy(*(part(F.col(a), a, parts()).alias(f"f{a}") for a in "xyz")).agg((F.count("*").cast("double") * F.count(F.when(F.col("inner"), 1))).alias("n"))
        if (cells.agg(F.sum("n")).first()[0] or 0) <= 400 * box[0]:
            break
        radius /= 2
    fine = [f"f{a}" for a in "xyz"]
    other = rows.select(F.col("e_id").alias("to_edge"), F.col("seq").alias("to_seq"), F.col("v0").alias("w0"), F.col("v1").alias("w1"), *(F.col(a).alias(f"q{a}") for a in "xyz"), "cx", "cy", "cz")
    apart = "e_id <> to_edge and v0 <> w0 and v0 <> w1 and v1 <> w0 and v1 <> w1"
    d2 = dot3(sub3(xyz(), [F.col(f"q{a}") for a in "xyz"]), sub3(xyz(), [F.col(f"q{a}") for a in "xyz"]))
    inner, found = rows.where("inner").drop("inner"), []
    while True:
        own, there, k = inner, other, parts()
        for a in "xyz":
            own = own.select("*", F.explode(F.sequence(part(F.col(a) - radius, a, k), part(F.col(a) + radius, a, k))).alias(f"f{a}"))
            there = there.withColumn(f"f{a}", part(F.col(f"q{a}"), a, k))
        pairs = own.drop("cx", "cy", "cz").join(there.drop("cx", "cy", "cz"), fine).where(apart).withColumn("d2", d2)
        if radius < most:
            pairs = pairs.where(F.col("d2") <= radius * radius)
        near = pairs.groupBy("e_id", "seq").agg(F.min(F.struct("d2", "to_edge", "to_seq")).alias("m"))
        best = near.where("m.d2 > 0").groupBy("e_id").agg(F.min(F.struct(F.col("m.d2").alias("d2"), "seq", F.col("m.to_edge").alias("to_edge"), F.col("m.to_seq").alias("to_seq"))).alias("b"))
        found.append(materialise(best.select("e_id", "b.seq", "b.to_edge", "b.to_seq", F.sqrt("b.d2").alias("dist")), "best"))
        if radius >= most:
            return reduce(DataFrame.unionByName, found)
        inner = materialise(inner.join(found[-1].select("e_id"), "e_id", "left_anti"), "open")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        radius = min(most, 2 * radius)


def dense_ids(df: DataFrame, key: str, name: str, block: int = 100_000) -> DataFrame:
    """``df`` with a column ``name``: 0, 1, 2, ... by the whole-number column ``key``, which has no repeats.

    Ranks are counted within blocks of keys and added to what the blocks before
    hold, so no task sorts more than ``block`` rows; the window over all is one
    over the blocks' counts.
    """
    part = F.floor(F.col(key) / block)
    counts = df.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    ranked = df.withColumn("__part", part).withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1)
    return ranked.join(before, "__part").withColumn(name, F.col("__before") + F.col("__rank")).drop("__part", "__rank", "__before")


def squeeze(edge: DataFrame, vertex: DataFrame, point: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertex, edge, point) with ids from 0: edges by e_id without loops, vertices in the order in which edges (v0, then v1) name them; the rest goes."""
    kept = materialise(dense_ids(edge.where("v0 <> v1"), "e_id", "e"), "kept")
    seen = kept.select((2 * F.col("e")).alias("first"), F.col("v0").alias("v_id")).unionByName(kept.select((2 * F.col("e") + 1).alias("first"), F.col("v1").alias("v_id")))
    ids = materialise(dense_ids(seen.groupBy("v_id").agg(F.min("first").alias("first")), "first", "v").select("v_id", "v"), "ids")
    ends = kept.join(ids.select(F.col("v_id").alias("v0"), F.col("v").alias("a")), "v0").join(ids.select(F.col("v_id").alias("v1"), F.col("v").alias("b")), "v1")
    edges = ends.select(F.col("e").alias("e_id"), F.col("a").alias("v0"), F.col("b").alias("v1"))
    vertices = vertex.join(ids, "v_id").select(F.col("v").alias("v_id"), "x", "y", "z")
    points = point.join(kept.select("e_id", "e"), "e_id").select(F.col("e").alias("e_id"), "seq", "x", "y", "z", "d")
    return vertices, edges, points


def check_network(edge: DataFrame, vertex: DataFrame, point: DataFrame) -> DataFrame:
    """(n_edges, n_loops, n_moved, n_repeats): edges, those that begin and end at one vertex, those whose first or last point isn't at its vertex, and those beyond the first between two vertices."""
    last = point.groupBy("e_id").agg(F.min_by(F.struct("x", "y", "z"), "seq").alias("p"), F.max_by(F.struct("x", "y", "z"), "seq").alias("q"))
    ends = endpoints(edge, vertex).join(last, "e_id", "left")
    at = lambda s, i: F.struct(*(F.col(f"{a}{i}").alias(a) for a in "xyz")).eqNullSafe(F.col(s))
    once = F.struct(F.least("v0", "v1"), F.greatest("v0", "v1"))
    one = ends.select("e_id", (F.col("v0") == F.col("v1")).alias("loop"), (~(at("p", 0) & at("q", 1))).alias("moved"), once.alias("pair"))
    pairs = one.groupBy("pair").agg(F.count("*").alias("n"), F.count(F.when(F.col("loop"), 1)).alias("loops"), F.count(F.when(F.col("moved"), 1)).alias("moved"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return pairs.agg(zero("n").alias("n_edges"), zero("loops").alias("n_loops"), zero("moved").alias("n_moved"), zero(F.col("n") - 1).alias("n_repeats"))


def sprout_network(edge: DataFrame, vertex: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertex, edge) of the edges with a loose end, each with two vertices of its own (2 e_id and 2 e_id + 1); ``keep`` (e_id) restricts them."""
    loose = loose_ends(edge).where("free0 or free1")
    loose = loose if keep is None else loose.join(keep.select("e_id"), "e_id", "left_semi")
    edges = loose.select("e_id", (2 * F.col("e_id")).alias("v0"), (2 * F.col("e_id") + 1).alias("v1"))
    ends = loose.select("e_id", F.posexplode(F.array("v0", "v1")).alias("k", "v_id")).join(vertex, "v_id")
    return ends.select((2 * F.col("e_id") + F.col("k")).alias("v_id"), "x", "y", "z"), edges


def dead_tips(edge: DataFrame, vertex: DataFrame) -> DataFrame:
    """(v_id, back, x, y, z, gx, gy, gz): the vertices of one link with the vertex at the edge's other end and the way from there."""
    tip = degree(edge).where("n_links = 1").select("v_id")
    both = edge.select(F.col("v1").alias("v_id"), F.col("v0").alias("back")).unionByName(edge.select(F.col("v0").alias("v_id"), F.col("v1").alias("back")))
    from_ = vertex.select(F.col("v_id").alias("back"), *(F.col(a).alias(f"b{a}") for a in "xyz"))
    ends = both.join(tip, "v_id", "left_semi").join(vertex.select("v_id", *"xyz"), "v_id").join(from_, "back")
    return ends.select("v_id", "back", *"xyz", *((F.col(a) - F.col(f"b{a}")).alias(f"g{a}") for a in "xyz"))


def heal(edge: DataFrame, vertex: DataFrame, max_len: float) -> DataFrame:
    """(v_id, target, score): each dead end's vertex of the best (0.5 + cos) / distance within max_len, its own edge's ends excluded.

    A vertex at a distance scores 1.5 / distance at most. So dead ends look
    within a small radius first, and only those whose best score so far could
    be met beyond it look again within two or four times the radius, up to ``max_len``.
    Vertices of one place count as the two of the least ids, as others never win.
    """
    todo = materialise(dead_tips(materialise(edge.select("v0", "v1"), "edges"), vertex), "tips")
    if todo.isEmpty():
        return todo.select("v_id", F.col("back").alias("target"), F.col("x").alias("score"))
    place = materialise(vertex.groupBy("x", "y", "z").agg(F.min("v_id").alias("t0"), F.max("v_id").alias("t1"), F.count("*").alias("n")), "places")
    if not place.where("n > 2").isEmpty():
        rest = vertex.join(place.where("n > 2").select(*"xyz", "t0"), [*"xyz"]).where("v_id > t0").groupBy(*"xyz").agg(F.min("v_id").alias("second"))
        place = materialise(place.join(rest, [*"xyz"], "left").select(*"xyz", "t0", F.coalesce("second", "t1").alias("t1")), "places")
    to = place.select(*(F.col(a).alias(f"q{a}") for a in "xyz"), "t0", "t1")
    box = to.agg(F.count("*"), *(F.max(f"q{a}") - F.min(f"q{a}") for a in "xyz")).first()
    wide = [w for w in box[1:] if w]
    radius = min(max_len, 1.2 * (math.prod(wide) / box[0]) ** (1 / len(wide))) if wide else max_len
    # Crowds in a wide box: halved until a place has no more than some hundred others in its cell, on the average.
    while radius > max(wide, default=0) * 1e-6:
        cells = to.groupBy(*(cell(F.col(f"q{a}"), 4 * radius) for a in "xyz")).agg(F.count("*").cast("double").alias("n"))
        if (cells.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) <= 400 * box[0]:
            break
        radius /= 2
    way, g = [F.col(f"q{a}") - F.col(a) for a in "xyz"], [F.col(f"g{a}") for a in "xyz"]
    target = F.when(F.col("t0") != F.col("back"), F.col("t0")).when(F.col("t1") != F.col("t0"), F.col("t1"))
    score = (0.5 + dot3(way, g) / (F.col("d") * norm3(g))) / F.col("d")
    found = []
    while True:
        side = 4 * radius
        own = todo
        for a in "xyz":
            own = own.select("*", F.explode(F.sequence(cell(F.col(a) - radius, side), cell(F.col(a) + radius, side))).alias(f"k{a}"))
        few = todo.count() <= SMALL // 4
        if few:
            own = F.broadcast(own)
        there = to.select("*", *(cell(F.col(f"q{a}"), side).alias(f"k{a}") for a in "xyz"))
        near = there.join(own, ["kx", "ky", "kz"]).withColumn("d", norm3(way)).where((F.col("d") <= radius) & (F.col("d") > 0)).select("v_id", target.alias("target"), score.alias("score"))
        best = near.where("score > 0 and target is not null").groupBy("v_id").agg(F.max_by(F.struct("target", "score"), F.struct("score", -F.col("target"))).alias("m"))
        looked = materialise(todo.join(best, "v_id", "left"), "looked")
        # No vertex beyond the radius scores as much; the margin is for rounding.
        sure = F.lit(True) if radius >= max_len else F.coalesce(F.col("m.score") * radius > 1.5 * (1 + 1e-9), F.lit(False))
        found.append(looked.where(sure & F.col("m").isNotNull()).select("v_id", F.col("m.target").alias("target"), F.col("m.score").alias("score")))
        drop(todo)
        todo = materialise(looked.where(~sure).drop("m"), "open")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, found)
        radius = min(max_len, (4 if few else 2) * radius)


def shortest_paths(edge: DataFrame, sizes: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(v_id, distance, parent): least sums of floor(10 * length) from any root, divided by 10; of equal ways that of the fewest arcs, then of the least parent.

    An arc may have no length, so arcs are counted too: else parents could lead around in a ring.

    Only the vertices that the last round improved send on (a frontier);
    every round is a partial aggregate and a join with the arcs.
    """
    w = edge.where("v0 <> v1").join(sizes.select("e_id", "length"), "e_id").select("v0", "v1", F.floor(F.col("length") * 10).cast("long").alias("w"))
    arcs = materialise(w.select(F.col("v0").alias("a"), F.col("v1").alias("b"), "w").unionByName(w.select(F.col("v1").alias("a"), F.col("v0").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w")), "arcs")
    known = materialise(roots.select("v_id", F.lit(0).cast("long").alias("dist"), F.lit(0).cast("long").alias("arcs"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("fresh")), "known")
    for _ in range(max_rounds):
        sent = known.where("fresh").join(arcs, F.col("v_id") == F.col("a")).select(F.col("b").alias("v_id"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("arcs") + 1).alias("arcs"), F.col("a").alias("parent"))
        best = sent.groupBy("v_id").agg(F.min(F.struct("dist", "arcs", "parent")).alias("n"))
        old = known.select("v_id", F.struct("dist", "arcs", "parent").alias("o"))
        both = old.join(best, "v_id", "full")
        better = F.col("o").isNull() | (F.col("n") < F.col("o"))
        fresh = F.coalesce(F.col("n").isNotNull() & better, F.lit(False))
        now = materialise(both.select("v_id", F.when(fresh, F.col("n")).otherwise(F.col("o")).alias("s"), fresh.alias("fresh")).select("v_id", "s.dist", "s.arcs", "s.parent", "fresh"), "known")
        drop(known)
        known = now
        if known.where("fresh").isEmpty():
            break
    else:
        raise RuntimeError("shortest paths did not converge")
    return known.select("v_id", (F.col("dist") / 10).alias("distance"), "parent")


def even_vertices(edge: DataFrame, sizes: DataFrame, ratio_limit: float) -> DataFrame:
    """v_id of the vertices whose edges' mean diameters are alike: the largest is less than ``ratio_limit`` times the least."""
    d = edge.join(sizes.select("e_id", "mean_diam"), "e_id").select(F.explode(F.array("v0", "v1")).alias("v_id"), "mean_diam")
    return d.groupBy("v_id").agg((F.max("mean_diam") / F.min("mean_diam")).alias("ratio")).where(F.col("ratio") < ratio_limit).select("v_id")


def branch_histogram(counts: DataFrame, most: int = 99) -> DataFrame:
    """(n_steps, n) of all vertices; the last bin takes all beyond."""
    return counts.groupBy(F.least("n_steps", F.lit(most)).cast("long").alias("n_steps")).agg(F.count("*").alias("n"))


def edges_of_paths(edge: DataFrame, counts: DataFrame, paths: DataFrame) -> DataFrame:
    """(e_id, n_steps, distance): the lesser of an edge's two ends; null if no way leads there."""
    both = paths.select("v_id", "distance").join(counts, "v_id")
    ends = edge.select("e_id", F.explode(F.array("v0", "v1")).alias("v_id")).join(both, "v_id", "left")
    return ends.groupBy("e_id").agg(F.min("n_steps").alias("n_steps"), F.min("distance").alias("distance"))


def branch_counts(paths: DataFrame, counted: DataFrame | None = None, max_rounds: int = 40) -> DataFrame:
    """(v_id, n_steps): the number of steps to the root, by doubling of the parent pointers; only steps from the vertices ``counted`` (v_id), if given."""
    own = paths.select("v_id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("n"))
    if counted is not None:
        own = own.join(counted.select("v_id", F.lit(True).alias("ok")), "v_id", "left").select("v_id", "up", F.when(F.col("ok"), F.col("n")).otherwise(0).cast("long").alias("n"))
    jump = materialise(own, "jump")
    for _ in range(max_rounds):
        if jump.where("up is not null").isEmpty():
            return jump.select("v_id", F.col("n").alias("n_steps"))
        over = jump.select(F.col("v_id").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"))
        now = materialise(jump.join(over, "up", "left").select("v_id", F.col("up2").alias("up"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "jump")
        drop(jump)
        jump = now
    raise RuntimeError("the parents form a cycle")
