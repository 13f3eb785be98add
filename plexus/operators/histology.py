"""Planes through a network and its tissue: vessels, vessel pixels and tissue pixels by slice, and densities within a block.

Segments are (e_id, seq, ..., px, ...) as ``network.segments`` gives them; the
tissue is a table of lit voxels (x, y, z), from 0. Slices and blocks count
tissue voxels from 1, so that slice n holds the voxels n - 1; a slice's plane
lies at n times the voxel size. A block is ((x0, x1), (y0, y1), (z0, z1)) in
such numbers, both ends included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexus.functions.geom import dist3, xyz
from plexus.operators.network import segments

#: For each axis the two others, in the order in which a slice across it is drawn.
ACROSS = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
#: The sine of the least angle between a vessel and a plane.
LEAST_SINE = math.sin(math.pi / 12)


def whole(value: Column) -> Column:
    """Towards zero."""
    return value.cast("long")


def crossings(point: DataFrame, size: tuple[int, int, int], voxel: tuple[float, float, float], axes: str, block=None) -> DataFrame:
    """A row for each segment and plane that it crosses, half-open towards its second end: axis, slice, the ends (px, py, pz, qx, qy, qz) with z across the plane, d, the place x0, y0 in the plane, and the plane's pixels (sx, sy; from lx, ly up to hx, hy).

    Segments are made once for all axes. The planes of a segment come from its
    own extent, so rows are in proportion to vessels' length over the planes'
    distance.
    """
    at = dict(zip("xyz", range(3), strict=True))
    turns = []
    for axis in axes:
        k, i, j = (at[a] for a in (axis, *ACROSS[axis]))
        lo, hi = block[k] if block else (1, size[k])
        pixels = [(max(0, block[n][0]), min(size[n], block[n][1])) if block else (0, size[n]) for n in (i, j)]
        names = ["xyz"[n] for n in (i, j, k)]
        turns.append(F.struct(
            F.lit(axis).alias("axis"), *(F.col(f"p{c}").alias(f"p{n}") for c, n in zip(names, "xyz", strict=True)), *(F.col(c).alias(f"q{n}") for c, n in zip(names, "xyz", strict=True)),
            F.lit(float(voxel[i])).alias("sx"), F.lit(float(voxel[j])).alias("sy"), F.lit(float(voxel[k])).alias("sz"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
            *(F.lit(v).alias(n) for n, v in zip(("lx", "hx", "ly", "hy"), (*pixels[0], *pixels[1]), strict=True)),
            *(F.lit(v).alias(n) for n, v in zip(("bx0", "bx1", "by0", "by1"), (*block[i], *block[j]) if block else (0, 0, 0, 0), strict=True)),
        ))
    seg = segments(point).withColumn("t", F.explode(F.array(*turns))).select("t.*", ((F.col("d") + F.col("pd")) / 2).alias("d"))
    first = F.greatest(F.floor(F.least("pz", "qz") / F.col("sz")), "lo").cast("long")
    last = F.least(F.ceil(F.greatest("pz", "qz") / F.col("sz")), "hi").cast("long")
    rows = seg.where(first <= last).withColumn("slice", F.explode(F.sequence(first, last)))
    z = F.col("slice") * F.col("sz")
    rows = rows.where(((F.col("pz") <= z) & (z < F.col("qz"))) | ((F.col("qz") < z) & (z <= F.col("pz"))))
    s = (z - F.col("pz")) / (F.col("qz") - F.col("pz"))
    rows = rows.select("*", *((F.col(f"p{n}") + s * (F.col(f"q{n}") - F.col(f"p{n}"))).alias(f"{n}0") for n in "xy"))
    if block:
        for n in "xy":
            rows = rows.where(whole(F.col(f"{n}0") / F.col(f"s{n}")).between(F.col(f"b{n}0"), F.col(f"b{n}1")))
    return rows


def sections(hit: DataFrame) -> DataFrame:
    """(axis, slice, n_vessels, n_vessel_pixels): crossings, and pixels within the ellipses (circles for vessels at right angles) that planes cut out of vessels; overlaps count again.

    A crossing is number -1 of its rows and the pixels around it are the
    others, so that one pass and one small aggregate count both.
    """
    ux, uy, uz = (F.col(f"q{n}") - F.col(f"p{n}") for n in "xyz")
    flat = F.sqrt(ux * ux + uy * uy)
    sine = F.greatest(F.abs(uz) / F.sqrt(ux * ux + uy * uy + uz * uz), F.lit(LEAST_SINE))
    e = hit.select("axis", "slice", "x0", "y0", "d", *(f"{a}{n}" for n in "xy" for a in "slh"), (flat == 0).alias("round"), F.when(flat == 0, 0.0).otherwise(ux / flat).alias("ux"), F.when(flat == 0, 0.0).otherwise(uy / flat).alias("uy"), (F.col("d") / 2 / sine).alias("a"), (F.col("d") / 2).alias("b"))
    e = e.withColumn("f", F.sqrt(F.greatest(F.col("a") * F.col("a") - F.col("b") * F.col("b"), F.lit(0.0))))
    for n, m in ("xy", "yx"):
        half = F.when(F.col("round"), F.col("d") / 2 + 1).otherwise(F.col("a") * F.abs(F.col(f"u{n}")) + F.col("b") * F.abs(F.col(f"u{m}")))
        first = F.greatest(whole((F.col(f"{n}0") - half) / F.col(f"s{n}")), F.col(f"l{n}").cast("long"))
        end = F.least(whole((F.col(f"{n}0") + half) / F.col(f"s{n}")), F.col(f"h{n}").cast("long"))
        e = e.withColumn(f"f{n}", first).withColumn(f"n{n}", F.greatest(end - first, F.lit(0)))
    e = e.withColumn("i", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("nx") * F.col("ny") - 1)))
    row = F.greatest("nx", F.lit(1))
    x, y = (F.col("fx") + F.col("i") % row) * F.col("sx"), (F.col("fy") + F.floor(F.col("i") / row)) * F.col("sy")
    e = e.select("axis", "slice", "i", "round", "x0", "y0", "d", "a", "f", "ux", "uy", x.alias("x"), y.alias("y"))

    def away(k: int) -> Column:
        dx, dy = (F.col(n) - (F.col(f"{n}0") + k * F.col("f") * F.col(f"u{n}")) for n in "xy")
        return F.sqrt(dx * dx + dy * dy)

    inside = F.when(F.col("round"), away(0) <= F.col("d") / 2).otherwise(away(1) + away(-1) <= 2 * F.col("a"))
    return e.groupBy("axis", "slice").agg(F.count(F.when(F.col("i") < 0, 1)).alias("n_vessels"), F.count(F.when((F.col("i") >= 0) & inside, 1)).alias("n_vessel_pixels"))


def in_block(close: DataFrame, block) -> DataFrame:
    for a, (lo, hi) in zip("xyz", block, strict=True):
        close = close.where(F.col(a).between(lo - 1, hi - 1))
    return close


def slice_histology(point: DataFrame, close: DataFrame, size: tuple[int, int, int], voxel: tuple[float, float, float], axes: str = "xyz", block=None) -> DataFrame:
    """(axis, slice, n_vessels, n_vessel_pixels, n_tissue_pixels, tissue_area) of every slice across the axes, zeros included.

    With a ``block`` only its slices are there, and vessels, pixels and tissue
    within it. A vessel counts if the pixel of its centre is in the block.
    Tables without rows give zeros; null coordinates never cross a plane.
    """
    spark = close.sparkSession
    spans = {a: block[i] if block else (1, size[i]) for i, a in enumerate("xyz")}
    areas = {a: math.prod(float(voxel["xyz".index(b)]) for b in ACROSS[a]) for a in axes}
    turns = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(spans[a][0]).alias("lo"), F.lit(spans[a][1]).alias("hi"), F.lit(areas[a]).alias("area")) for a in axes)))
    slices = spark.range(1).select(turns.alias("t")).select("t.axis", "t.area", F.explode(F.sequence(F.col("t.lo").cast("long"), F.col("t.hi").cast("long"))).alias("slice"))
    vessels = sections(crossings(point, size, voxel, axes, block))
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), (F.col(a) + 1).cast("long").alias("slice")) for a in axes)))
    tissue = (in_block(close, block) if block else close).select(at.alias("t")).groupBy("t.axis", "t.slice").agg(F.count("*").alias("n_tissue_pixels"))
    out = slices.join(vessels, ["axis", "slice"], "left").join(tissue, ["axis", "slice"], "left").fillna(0, ["n_vessels", "n_vessel_pixels", "n_tissue_pixels"])
    return out.select("axis", "slice", "n_vessels", "n_vessel_pixels", "n_tissue_pixels", (F.col("n_tissue_pixels") * F.col("area")).alias("tissue_area"))


def volume_histology(point: DataFrame, close: DataFrame, size: tuple[int, int, int], voxel: tuple[float, float, float], axes: str = "xyz", block=None) -> DataFrame:
    """(axis, n_vessels, n_vessel_pixels, n_tissue_pixels, tissue_area): means over an axis's slices; counts to the nearest whole number."""
    whole_mean = (F.floor(F.sum(c) / F.count("*") + 0.5).cast("long").alias(c) for c in ("n_vessels", "n_vessel_pixels", "n_tissue_pixels"))
    return slice_histology(point, close, size, voxel, axes, block).groupBy("axis").agg(*whole_mean, (F.sum("tissue_area") / F.count("*")).alias("tissue_area"))


def block_density(vertex: DataFrame, point: DataFrame, close: DataFrame, voxel: tuple[float, float, float], block, diameters: tuple[float, float] | None = None) -> DataFrame:
    """(n_branch, length, tissue_voxels, tissue_volume) within a block: its vertices, the segments that lie in it with both ends, and its tissue.

    The box of vertices and segments is half-open, from a block number times the
    voxel size to the other. With ``diameters`` both ends of a segment must have
    one within them.
    """
    def inside(names):
        out = F.lit(True)
        for n, (lo, hi), s in zip(names, block, voxel, strict=True):
            out = out & (F.col(n) >= lo * float(s)) & (F.col(n) < hi * float(s))
        return out

    seg = segments(point).where(inside("xyz") & inside(("px", "py", "pz")))
    if diameters:
        seg = seg.where(F.col("d").between(*diameters) & F.col("pd").between(*diameters))
    step = dist3(xyz(), [F.col(f"p{a}") for a in "xyz"])
    parts = [
        vertex.where(inside("xyz")).agg(F.count("*").alias("n_branch")),
        seg.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("length")),
        in_block(close, block).agg(F.count("*").alias("tissue_voxels")),
    ]
    one = parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
    return one.withColumn("tissue_volume", F.col("tissue_voxels") * float(voxel[0]) * float(voxel[1]) * float(voxel[2]))
