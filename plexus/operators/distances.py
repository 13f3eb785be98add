"""Distances between tissue, boundary and vessels, rasters and slices. Range joins go by grid cells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.functions.geom import capsule_distance, cell, dist3, dot3, near_cells, norm3, sub3, xyz
from plexus.operators.network import segments


def tissue_grid(spark, lo: tuple, hi: tuple, step: float) -> DataFrame:
    """Points of a regular grid, half a step inside the box."""
    n = [max(0, math.ceil((q - p) / step - 0.5)) for p, q in zip(lo, hi, strict=True)]
    i = spark.range(n[0] * n[1] * n[2])
    at = (F.col("id") % n[0], F.floor(F.col("id") / n[0]) % n[1], F.floor(F.col("id") / (n[0] * n[1])))
    return i.select(*((F.lit(float(p)) + (k + 0.5) * step).alias(a) for a, p, k in zip("xyz", lo, at, strict=True)))


def vessel_distance(points: DataFrame, point: DataFrame, block: float = 120.0) -> DataFrame:
    """(x, y, z, dist): the least distance of each point from the tapered segments whose midpoints lie in the 27 blocks around it."""
    seg = segments(point).select(*(F.col(a) for a in "xyz"), *(F.col(f"p{a}") for a in "xyz"), (F.col("d") / 2).alias("r"), (F.col("pd") / 2).alias("pr"))
    mid = seg.select(*(F.col(a).alias(f"q{a}") for a in "xyz"), *(F.col(f"p{a}") for a in "xyz"), "r", "pr", *(cell((F.col(a) + F.col(f"p{a}")) / 2, block).alias(f"k{a}") for a in "xyz"))
    own = near_cells(points.select(*xyz(), *(cell(F.col(a), block).alias(f"c{a}") for a in "xyz")))
    d = capsule_distance(xyz(), [F.col(f"p{a}") for a in "xyz"], [F.col(f"q{a}") for a in "xyz"], F.col("pr"), F.col("r"))
    return own.join(mid, ["kx", "ky", "kz"]).groupBy("x", "y", "z").agg(F.min(d).alias("dist"))


def distance_histogram(dist: DataFrame, width: float = 0.5, bins: int = 500) -> DataFrame:
    """(bin, n): bins from 1; inside points (0) don't count, the last bin takes all beyond."""
    return dist.where("dist > 0").groupBy(F.least(F.floor(F.col("dist") / width).cast("long") + 1, F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def boundary_distance(point: DataFrame, boundary: DataFrame, block: float = 60.0) -> DataFrame:
    """(e_id, seq, dist): the least distance of each segment's midpoint from the boundary points in the 27 blocks around it."""
    mid = segments(point).select("e_id", "seq", *(((F.col(a) + F.col(f"p{a}")) / 2).alias(a) for a in "xyz"))
    own = near_cells(mid.select("*", *(cell(F.col(a), block).alias(f"c{a}") for a in "xyz")))
    to = boundary.select(*(F.col(a).alias(f"q{a}") for a in "xyz"), *(cell(F.col(a), block).alias(f"k{a}") for a in "xyz"))
    return own.join(to, ["kx", "ky", "kz"]).groupBy("e_id", "seq").agg(F.min(dist3(xyz(), [F.col(f"q{a}") for a in "xyz"])).alias("dist"))


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all whole numbers from lo to hi of each row."""
    n = np.maximum(hi - lo + 1, 0)
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def solid(p: np.ndarray, q: np.ndarray, rp: np.ndarray, rq: np.ndarray, step: float) -> np.ndarray:
    """The distinct voxels (side ``step``) whose centres are in the end spheres of segments or the tapered tubes between them.

    Layer by layer across the axis that a segment runs along most: there a
    layer cuts the tube in an ellipse of at most sqrt(2) radii around the axis,
    so candidates are in proportion to length times thickness squared. Layers
    beyond an end are sought around the end, and as much farther as they are
    beyond it.
    """
    reach = np.maximum(rp, rq)
    main = np.abs(q - p).argmax(axis=1)
    order = (main[:, None] + np.arange(3)) % 3
    a, b = np.take_along_axis(p, order, 1), np.take_along_axis(q, order, 1)
    lo, hi = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    k, layer = ranges(np.ceil((lo - reach) / step).astype(np.int64), np.floor((hi + reach) / step).astype(np.int64))
    on = layer * step
    beyond = np.maximum(np.maximum(lo[k] - on, on - hi[k]), 0)
    span = b[k, 0] - a[k, 0]
    part = np.clip((on - a[k, 0]) / np.where(span == 0, 1, span), 0, 1) * (span != 0)
    half = reach[k] * math.sqrt(2) + beyond + 1e-9
    at = layer[:, None]
    for i in (1, 2):
        m = a[k, i] + (b[k, i] - a[k, i]) * part
        row, n = ranges(np.ceil((m - half) / step).astype(np.int64), np.floor((m + half) / step).astype(np.int64))
        k, part, half, at = k[row], part[row], half[row], np.column_stack((at[row], n))
    voxel = np.empty_like(at)
    np.put_along_axis(voxel, order[k], at, 1)
    w, axis = voxel * step - p[k], (q - p)[k]
    w2, l2, along = (w * w).sum(1), (axis * axis).sum(1), (w * axis).sum(1)
    t = along / np.where(l2 > 0, l2, 1)
    tube = (l2 > 0) & (t >= 0) & (t <= 1) & (w2 - t * t * l2 <= ((1 - t) * rp[k] + t * rq[k]) ** 2)
    e = w - axis
    return np.unique(voxel[(w2 <= rp[k] ** 2) | ((e * e).sum(1) <= rq[k] ** 2) | tube], axis=0)


def rasterise(point: DataFrame, step: float, candidates: int = 1_000_000) -> DataFrame:
    """(x, y, z): numbers of the voxels (side ``step``) whose centres are within a segment's end spheres or the tapered tube between them.

    Arrow batches of segments, of about ``candidates`` voxels at a time; a
    segment's voxels are many times its row, so they are made where it is read.
    """

    def over(batches):
        for t in batches:
            p, q = t[["px", "py", "pz"]].to_numpy(), t[["x", "y", "z"]].to_numpy()
            rp, rq = t["pd"].to_numpy() / 2, t["d"].to_numpy() / 2
            n = (np.abs(q - p).max(axis=1) / step + 2 * np.maximum(rp, rq) / step + 1) * (3 * np.maximum(rp, rq) / step + 1) ** 2
            group = (np.cumsum(n) // candidates).astype(np.int64)
            for g in np.unique(group):
                own = group == g
                v = solid(p[own], q[own], rp[own], rq[own], float(step))
                yield pd.DataFrame(v.astype(np.int32), columns=["x", "y", "z"])

    return segments(point).mapInPandas(over, "x int, y int, z int").distinct()


def rasterise_spheres(point: DataFrame, voxel: tuple[float, float, float], margin: float = 0.0) -> DataFrame:
    """(x, y, z, v): voxels less than a point's radius and the margin away from the point's own voxel, none below 0.

    A point makes the rows of its own box; they are few, as vessels are thin,
    and repeats go before the shuffle.
    """
    p = point.select(*(F.col(a).alias(f"p{a}") for a in "xyz"), (F.col("d") / 2 + float(margin)).alias("r"))
    out = p.select("r", *((F.col(f"p{a}") / float(s)).cast("int").alias(f"i{a}") for a, s in zip("xyz", voxel, strict=True))).distinct()
    d2 = F.lit(0.0)
    for a, s in zip("xyz", voxel, strict=True):
        n = (F.col("r") / float(s) + 1).cast("int")
        out = out.where(F.col(f"i{a}") + n >= 0).withColumn(a, F.explode(F.sequence(F.greatest(F.col(f"i{a}") - n, F.lit(0)), F.col(f"i{a}") + n)))
        away = (F.col(a) - F.col(f"i{a}")) * float(s)
        d2 = d2 + away * away
    return out.where(d2 < F.col("r") * F.col("r")).select("x", "y", "z", F.lit(255).alias("v")).distinct()


def slice_crossings(point: DataFrame, axis: str, at: float) -> DataFrame:
    """(n_crossings, area): segments that cross a plane, half-open towards their second end, and the ellipses' areas."""
    p, q = F.col(f"p{axis}"), F.col(axis)
    d = (F.col("d") + F.col("pd")) / 2
    cosine = F.abs(q - p) / norm3(sub3(xyz(), [F.col(f"p{a}") for a in "xyz"]))
    sine = F.greatest(cosine, F.lit(math.sin(math.pi / 12)))  # of the angle between axis and plane, pi / 12 at least
    hit = segments(point).where(((p <= at) & (F.lit(at) < q)) | ((q < at) & (F.lit(at) <= p)))
    return hit.agg(F.count("*").alias("n_crossings"), F.coalesce(F.sum(3.14159 * d * d / 4 / sine), F.lit(0.0)).alias("area"))


def sprouts(edge: DataFrame, vertex: DataFrame) -> DataFrame:
    """Vertices with one link."""
    from plexus.operators.network import degree

    return vertex.join(degree(edge).where("n_links = 1").select("v_id"), "v_id", "left_semi")


def bounding_box(points: DataFrame) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The least and the greatest x, y, z; both 0, 0, 0 if there are no points."""
    r = points.agg(*(f(a).cast("double").alias(f"{f.__name__}{a}") for f in (F.min, F.max) for a in "xyz")).first()
    return tuple(tuple(r[f"{f}{a}"] or 0.0 for a in "xyz") for f in ("min", "max"))


def shell_intensity(point: DataFrame, vox: DataFrame, beta: float = 0.5) -> DataFrame:
    """(e_id, intensity): the mean over an edge's points of the largest voxel value within (1 + beta) r and beyond (1 - beta) r of the point; 0 for a point without any."""
    r = F.col("d") / 2
    p = point.select("e_id", "seq", "x", "y", "z", r.alias("r"))
    reach = F.ceil(F.col("r") * (1 + beta)).cast("int")
    # Boxes end where the volume ends: no voxel is beyond.
    shell = p
    for a, lo, hi in zip("xyz", *bounding_box(vox), strict=True):
        first = F.greatest(F.floor(F.col(a)).cast("int") - reach, F.lit(int(lo)))
        last = F.least(F.floor(F.col(a)).cast("int") + reach, F.lit(int(hi)))
        shell = shell.where(first <= last).withColumn(f"v{a}", F.explode(F.sequence(first, last)))
    d2 = sum(((F.col(f"v{a}") - F.col(a)) * (F.col(f"v{a}") - F.col(a)) for a in "xyz"), F.lit(0.0))
    near = shell.where((d2 <= F.pow(F.col("r") * (1 + beta), F.lit(2))) & (d2 >= F.pow(F.col("r") * (1 - beta), F.lit(2))))
    lit = vox.select(*(F.col(a).alias(f"v{a}") for a in "xyz"), "v")
    best = near.join(lit, ["vx", "vy", "vz"]).groupBy("e_id", "seq").agg(F.max("v").alias("m"))
    return p.select("e_id", "seq").join(best, ["e_id", "seq"], "left").groupBy("e_id").agg(F.avg(F.coalesce("m", F.lit(0))).alias("intensity"))
