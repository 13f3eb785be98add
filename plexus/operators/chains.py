"""Operators made of others: peeling a volume's shell, and filling by probes."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.functions.geom import N26
from plexus.operators import kernels, points, regions, stencils
from plexus.operators.points import KEY
from plexus.plans.scratch import drop, materialise


def objects_of(vox: DataFrame, size: tuple[int, int, int], least: int) -> DataFrame:
    """The face-connected objects of at least ``least`` voxels."""
    from plexus.functions.geom import N6

    named = regions.label(vox, size, [o for o in N6 if o > (0, 0, 0)])
    return named.join(named.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least), "label", "left_semi").select(*KEY)


def largest_object(vox: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """The face-connected object with most voxels, then the least label; none if nothing is lit."""
    from plexus.functions.geom import N6

    named = regions.label(vox, size, [o for o in N6 if o > (0, 0, 0)])
    first = named.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return named.join(F.broadcast(first), "label", "left_semi").select(*KEY)  # one row


def peel(vox: DataFrame, size: tuple[int, int, int], level: int, closing: int, depth: int, margin: int | None = None, least: int = 1000, one_background: bool = False) -> DataFrame:
    """(x, y, z, v) of the voxels inside the object, less a shell of ``depth``.

    The voxels above ``level`` are closed by a ball. Eroded by ``margin``
    (closing / 4; closing / 2 for the variant that keeps ``one_background``),
    their objects of at least ``least`` voxels mark the inside; what their
    dilation leaves out marks the outside. A flood of the values from both
    finds the object, which is eroded by ``depth`` and masks the volume.
    Balls have whole voxels as radii.
    """
    margin = closing // (2 if one_background else 4) if margin is None else margin
    closed = materialise(stencils.close_ball(vox.where(F.col("v") > level), closing, size), "closed")
    inside = objects_of(stencils.erode_ball(closed, margin, size), size, least)
    outside = points.grid(vox.sparkSession, *size).join(stencils.dilate_ball(closed, margin, size).select(*KEY), KEY, "left_anti")
    if one_background:
        outside = largest_object(outside, size)
    markers = materialise(inside.withColumn("label", F.lit(1)).unionByName(outside.withColumn("label", F.lit(2))), "markers")
    found = materialise(kernels.watershed(vox, markers, size).where("label = 1").select(*KEY, F.lit(255).alias("v")), "found")
    return points.mask(vox, stencils.erode_ball(found, depth, size).select(*KEY, F.lit(255).alias("v")))


def direction_limit(steps: int = 10) -> float:
    """0.99 of the least cosine between any direction (of a grid of steps^3) and the nearest of the 26."""
    worst = 1.0
    unit = [tuple(c / math.sqrt(sum(k * k for k in o)) for c in o) for o in N26]
    for p in product(range(steps), repeat=3):
        if any(p):
            worst = min(worst, max(sum(a * b for a, b in zip(p, u, strict=True)) for u in unit) / math.sqrt(sum(c * c for c in p)))
    return 0.99 * worst


def probe_hits(vox: DataFrame, size: tuple[int, int, int], reach: float, voxel: tuple[float, float, float]) -> DataFrame:
    """(x, y, z, hits) of unlit voxels: per direction of 26 that meets a lit voxel nearer than ``reach``, (dir, d2, ux, uy, uz).

    Lit voxels push along the directions; the nearest is a partial minimum.
    d2 is the number of steps times the square of one step's length.
    """
    table = []
    for i, o in enumerate(N26):
        dd = sum((c * s) ** 2 for c, s in zip(o, voxel, strict=True))
        k = 1
        while k * k * dd < reach * reach:
            table.append((i, k, k * dd, *o))
            k += 1
    if not table:
        return vox.limit(0).select(*KEY, F.expr("cast(null as array<struct<dir:int,d2:double,ux:double,uy:double,uz:double>>)").alias("hits"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("dir"), F.lit(k).alias("k"), F.lit(float(d2)).alias("d2"), *(F.lit(c).alias(f"d{a}") for a, c in zip(KEY, o, strict=True))) for i, k, d2, *o in table)))
    pushed = vox.select(*KEY, steps.alias("s")).select(*((F.col(a) - F.col("s.k") * F.col(f"s.d{a}")).alias(a) for a in KEY), "s.dir", "s.d2", *(f"s.d{a}" for a in KEY))
    near = stencils.inside(pushed, size).groupBy(*KEY, "dir", *(f"d{a}" for a in KEY)).agg(F.min("d2").alias("d2"))
    n = F.sqrt(sum((F.col(f"d{a}") * F.col(f"d{a}") for a in KEY), F.lit(0)).cast("double"))
    hit = F.struct("dir", "d2", *((F.col(f"d{a}") / n).alias(f"u{a}") for a in KEY))
    return near.groupBy(*KEY).agg(F.array_sort(F.collect_list(hit)).alias("hits")).join(vox.select(*KEY), KEY, "left_anti")  # at most 26 a voxel


def fill(vox: DataFrame, size: tuple[int, int, int], reach: float, hits: int, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), rounds: int = 1, sweeps: int = 4) -> DataFrame:
    """Light what probes find enclosed: each unlit voxel whose probes meet ``hits`` lit voxels lights a ball around itself.

    Voxels of at least hits // 2 meetings at a round's start are candidates.
    In a sweep the first ``hits`` meetings of a candidate count: the least of
    their d2 is the ball's squared radius, and a voxel of the ball is lit if it
    lies along a direction that met something. All candidates of a sweep see
    the volume as it was before; one that has filled is done for the round.
    Specks go first.
    """
    limit = direction_limit()
    lit = materialise(stencils.despeckle_lite(vox), "lit")
    for _ in range(rounds):
        candidates = materialise(probe_hits(lit, size, reach, voxel).where(F.size("hits") >= hits // 2).select(*KEY), "candidates")
        for _ in range(sweeps):
            full = probe_hits(lit, size, reach, voxel).where(F.size("hits") >= hits).join(candidates, KEY, "left_semi")
            full = materialise(full.select(*KEY, F.slice("hits", 1, hits).alias("hits")).withColumn("r2", F.array_min(F.transform("hits", lambda h: h["d2"]))), "full")
            if full.isEmpty():
                break
            out = full
            for a, s in zip(KEY, voxel, strict=True):
                n = F.floor(F.sqrt("r2") / s + 0.5).cast("int")
                out = out.withColumn(f"d{a}", F.explode(F.sequence(-n, n)))
            way = [F.col(f"d{a}") * F.lit(float(s)) for a, s in zip(KEY, voxel, strict=True)]
            out = out.withColumn("d2", way[0] * way[0] + way[1] * way[1] + way[2] * way[2]).where("d2 <= r2")
            along = F.exists("hits", lambda h: h["ux"] * way[0] + h["uy"] * way[1] + h["uz"] * way[2] > limit * F.sqrt("d2"))
            new = stencils.inside(out.where((F.col("d2") == 0) | along).select(*((F.col(a) + F.col(f"d{a}")).alias(a) for a in KEY)), size)
            now = materialise(lit.select(*KEY).unionByName(new).distinct().select(*KEY, F.lit(255).alias("v")), "lit")
            left = materialise(candidates.join(full.select(*KEY), KEY, "left_anti"), "candidates")
            for old in (lit, candidates, full):
                drop(old)
            lit, candidates = now, left
    return lit
