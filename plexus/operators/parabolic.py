"""Parabolic morphology: erosions and dilations by paraboloids, and what is built on them.

A paraboloid parts into parabolas along the axes, so each axis is a pass of its
own: out(p) = min over q on p's line of f(q) + (p - q)^2 / (2 scale). A task
gets bundles of whole lines as one array and takes the minimum over offsets for
all its lines at once; it stops at the offset from which on a parabola is above
all that has been found. Bundles have a bounded number of lines, so tasks stay
small whatever the volume's size.

Volumes here are dense tables (x, y, z, values); an absent voxel counts for nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.operators.points import KEY, dense

#: Lines of a bundle.
LINES = 512
#: Fixed value: binary operators of radius r reach squared distances under r^2 + 2, in voxels.
BINARY_MARGIN = 2


def lowered(a: np.ndarray, curvature: float) -> np.ndarray:
    """min over q of a[q] + curvature (p - q)^2 along the first axis, for all other places at once."""
    out, low = a.copy(), a.min(initial=np.inf)
    for d in range(1, len(a)):
        rise = curvature * d * d
        if d % 8 == 1 and low + rise >= out.max(initial=-np.inf):
            break
        np.minimum(out[d:], a[:-d] + rise, out=out[d:])
        np.minimum(out[:-d], a[d:] + rise, out=out[:-d])
    return out


def pass_along(vox: DataFrame, axis: str, curvature: dict[str, float], lines: int = LINES) -> DataFrame:
    """One axis for all value columns; curvature by column, negative for dilations (a maximum of falling parabolas)."""
    b, c = (k for k in KEY if k != axis)

    def bundle(t: pd.DataFrame) -> pd.DataFrame:
        at = t[axis].to_numpy()
        at = at - at.min()
        line = pd.factorize(t[b].to_numpy().astype(np.int64) << 32 | t[c].to_numpy())[0]
        out = t[KEY].copy()
        for name, k in curvature.items():
            a = np.full((at.max() + 1, line.max() + 1), np.inf)
            a[at, line] = np.sign(k) * t[name].to_numpy()
            out[name] = np.sign(k) * lowered(a, abs(k))[at, line]
        return out

    schema = "x int, y int, z int, " + ", ".join(f"{n} double" for n in curvature)
    keyed = vox.select(*KEY, *(F.col(n).cast("double").alias(n) for n in curvature)).withColumn("part", F.floor(F.col(b) / lines).cast("int"))
    return keyed.groupBy("part", c).applyInPandas(lambda t: bundle(t), schema)


def passes(vox: DataFrame, curvature: dict[str, float], spacing: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """All three axes; a voxel's side along an axis stretches its parabola."""
    for axis, s in zip(KEY, spacing, strict=True):
        vox = pass_along(vox, axis, {n: k * s * s for n, k in curvature.items()})
    return vox


def parabolic(vox: DataFrame, scale: float, dilate: bool = False, spacing: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """Parabolic erosion (or dilation) of dense values v, curvature 1 / (2 scale)."""
    return passes(vox, {"v": (-1 if dilate else 1) / (2 * scale)}, spacing)


def opened(vox: DataFrame, scale: float) -> DataFrame:
    """A parabolic erosion, then a dilation: bright details narrower than the parabola go."""
    return parabolic(parabolic(vox, scale), scale, dilate=True)


def closed(vox: DataFrame, scale: float) -> DataFrame:
    """A parabolic dilation, then an erosion: dark details go."""
    return parabolic(parabolic(vox, scale, dilate=True), scale)


def far_of(size: tuple[int, int, int], spacing: tuple[float, float, float] = (1, 1, 1)) -> float:
    """A squared distance that no two voxels have."""
    return float(sum((n * s) ** 2 for n, s in zip(size, spacing, strict=True)))


def distance_transform(vox: DataFrame, size: tuple[int, int, int], spacing: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """(x, y, z, dist): each voxel's Euclidean distance from the nearest unlit one (within the volume; a large number if there is none)."""
    d = dense(vox, *size).select(*KEY, F.when(F.col("v") > 0, F.lit(far_of(size, spacing))).otherwise(0.0).alias("v"))
    return passes(d, {"v": 1.0}, spacing).select(*KEY, F.sqrt("v").alias("dist"))


def signed_distance(vox: DataFrame, size: tuple[int, int, int], spacing: tuple[float, float, float] = (1, 1, 1), inside_positive: bool = True) -> DataFrame:
    """(x, y, z, dist): lit voxels' distance from the nearest unlit one, and less the unlit ones' distance from the nearest lit one."""
    far = far_of(size, spacing)
    lit = F.col("v") > 0
    d = dense(vox, *size).select(*KEY, F.when(lit, far).otherwise(0.0).alias("inner"), F.when(lit, 0.0).otherwise(far).alias("outer"))
    both = passes(d, {"inner": 1.0, "outer": 1.0}, spacing)
    return both.select(*KEY, ((F.sqrt("inner") - F.sqrt("outer")) * (1 if inside_positive else -1)).alias("dist"))


def binary(vox: DataFrame, size: tuple[int, int, int], radius: float, dilate: bool) -> DataFrame:
    """(x, y, z, v = 255): voxels that are lit as far as the radius reaches, or with ``dilate`` that a lit one reaches."""
    near = float(radius * radius + BINARY_MARGIN)
    full = F.col("v") > 0
    d = dense(vox, *size).select(*KEY, F.when(full != F.lit(dilate), near).otherwise(0.0).alias("v"))
    out = passes(d, {"v": 1.0})
    return out.where(F.col("v") < near if dilate else F.col("v") >= near).select(*KEY, F.lit(255).alias("v"))


def binary_open(vox: DataFrame, size: tuple[int, int, int], radius: float) -> DataFrame:
    return binary(binary(vox, size, radius, False), size, radius, True)


def binary_close(vox: DataFrame, size: tuple[int, int, int], radius: float) -> DataFrame:
    """In a volume that is larger by the radius all around, so that its faces don't count as unlit or lit."""
    pad = int(np.ceil(radius)) + 1
    wide = tuple(n + 2 * pad for n in size)
    out = binary(binary(vox.select(*((F.col(c) + pad).alias(c) for c in KEY), "v"), wide, radius, True), wide, radius, False)
    inside = F.lit(True)
    for c, n in zip(KEY, size, strict=True):
        inside = inside & F.col(c).between(pad, pad + n - 1)
    return out.where(inside).select(*((F.col(c) - pad).alias(c) for c in KEY), "v")


def sharpened(vox: DataFrame, scale: float, rounds: int = 1) -> DataFrame:
    """Dense values v; in each round a voxel takes the nearer of its parabolic dilation and erosion, and stays where both are as near."""
    out = vox.select(*KEY, F.col("v").cast("double").alias("v"))
    for _ in range(rounds):
        both = passes(out.select(*KEY, "v", F.col("v").alias("lo"), F.col("v").alias("hi")).select(*KEY, "lo", "hi"), {"lo": 1 / (2 * scale), "hi": -1 / (2 * scale)})
        both = both.join(out, KEY)
        up, down = F.col("hi") - F.col("v"), F.col("v") - F.col("lo")
        out = both.select(*KEY, F.when(up < down, F.col("hi")).when(down < up, F.col("lo")).otherwise(F.col("v")).alias("v"))
    return out
