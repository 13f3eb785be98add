"""Neighbourhood operators.

Binary stencils push each lit voxel to the voxels it bears on and count there:
one shuffle with partial sums, in proportion to the lit voxels. The box mean is
separable: three running sums, one axis at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.functions.geom import N26, ball, cube, offsets
from plexus.operators.points import KEY, dense


def lit():
    return F.lit(255).alias("v")


def pushed(vox: DataFrame, table: list[tuple[int, int, int]]) -> DataFrame:
    """Rows (x, y, z, n): how many lit voxels each voxel has at the table's offsets."""
    moved = offsets(vox.select(*KEY), table).select(*((F.col(a) + F.col(f"d{a}")).alias(a) for a in KEY))
    return moved.groupBy(*KEY).agg(F.count("*").cast("int").alias("n"))


def inside(vox: DataFrame, size: tuple[int, int, int] | None) -> DataFrame:
    if size:
        for a, n in zip(KEY, size, strict=True):
            vox = vox.where((F.col(a) >= 0) & (F.col(a) < n))
    return vox


def smooth(vox: DataFrame, radius: int, size: tuple[int, int, int]) -> DataFrame:
    """Mean over the box of the given radius, clipped at the volume's faces, rounded."""
    out = dense(vox, *size)
    for a in KEY:
        w = Window.partitionBy(*(b for b in KEY if b != a)).orderBy(a).rangeBetween(-radius, radius)
        out = out.withColumn("v", F.sum("v").over(w))
    n = F.lit(1)
    for a, m in zip(KEY, size, strict=True):
        n = n * (F.least(F.col(a) + radius, F.lit(m - 1)) - F.greatest(F.col(a) - radius, F.lit(0)) + 1)
    return out.withColumn("v", F.floor(F.col("v") / n + 0.5).cast("int")).where("v <> 0")


def despeckle(vox: DataFrame, least: int, radius: int = 2) -> DataFrame:
    """Lit voxels with at least ``least`` lit neighbours in their box."""
    table = [o for o in cube(radius) if o != (0, 0, 0)]
    return vox.join(pushed(vox, table).where(F.col("n") >= least).select(*KEY), KEY, "left_semi").select(*KEY, lit())


def despeckle_lite(vox: DataFrame) -> DataFrame:
    """Drop voxels with two or fewer lit ones in their 3-box, themselves included; all at once."""
    return vox.join(pushed(vox, cube(1)).where("n > 2").select(*KEY), KEY, "left_semi").select(*KEY, lit())


def denoise(vox: DataFrame, radius: int, size: tuple[int, int, int]) -> DataFrame:
    """Binary median: lit where more than half of the box is lit; outside counts as unlit."""
    table = cube(radius)
    return inside(pushed(vox, table).where(F.col("n") * 2 > len(table)), size).select(*KEY, lit())


def deblob(vox: DataFrame, stencil: int, share: float, stride: int) -> DataFrame:
    """Zero every cube (side ``stencil``, corners at multiples of ``stride``) that is lit beyond the share of its volume."""
    reach = [F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(a) - stencil + 1) / stride)), F.floor(F.col(a) / stride))).alias(f"w{a}") for a in KEY]
    rows = vox
    for a, r in zip(KEY, reach, strict=True):
        rows = rows.where(F.floor(F.col(a) / stride) >= F.greatest(F.lit(0), F.ceil((F.col(a) - stencil + 1) / stride))).select(*rows.columns, r)
    hit = rows.groupBy("wx", "wy", "wz").agg(F.count("*").alias("n")).where(F.col("n") > share * stencil**3).select("wx", "wy", "wz")
    gone = rows.join(hit, ["wx", "wy", "wz"], "left_semi").select(*KEY).distinct()
    return vox.join(gone, KEY, "left_anti")


def dilate(vox: DataFrame, table: list[tuple[int, int, int]], size: tuple[int, int, int] | None = None) -> DataFrame:
    return inside(pushed(vox, table), size).select(*KEY, lit())


def erode(vox: DataFrame, table: list[tuple[int, int, int]], size: tuple[int, int, int]) -> DataFrame:
    """Voxels whose whole structuring element is lit; outside the volume counts as lit."""
    here = F.lit(0)
    for o in table:
        c = F.lit(True)
        for a, d, n in zip(KEY, o, size, strict=True):
            if d:
                c = c & (F.col(a) + d >= 0) & (F.col(a) + d < n)
        here = here + c.cast("int")
    return pushed(vox, table).where(F.col("n") == here).join(vox.select(*KEY), KEY, "left_semi").select(*KEY, lit())


def dilate_ball(vox, radius, size=None):
    return dilate(vox, ball(radius), size)


def erode_ball(vox, radius, size):
    return erode(vox, ball(radius), size)


def fatten(vox, width, size=None):
    return dilate(vox, cube((width - 1) // 2), size)


def boundary(vox: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Lit voxels that a ball of radius 1 erodes."""
    return vox.select(*KEY).join(erode_ball(vox, 1, size).select(*KEY), KEY, "left_anti")


def close_ball(vox: DataFrame, radius: int, size: tuple[int, int, int]) -> DataFrame:
    """Closing by a ball. The dilation may leave the volume, so that its faces don't matter."""
    table = ball(radius)
    grown = dilate(vox, table)
    return inside(pushed(grown, table).where(F.col("n") == len(table)), size).select(*KEY, lit())


def open_ball(vox, radius, size):
    return dilate_ball(erode_ball(vox, radius, size), radius, size)


def surface_faces(vox: DataFrame) -> DataFrame:
    """The number of lit voxels' faces that no lit voxel touches."""
    from plexus.functions.geom import N6

    sides = offsets(vox.select(*KEY), N6).select(*((F.col(a) + F.col(f"d{a}")).alias(a) for a in KEY))
    return sides.join(vox.select(*KEY), KEY, "left_anti").agg(F.count("*").alias("n_faces"))


def degrees(vox: DataFrame) -> DataFrame:
    """Lit voxels with their number of lit neighbours of 26: the skeleton's adjacency."""
    return vox.select(*KEY).join(pushed(vox, N26), KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("n"))
