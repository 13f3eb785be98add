"""Voxel point operators: one row in, at most one row out, no shuffle but for the two-volume ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["x", "y", "z"]


def lit_only(df: DataFrame) -> DataFrame:
    return df.where("v <> 0")


def with_value(vox: DataFrame, v: Column) -> DataFrame:
    return lit_only(vox.withColumn("v", v.cast("int")))


def threshold(vox: DataFrame, background: DataFrame, level: int, delta: int) -> DataFrame:
    """255 where v reaches ``level``, or background + delta where the background is below level - delta."""
    b = F.coalesce(F.col("b"), F.lit(0))
    bar = F.when(b >= level - delta, F.lit(level)).otherwise(b + delta)
    both = vox.join(background.select(*KEY, F.col("v").alias("b")), KEY, "left")
    return both.where(F.col("v") >= bar).select(*KEY, F.lit(255).alias("v"))


def gamma(vox: DataFrame, g: float) -> DataFrame:
    return with_value(vox, F.floor(255 * F.pow(F.col("v") / 255.0, F.lit(1.0 / g))))


def grid(spark, width: int, height: int, depth: int) -> DataFrame:
    """All voxels of a box."""
    n = spark.range(width * height * depth)
    return n.select((F.col("id") % width).cast("int").alias("x"), (F.floor(F.col("id") / width) % height).cast("int").alias("y"), F.floor(F.col("id") / (width * height)).cast("int").alias("z"))


def dense(vox: DataFrame, width: int, height: int, depth: int) -> DataFrame:
    return grid(vox.sparkSession, width, height, depth).join(vox.select(*KEY, "v"), KEY, "left").select(*KEY, F.coalesce("v", F.lit(0)).alias("v"))


def invert(vox: DataFrame, width: int, height: int, depth: int) -> DataFrame:
    return with_value(dense(vox, width, height, depth), 255 - F.col("v"))


def scale(vox: DataFrame, s: float, compat: bool = False) -> DataFrame:
    """v * s up to 255; compat: what overflows a byte wraps around."""
    v = F.floor(F.col("v") * s)
    return with_value(vox, v % 256 if compat else F.least(v, F.lit(255)))


def convert_16_to_8(vox: DataFrame) -> DataFrame:
    return with_value(vox, (F.col("v") / 256).cast("int"))


def convert_bits(vox: DataFrame, bits: int, least: int) -> DataFrame:
    v = F.floor(F.col("v") * 255 / ((1 << bits) - 1))
    return with_value(vox, F.when(v < least, 0).otherwise(v))


def convert_1_255(vox: DataFrame) -> DataFrame:
    return with_value(vox, F.when(F.col("v") == 1, 255).otherwise(0))


def binarise(vox: DataFrame, level: int) -> DataFrame:
    return vox.where(F.col("v") >= level).select(*KEY, F.lit(255).alias("v"))


def count_lit(vox: DataFrame) -> DataFrame:
    return vox.agg(F.count(F.when(F.col("v") != 0, 1)).alias("n_lit"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum up to 255."""
    return a.select(*KEY, "v").unionByName(b.select(*KEY, "v")).groupBy(*KEY).agg(F.least(F.sum("v"), F.lit(255)).cast("int").alias("v"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference down to 0."""
    both = a.join(b.select(*KEY, F.col("v").alias("w")), KEY, "left")
    return both.select(*KEY, (F.col("v") - F.coalesce("w", F.lit(0))).cast("int").alias("v")).where("v > 0")


def subtract_value(vox: DataFrame, value: int) -> DataFrame:
    """Difference from one number, down to 0."""
    return with_value(vox, F.greatest(F.col("v") - int(value), F.lit(0)))


def mask(vox: DataFrame, by: DataFrame) -> DataFrame:
    return vox.join(by.where("v <> 0").select(*KEY), KEY, "left_semi")


def stack(slices: DataFrame, bits16: bool = False) -> DataFrame:
    """Slices (slice_no, x, y, v), some numbers missing, as a volume: z is the rank among the numbers there are."""
    numbers = slices.select("slice_no").distinct()
    # Ranks of the few slice numbers, not of the voxels.
    ranks = numbers.join(numbers.select(F.col("slice_no").alias("m")), F.col("m") < F.col("slice_no"), "left").groupBy("slice_no").agg(F.count("m").cast("int").alias("z"))
    v = F.least(F.lit(255), F.floor(F.col("v") / 65536 * 255 + 0.5)) if bits16 else F.col("v")
    return with_value(slices.join(ranks, "slice_no").select("x", "y", "z", "v"), v)


def crop(vox: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """A block, both ends included; a negative bound leaves its axis whole. The block's corner becomes the origin."""
    for a, p, q in zip(KEY, lo, hi, strict=True):
        if p >= 0 and q >= 0:
            vox = vox.where(F.col(a).between(p, q)).withColumn(a, F.col(a) - p)
    return vox


def crop_sphere(vox: DataFrame, centre: tuple[int, int, int], radius: int) -> DataFrame:
    r2 = sum(((F.col(a) - c) * (F.col(a) - c) for a, c in zip(KEY, centre, strict=True)), F.lit(0))
    return vox.where(r2 <= radius * radius).select(*((F.col(a) - (c - radius - 5)).alias(a) for a, c in zip(KEY, centre, strict=True)), "v")


def cut(vox: DataFrame, axis: str, at: int) -> tuple[DataFrame, DataFrame]:
    return vox.where(F.col(axis) <= at), vox.where(F.col(axis) > at).withColumn(axis, F.col(axis) - (at + 1))


def join(low: DataFrame, high: DataFrame, axis: str, extent: int) -> DataFrame:
    """The inverse of cut: extent is the length of ``low`` along the axis."""
    return low.unionByName(high.withColumn(axis, F.col(axis) + extent))


def quarter(vox: DataFrame, width: int, height: int) -> DataFrame:
    w, h = width // 2, height // 2
    qx, qy = (F.col("x") >= w).cast("int"), (F.col("y") >= h).cast("int")
    return vox.select(qx.alias("qx"), qy.alias("qy"), (F.col("x") - qx * w).alias("x"), (F.col("y") - qy * h).alias("y"), "z", "v")
