"""Connected regions of voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.functions.geom import N6, N13, N26, offsets
from plexus.operators.points import KEY, grid
from plexus.plans.components import connected_components


def voxel_id(size: tuple[int, int, int]):
    w, h, _ = size
    return (F.col("z").cast("long") * h + F.col("y")) * w + F.col("x")


def label(vox: DataFrame, size: tuple[int, int, int], table=N13) -> DataFrame:
    """(x, y, z, label): the least voxel number of each component; half of the offsets suffice."""
    own = vox.select(*KEY, voxel_id(size).alias("id"))
    there = own.select(*KEY, F.col("id").alias("b"))
    links = offsets(own, table).select(F.col("id").alias("a"), *((F.col(c) + F.col(f"d{c}")).alias(c) for c in KEY)).join(there, KEY).select("a", "b")
    found = connected_components(links)
    return own.join(found, own["id"] == found["node"], "left").select(*KEY, F.coalesce("label", "id").alias("label"))


def largest_objects(vox: DataFrame, size: tuple[int, int, int], least: int, k: int) -> DataFrame:
    """(label, n_voxels) of the k largest 26-connected objects of at least ``least`` voxels."""
    return label(vox, size).groupBy("label").agg(F.count("*").alias("n_voxels")).where(F.col("n_voxels") >= least).orderBy(F.desc("n_voxels"), "label").limit(k)


def fill_holes(vox: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Light the background that no face-connected way leads out of to the volume's faces."""
    back = grid(vox.sparkSession, *size).join(vox.select(*KEY), KEY, "left_anti")
    named = label(back, size, [o for o in N6 if o > (0, 0, 0)])
    edge = F.lit(False)
    for a, n in zip(KEY, size, strict=True):
        edge = edge | (F.col(a) == 0) | (F.col(a) == n - 1)
    open_ = named.where(edge).select("label").distinct()
    return vox.select(*KEY).unionByName(named.join(open_, "label", "left_anti").select(*KEY)).select(*KEY, F.lit(255).alias("v"))


def flood(vox: DataFrame, size: tuple[int, int, int], seeds: DataFrame) -> DataFrame:
    """The objects that hold a seed (x, y, z)."""
    named = label(vox, size)
    return named.join(named.join(seeds, KEY, "left_semi").select("label").distinct(), "label", "left_semi").select(*KEY, F.lit(255).alias("v"))


def adjacency(vox: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Directed pairs (a, b) of 26-neighbours by voxel number."""
    own = vox.select(*KEY, voxel_id(size).alias("id"))
    return offsets(own, N26).select(F.col("id").alias("a"), *((F.col(c) + F.col(f"d{c}")).alias(c) for c in KEY)).join(own.select(*KEY, F.col("id").alias("b")), KEY).select("a", "b")
