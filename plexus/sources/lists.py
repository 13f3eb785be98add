"""Plain text lists: boundary voxels and named sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boundary_lines(vox: DataFrame) -> DataFrame:
    """(value): x, y, z of each lit voxel, six columns wide; no order between lines."""
    return vox.where("v <> 0").select(F.format_string("%6d %6d %6d", "x", "y", "z").alias("value"))


def write_boundary(vox: DataFrame, path: str) -> None:
    boundary_lines(vox).write.mode("overwrite").text(path)


def fields(spark, path: str, n: int) -> DataFrame:
    """The lines of text files cut at white space or commas, as an array ``f``; those of fewer than ``n`` fields go."""
    cut = F.split(F.trim(F.col("value")), r"[\s,]+")
    return spark.read.text(path).select(cut.alias("f")).where(F.size("f") >= n)


def read_boundary(spark, path: str, voxel: tuple[float, float, float]) -> DataFrame:
    """(x, y, z): the places of a boundary list's voxels."""
    return fields(spark, path, 3).select(*((F.col("f")[i].cast("int") * float(s)).alias(a) for i, (a, s) in enumerate(zip("xyz", voxel, strict=True))))


def read_sites(spark, path: str) -> DataFrame:
    """(site, x0, y0, z0, r): a name, a centre and a radius a line."""
    return fields(spark, path, 5).select(F.col("f")[0].alias("site"), *(F.col("f")[i].cast("double").alias(c) for i, c in enumerate(("x0", "y0", "z0", "r"), 1)))
