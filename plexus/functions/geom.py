"""Geometry as Column expressions, so that it stays within generated code."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The value that reports are computed with; pass another to functions that take ``pi`` if exact areas are wanted.
PI = 3.14159
N26 = [o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
N13 = [o for o in N26 if o > (0, 0, 0)]
N6 = [o for o in N26 if sum(map(abs, o)) == 1]


def xyz(suffix: str = "") -> list[Column]:
    return [F.col(c + suffix) for c in "xyz"]


def dot3(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub3(a: list[Column], b: list[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def cross3(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm3(a: list[Column]) -> Column:
    return F.sqrt(dot3(a, a))


def dist3(a: list[Column], b: list[Column]) -> Column:
    return norm3(sub3(a, b))


def bin_nearest(value: Column, width: float) -> Column:
    """The bin whose centre (a multiple of width) is nearest."""
    return F.floor(value / F.lit(float(width)) + 0.5).cast("long")


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def offsets(df: DataFrame, table: list[tuple[int, int, int]]) -> DataFrame:
    """Every row once per offset (dx, dy, dz); the offsets are a constant of the plan."""
    o = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(t, ("dx", "dy", "dz"), strict=True))) for t in table)))
    return df.withColumn("o", o).select(*df.columns, "o.dx", "o.dy", "o.dz")


def ball(radius: int) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [o for o in product(r, repeat=3) if sum(v * v for v in o) <= radius * radius]


def cube(radius: int) -> list[tuple[int, int, int]]:
    return list(product(range(-radius, radius + 1), repeat=3))


def near_cells(df: DataFrame, prefix: str = "c") -> DataFrame:
    """Every row once for each of the 27 cells around its own (cx, cy, cz): the key of a range join as an equi-join."""
    out = offsets(df, cube(1))
    return out.select(*df.columns, *((F.col(f"{prefix}{a}") + F.col(f"d{a}")).alias(f"k{a}") for a in "xyz"))


def capsule_distance(p: list[Column], a: list[Column], b: list[Column], ra: Column, rb: Column) -> Column:
    """Distance of a point from a tapered capsule; 0 inside, and where the segment or the offset has no length."""
    w, v = sub3(p, a), sub3(b, a)
    lv, lw = norm3(v), norm3(w)
    s = dot3(w, v) / lv
    t = s / lv
    beside = F.sqrt(F.greatest(lw * lw - s * s, F.lit(0.0))) - ((1 - t) * ra + t * rb)
    out = F.when(s <= 0, lw - ra).when(s >= lv, norm3(sub3(p, b)) - rb).otherwise(beside)
    return F.when((lv == 0) | (lw == 0), F.lit(0.0)).otherwise(F.greatest(out, F.lit(0.0)))
