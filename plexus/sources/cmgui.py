"""CMGUI text of a network: .exnode (points with radii, colours if wanted) and .exelem (segments)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = (("coordinates", "coordinate, rectangular cartesian", "xyz"), ("vessel_radius", "coordinate, rectangular cartesian", "1"))
COLOUR = ("colour", "field, rectangular cartesian, real", "123")


def node_header(fields) -> str:
    out, value = ["Group name: vessels", f" #Fields={len(fields)}"], 0
    for i, (name, kind, parts) in enumerate(fields, 1):
        out.append(f" {i}) {name}, {kind}, #Components={len(parts)}")
        for p in parts:
            value += 1
            out.append(f"  {p}.  Value index={value}, #Derivatives=0, #Versions=1")
    return "\n".join(out)


def element_header(fields) -> str:
    out = ["Group name: vessels", " Shape.  Dimension=1", " #Scale factor sets= 1", "  l.Lagrange, #Scale factors= 2", " #Nodes= 2", f" #Fields={len(fields)}"]
    for i, (name, kind, parts) in enumerate(fields, 1):
        out.append(f" {i}) {name}, {kind}, #Components={len(parts)}")
        for p in parts:
            out += [f"   {p}.  l.Lagrange, no modify, standard node based.", "     #Nodes= 2"]
            for node in (1, 2):
                out += [f"      {node}.  #Values=1", "       Value indices:     1", f"       Scale factor indices:   {node}"]
    return "\n".join(out)


def kept_segments(point: DataFrame) -> DataFrame:
    """(e_id, seq0, seq1): a point starts a segment to the first later one farther away than their mean radius, or to the end."""

    def one(e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("seq")
        p, d, seq = e[["x", "y", "z"]].to_numpy(), e["d"].to_numpy(), e["seq"].to_numpy()
        out, at = [], 0
        for i in range(1, len(e)):
            if i == len(e) - 1 or ((p[i] - p[at]) ** 2).sum() ** 0.5 > 0.5 * (d[at] / 2 + d[i] / 2):
                out.append((e["e_id"].iloc[0], seq[at], seq[i]))
                at = i
        return pd.DataFrame(out, columns=["e_id", "seq0", "seq1"])

    return point.groupBy("e_id").applyInPandas(one, "e_id long, seq0 long, seq1 long")


def path_colours(paths: DataFrame, value: str, colour: tuple[float, float, float]) -> DataFrame:
    """(v_id, r, g, b): the colour by the squared share of the largest value that a vertex lacks; sums of two such tables mix."""
    top = float(paths.agg(F.max(value)).first()[0] or 0.0)
    share = (F.lit(top) - F.col(value)) / F.nullif(F.lit(top), F.lit(0.0))
    return paths.select("v_id", *((F.coalesce(share * share, F.lit(0.0)) * c).alias(n) for n, c in zip("rgb", colour, strict=True)))


def cmgui_lines(point: DataFrame, origin: tuple = (0.0, 0.0, 0.0), colours: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines (value) of .exnode and .exelem, in order. Numbers tell edge and point, with gaps, which the format allows.

    colours: (e_id, seq, r, g, b), added to each node. A diameter of zero is an error.
    """
    if not point.where("d = 0").isEmpty():
        raise ValueError("a point has no diameter")
    stride = (point.agg(F.max("seq")).first()[0] or 0) + 1
    number = lambda seq: F.col("e_id") * stride + F.col(seq) + 1
    fields = (*FIELDS, COLOUR) if colours is not None else FIELDS
    spark = point.sparkSession
    text = [F.format_string("Node: %d", "n"), F.format_string("%6.1f %6.1f %6.1f", *(F.col(a) - float(o) for a, o in zip("xyz", origin, strict=True))), F.format_string("%6.2f", F.col("d") / 2)]
    if colours is not None:
        point = point.join(colours, ["e_id", "seq"], "left").fillna(0.0, ["r", "g", "b"])
        text.append(F.format_string("%5.2f %5.2f %5.2f", "r", "g", "b"))
    nodes = point.withColumn("n", number("seq")).select("n", F.concat_ws("\n", *text).alias("value"))
    segs = kept_segments(point.select("e_id", "seq", *"xyzd")).select(number("seq1").alias("n"), number("seq0").alias("a"))
    elements = segs.select("n", F.format_string("Element: %d 0 0\n  Nodes: %d %d\n  Scale factors: 1 1", "n", "a", "n").alias("value"))
    head = lambda s: spark.createDataFrame([(-1, s)], "n long, value string")
    return tuple(head(h(fields)).unionByName(df).orderBy("n").select("value") for h, df in ((node_header, nodes), (element_header, elements)))


def write_cmgui(point: DataFrame, base: str, **how) -> None:
    """Folders base.exnode and base.exelem of text parts in order."""
    for df, kind in zip(cmgui_lines(point, **how), ("exnode", "exelem"), strict=True):
        df.write.mode("overwrite").text(f"{base}.{kind}")
