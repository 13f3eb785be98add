"""Text networks and bit-packed volumes, as Spark reads and writes them."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexus.operators.network import dense_ids
from plexus.plans.scratch import bounded, materialise, small_batches


def with_diameter(point: DataFrame, least: float | None = None, fixed: float | None = None) -> DataFrame:
    """The points with diameters of at least ``least``, or all of the ``fixed`` one."""
    d = F.lit(float(fixed)) if fixed is not None else F.col("d") if least is None else F.greatest("d", F.lit(float(least)))
    return point.withColumn("d", d)


def ends_only(point: DataFrame) -> DataFrame:
    """The first and the last point of each edge, numbered 0 and 1."""
    tips = F.array(*(F.struct(F.lit(k).cast("long").alias("seq"), *(F.col(f"t{k}.{c}").alias(c) for c in "xyzd")) for k in (0, 1)))
    both = point.groupBy("e_id").agg(*(f(F.struct(*"xyzd"), "seq").alias(f"t{k}") for k, f in enumerate((F.min_by, F.max_by))))
    return both.select("e_id", F.explode(tips).alias("t")).select("e_id", "t.*")


def read_networks(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spatial-graph text files: vertex (file, v_id, x, y, z), edge (file, e_id, v0, v1), point (file, e_id, seq, x, y, z, d).

    Files are read in splits, so one may be of any size. Their numbers are written
    to the shared folder at once; a table whose sections a file lacks, or has cut
    short, raises a ValueError when it runs.
    """
    small_batches(spark, 2_000)
    chunk, files = _numbers(spark, path)
    w = Window.partitionBy("file").orderBy("block", "seg")
    mark = F.last(F.when(F.col("section").isNotNull(), F.struct("section", "block", "seg")), ignorenulls=True).over(w)
    segs = chunk.groupBy("file", "block", "seg").agg(F.max("section").alias("section"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    segs = segs.withColumn("mark", mark).withColumn("latest", F.max("mark").over(Window.partitionBy("file", "mark.section")))
    segs = segs.where("mark = latest").withColumn("section", F.col("mark.section")).where("section in (1, 2, 3, 4, 5)")
    own = Window.partitionBy("file", "section").orderBy("block", "seg")
    segs = materialise(segs.select("file", "block", "seg", "section", "n", "total", (F.sum("n").over(own) - F.col("n")).alias("g0"), (F.sum("total").over(own) - F.col("total")).alias("p0")), "segments")
    of = lambda k, c="n": F.sum(F.when(F.col("section") == k, F.col(c)))
    sums = segs.groupBy("file").agg(*(of(k).alias(f"n{k}") for k in range(1, 6)), of(3, "total").alias("p"))
    right = {"vertex": "n1 % 3 = 0", "edge": "n2 % 2 = 0", "point": "n4 = 3 * p and n5 = p"}
    good = sums.agg(*(F.count(F.when(F.expr(c), 1)).alias(k) for k, c in right.items())).first()
    placed = chunk.drop("section", "n", "total").join(bounded(segs.drop("n", "total")), ["file", "block", "seg"])
    placed = placed.select("file", "section", (F.col("g0") + F.col("i")).alias("g"), (F.col("p0") + F.col("c")).cast("long").alias("p"), "values")

    def table(kind):
        if good[kind] < files:
            return spark.range(1).mapInArrow(_lacking(kind, files - good[kind], path), SCHEMAS[kind])
        parts = placed.where(F.col("section").isin(*SECTIONS[kind])).mapInArrow(_dealt, "file string, bucket long, section int, first long, at long, values array<double>")
        return parts.groupBy("file", "bucket").applyInArrow(_built(kind), SCHEMAS[kind])

    return tuple(table(k) for k in SCHEMAS)


def _numbers(spark, path: str) -> tuple[DataFrame, int]:
    """The numbers of text files, and how many files there are.

    (file, block, seg, section, i, n, c, total, values): a split of a file, which
    of its segments (a new one begins with each section), the section if it begins
    in this split, the place in the segment of the first of ``n`` values and the
    sum of whole parts before it and of it.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def over(batches):
        here = None
        for b in batches:
            for key, some in _runs(b):
                rows = []
                if key != here:  # the lines of a split follow each other
                    here, seg, section, i, c = key, 0, None if key[1] else 0, 0, 0.0
                    rows.append((*key, seg, section, 0, 0, 0.0, 0.0, []))
                for begins, found in _cut(some):
                    if begins is not None:
                        seg, section, i, c = seg + 1, begins, 0, 0.0
                        rows.append((*key, seg, section, 0, 0, 0.0, 0.0, []))
                    for k in range(0, len(found) if section in (None, 1, 2, 3, 4, 5) else 0, CHUNK):
                        v = found[k : k + CHUNK]
                        rows.append((*key, seg, section, i, len(v), c, float(np.trunc(v).sum()), v))
                        i, c = i + len(v), c + rows[-1][-2]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NUMBERS)

    schema = "file string, block long, seg int, section int, i long, n long, c double, total double, values array<double>"
    return materialise(lines.mapInArrow(over, schema), "numbers"), len(lines.inputFiles())


#: Numbers in a row between the text and the tables; rows of a table that are put together at once.
CHUNK, BUCKET = 2_000, 10_000
NUMBERS = ["file", "block", "seg", "section", "i", "n", "c", "total", "values"]
KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
SECTIONS = {"vertex": (1,), "edge": (2,), "point": (3, 4, 5)}
WIDTHS = {1: 3, 2: 2, 4: 3, 5: 1}


def _runs(batch):
    """((file, block), lines) for each split that a batch has lines of."""
    name, block, value = (batch.column(k) for k in range(3))
    ends = [0, batch.num_rows]
    if batch.num_rows and (name[0], block[0]) != (name[-1], block[-1]):
        keys = list(zip(name.to_pylist(), block.to_pylist(), strict=True))
        ends = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
    for a, b in zip(ends, ends[1:]):
        if b > a:
            yield (name[a].as_py(), block[a].as_py()), value.slice(a, b - a).to_pylist()


def _cut(lines: list[str]) -> list[tuple]:
    """(section, numbers): first what goes on (None), then each section that begins; 0 begins where something else than a number stands."""
    try:
        return [(None, np.array(" ".join(lines).split(), dtype=float))]
    except ValueError:
        pass
    out = [(None, [])]
    for line in lines:
        begins = re.fullmatch(r"@(\d)\s*", line)
        if begins:
            out.append((int(begins[1]), []))
            continue
        try:
            for t in line.split():
                out[-1][1].append(float(t))
        except ValueError:
            if out[-1][0] != 0:
                out.append((0, []))
    return [(k, np.array(v, dtype=float)) for k, v in out]


def _lacking(kind: str, n: int, path: str):
    def over(_):
        raise ValueError(f"{n} of the files {path} lack sections of the {kind} table, or numbers in them")
        yield

    return over


def _dealt(batches):
    """Chunks cut where the buckets of their table's rows end. Of point counts, a bucket gets those of all edges with points in it."""
    for b in batches:
        rows = []
        for name, k, g, p, v in zip(*(b.column(i) for i in range(5)), strict=True):
            name, k, g, p, v = name.as_py(), k.as_py(), g.as_py(), p.as_py(), v.values.to_numpy()
            if not len(v):
                continue
            if k == 3:
                n = v.astype(np.int64)
                if n.min() < 0:
                    raise ValueError(f"{name} has an edge of {n.min()} points")
                ends = p + np.cumsum(n)
                starts = ends - n
                for bucket in range(p // BUCKET, -(-int(ends[-1]) // BUCKET)):
                    i, j = np.searchsorted(ends, bucket * BUCKET, "right"), np.searchsorted(starts, (bucket + 1) * BUCKET)
                    if j > i:
                        rows.append((name, bucket, k, g + int(i), int(starts[i]), v[i:j]))
            else:
                span, at = BUCKET * WIDTHS[k], g
                while at < g + len(v):
                    to = min((at // span + 1) * span, g + len(v))
                    rows.append((name, at // span, k, at, 0, v[at - g : to - g]))
                    at = to
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), DEALT, strict=True)], names=["file", "bucket", "section", "first", "at", "values"])


DEALT = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64())]


def _built(kind: str):
    """The rows of a bucket of a table, from its parts in any order."""

    def build(t: pa.Table) -> pa.Table:
        bucket, parts = t.column("bucket")[0].as_py(), {k: [] for k in SECTIONS[kind]}
        for k, first, at, v in sorted(zip(*(t.column(c).to_pylist() for c in ("section", "first", "at")), (v.values.to_numpy() for v in t.column("values")), strict=True), key=lambda r: r[:2]):
            parts[k].append((first, at, v))
        flat = {k: np.concatenate([v for *_, v in p]) for k, p in parts.items() if p}
        if kind != "point":
            c = flat[SECTIONS[kind][0]].reshape(-1, 3 if kind == "vertex" else 2)
            cols = [bucket * BUCKET + np.arange(len(c)), *(c if kind == "vertex" else c.astype(np.int64)).T]
        else:
            n = flat[3].astype(np.int64)
            e = np.concatenate([first + np.arange(len(v)) for first, _, v in parts[3]])
            start = np.concatenate([at + np.cumsum(v.astype(np.int64)) - v.astype(np.int64) for _, at, v in parts[3]])
            a, z = np.maximum(start, bucket * BUCKET), np.minimum(start + n, (bucket + 1) * BUCKET)
            here = np.maximum(z - a, 0)
            cols = [np.repeat(e, here), np.arange(here.sum()) - np.repeat(np.cumsum(here) - here - (a - start), here), *flat[4].reshape(-1, 3).T, flat[5]]
        arrays = [pa.array(np.ascontiguousarray(c)) for c in cols]
        return pa.Table.from_arrays([pa.array([t.column("file")[0].as_py()] * len(arrays[0]), type=pa.string()), *arrays], names=NAMES[kind])

    return build


SCHEMAS = {
    "vertex": "file string, v_id long, x double, y double, z double",
    "edge": "file string, e_id long, v0 long, v1 long",
    "point": "file string, e_id long, seq long, x double, y double, z double, d double",
}
NAMES = {k: [c.split()[0] for c in v.split(", ")] for k, v in SCHEMAS.items()}


def network_lines(vertex: DataFrame, edge: DataFrame, point: DataFrame, origin: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """(line, value): the text of one network, coordinates to one decimal and diameters to two, shifted by ``origin``; vertices and edges are numbered anew."""
    v = dense_ids(vertex, "v_id", "i")
    e = dense_ids(edge, "e_id", "j")
    n = point.groupBy("e_id").agg(F.count("*").alias("n"))
    coords = F.concat_ws(" ", *(F.format_string("%6.1f", F.col(a) - float(o)) for a, o in zip("xyz", origin, strict=True)))
    ends = e.join(v.select(F.col("v_id").alias("v0"), F.col("i").alias("a")), "v0").join(v.select(F.col("v_id").alias("v1"), F.col("i").alias("b")), "v1")
    p = point.join(e.select("e_id", "j"), "e_id")
    counts = [df.count() for df in (v, e, p)]
    head = [f"# spatial graph\ndefine VERTEX {counts[0]}\ndefine EDGE {counts[1]}\ndefine POINT {counts[2]}\n", "VERTEX { float[3] VertexCoordinates } @1", "EDGE { int[2] EdgeConnectivity } @2", "EDGE { int NumEdgePoints } @3", "POINT { float[3] EdgePointCoordinates } @4", "POINT { float thickness } @5"]
    spark = vertex.sparkSession
    rows = spark.createDataFrame([(0, i, 0, h) for i, h in enumerate(head)] + [(k, -1, 0, f"\n@{k}") for k in range(1, 6)], "part int, a long, b long, value string")
    body = [
        v.select(F.lit(1), F.col("i"), F.lit(0), coords),
        ends.select(F.lit(2), F.col("j"), F.lit(0), F.format_string("%d %d", "a", "b")),
        e.join(n, "e_id").select(F.lit(3), F.col("j"), F.lit(0), F.col("n").cast("string")),
        p.select(F.lit(4), F.col("j"), F.col("seq"), coords),
        p.select(F.lit(5), F.col("j"), F.col("seq"), F.format_string("%6.2f", "d")),
    ]
    for b in body:
        rows = rows.union(b)
    return rows.orderBy("part", "a", "b").select("value")


def write_network(vertex, edge, point, path: str, origin: tuple = (0.0, 0.0, 0.0)) -> None:
    network_lines(vertex, edge, point, origin).coalesce(1).write.mode("overwrite").text(path)


def pack_bits(vox: DataFrame, size: tuple[int, int, int]) -> bytes:
    """A bit-packed volume: seven little-endian ints, then a bit a voxel, least first, rows padded to bytes. Bytes are summed by Spark."""
    w, h, d = size
    w8, h8, d8 = (-(-n // 8) * 8 for n in size)
    byte = (F.col("z").cast("long") * h8 + F.col("y")) * (w8 // 8) + F.floor(F.col("x") / 8)
    rows = vox.where("v in (1, 255)").select(byte.alias("k"), F.expr("shiftleft(1, cast(x % 8 as int))").alias("bit")).distinct().groupBy("k").agg(F.sum("bit").alias("b")).collect()
    out = bytearray(w8 // 8 * h8 * d8)
    for r in rows:
        out[r["k"]] = r["b"]
    return struct.pack("<7i", w, h, d, w8, h8, d8, len(out)) + bytes(out)


def read_bits(spark, path: str) -> DataFrame:
    """(file, x, y, z, v) of the lit voxels of bit-packed volumes."""

    def over(batches):
        for b in batches:
            for name, content in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
                w, h, d, w8, h8, d8, n = struct.unpack("<7i", content[:28])
                bits = np.unpackbits(np.frombuffer(content, dtype=np.uint8, count=n, offset=28), bitorder="little").reshape(d8, h8, w8)
                z, y, x = np.nonzero(bits[:d, :h, :w])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), type=pa.string()), *(pa.array(c.astype(np.int32)) for c in (x, y, z)), pa.array(np.full(len(x), 255, dtype=np.int32))], names=["file", "x", "y", "z", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(over, "file string, x int, y int, z int, v int")
