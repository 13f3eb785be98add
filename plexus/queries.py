"""Registered queries of the library's own operators, each with the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexus.fixtures import SIZE, Fixtures, ctes
from plexus.functions.geom import N6, N13, N26, PI, ball, bin_nearest, cube
from plexus.operators import chains, diameters, distances, histology, kernels, network, parabolic, points, regions, rewrites, stencils
from plexus.plans.scratch import folder, materialise, put_bytes
from plexus.sources import cmgui, files, lists, tiff
from plexus.streaming import slices

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
W, H, D = SIZE
#: Queries about loose ends and chains, which the dense network lacks, are registered over the sparse one too.
ON_SPARSE = {"dead_ends", "unconnected_edges", "prune_one_cycle", "heal_dead_ends", "contract_chains", "chain_points", "join_loose_ends", "reduce_edges", "sprout_network", "prune_least_diam", "superfluous_edges"}


def query(sql: str | None = None):
    """Register a function of the fixtures; ``sql`` follows the fixtures' common table expressions."""

    def put(f):
        for name, thin in ((f.__name__, False), *([(f"sparse_{f.__name__}", True)] if f.__name__ in ON_SPARSE else [])):
            QUERIES[name] = lambda spark, sf_dir, thin=thin: f(Fixtures(spark, sf_dir, thin))
            if sql:
                SQL[name] = f"{ctes(thin)}{'' if sql.lstrip().startswith('SELECT') else ','}\n{sql.strip()}"
        return f

    return put


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def values(spark, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


# Pieces of SQL that several queries share.
SEG = f"""seg AS (SELECT * FROM (SELECT e_id, seq, x, y, z, d, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(d) OVER w AS pd FROM net_point WINDOW w AS (PARTITION BY e_id ORDER BY seq)) q WHERE px IS NOT NULL)"""
DIM = f"""{SEG}, st AS (SELECT e_id, sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)) AS step, d, pd FROM seg),
m AS (SELECT e_id, count(*) AS npts, avg(d) AS mean_diam FROM net_point GROUP BY e_id),
dim0 AS (SELECT e_id, sum(step) AS length, sum({PI}*step*(d*d/4+pd*pd/4)/2) AS volume FROM st GROUP BY e_id),
dim AS (SELECT m.e_id, m.npts, length, volume, mean_diam, CASE WHEN length > 0 THEN 2*sqrt(volume/({PI}*length)) END AS equiv_diam FROM m JOIN dim0 ON m.e_id = dim0.e_id)"""
DEG = "deg AS (SELECT v_id, count(*) AS n_links FROM (SELECT v0 AS v_id FROM net_edge UNION ALL SELECT v1 FROM net_edge) q GROUP BY v_id)"
CC = """reach(v_id, label) AS (SELECT v0, v0 FROM net_edge UNION SELECT v1, v1 FROM net_edge UNION SELECT CASE WHEN e.v0 = r.v_id THEN e.v1 ELSE e.v0 END, r.label FROM reach r JOIN net_edge e ON e.v0 = r.v_id OR e.v1 = r.v_id),
cc AS (SELECT v_id, min(label) AS component FROM reach GROUP BY v_id)"""
ENDS = "ends AS (SELECT e.e_id, e.v0, e.v1, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1 FROM net_edge e JOIN net_vertex a ON a.v_id = e.v0 JOIN net_vertex b ON b.v_id = e.v1)"


def offset_sql(table) -> str:
    return "VALUES " + ", ".join(str(o) for o in table)


def pushed_sql(src: str, table) -> str:
    return f"(SELECT s.x + o.dx AS x, s.y + o.dy AS y, s.z + o.dz AS z, count(*) AS n FROM {src} s, ({offset_sql(table)}) o(dx, dy, dz) GROUP BY 1, 2, 3)"


BOX = f"x BETWEEN 0 AND {W-1} AND y BETWEEN 0 AND {H-1} AND z BETWEEN 0 AND {D-1}"
GRID = f"grid AS (SELECT CAST(a.i AS INT) AS x, CAST(b.i AS INT) AS y, CAST(c.i AS INT) AS z FROM range({W}) a(i), range({H}) b(i), range({D}) c(i))"
DENSE = f"{GRID}, dense AS (SELECT g.x, g.y, g.z, coalesce(v.v, 0) AS v FROM grid g LEFT JOIN vox v ON g.x = v.x AND g.y = v.y AND g.z = v.z)"


# --- voxel point operators -------------------------------------------------


def background(f: Fixtures) -> DataFrame:
    return f.vox.select(((F.col("x") + 1) % W).alias("x"), "y", "z", "v")


BACK = f"back AS (SELECT (x + 1) % {W} AS x, y, z, v FROM vox)"


@query(f"{BACK} SELECT v.x, v.y, v.z, 255 AS v FROM vox v LEFT JOIN back b ON v.x = b.x AND v.y = b.y AND v.z = b.z WHERE v.v >= CASE WHEN coalesce(b.v, 0) >= 57 THEN 60 ELSE coalesce(b.v, 0) + 3 END")
def vox_threshold(f):
    return points.threshold(f.vox, background(f), 60, 3)


@query("SELECT x, y, z, CAST(floor(255 * pow(v / 255.0, 1 / 2.0)) AS INT) AS v FROM vox WHERE floor(255 * pow(v / 255.0, 1 / 2.0)) <> 0")
def vox_gamma(f):
    return points.gamma(f.vox, 2.0)


@query(f"{DENSE} SELECT x, y, z, 255 - v AS v FROM dense WHERE v <> 255")
def vox_invert(f):
    return points.invert(f.vox, *SIZE)


@query("SELECT x, y, z, CAST(least(floor(v * 1.5), 255) AS INT) AS v FROM vox")
def vox_scale(f):
    return points.scale(f.vox, 1.5)


@query("SELECT x, y, z, CAST(floor(v * 1.5) AS INT) % 256 AS v FROM vox WHERE CAST(floor(v * 1.5) AS INT) % 256 <> 0")
def vox_scale_compat(f):
    return points.scale(f.vox, 1.5, compat=True)


@query("SELECT x, y, z, v * 200 // 256 AS v FROM vox WHERE v * 200 // 256 <> 0")
def vox_convert_16(f):
    return points.convert_16_to_8(f.vox.withColumn("v", F.col("v") * 200))


@query("SELECT x, y, z, v * 10 * 255 // 4095 AS v FROM vox WHERE v * 10 * 255 // 4095 >= 20")
def vox_convert_bits(f):
    return points.convert_bits(f.vox.withColumn("v", F.col("v") * 10), 12, 20)


@query("SELECT x, y, z, 255 AS v FROM vox WHERE v % 7 = 1")
def vox_convert_1_255(f):
    return points.convert_1_255(f.vox.withColumn("v", F.col("v") % 7))


@query("SELECT x, y, z, 255 AS v FROM vox WHERE v >= 128")
def vox_binarise(f):
    return points.binarise(f.vox, 128)


@query("SELECT count(*) AS n_lit FROM vox WHERE v <> 0")
def vox_count(f):
    return points.count_lit(f.vox)


@query(f"{BACK} SELECT x, y, z, CAST(least(sum(v), 255) AS INT) AS v FROM (SELECT * FROM vox UNION ALL SELECT * FROM back) q GROUP BY 1, 2, 3")
def vox_add(f):
    return points.add(f.vox, background(f))


@query(f"{BACK} SELECT v.x, v.y, v.z, v.v - coalesce(b.v, 0) AS v FROM vox v LEFT JOIN back b ON v.x = b.x AND v.y = b.y AND v.z = b.z WHERE v.v > coalesce(b.v, 0)")
def vox_subtract(f):
    return points.subtract(f.vox, background(f))


@query("SELECT x, y, z, v - 100 AS v FROM vox WHERE v > 100")
def vox_subtract_value(f):
    return points.subtract_value(f.vox, 100)


@query("SELECT v.x, v.y, v.z, v.v FROM vox v JOIN lit l ON v.x = l.x AND v.y = l.y AND v.z = l.z")
def vox_mask(f):
    return points.mask(f.vox, f.lit)


@query("s AS (SELECT z, dense_rank() OVER (ORDER BY z) - 1 AS k FROM (SELECT DISTINCT z FROM vox WHERE z % 3 <> 1) q) SELECT x, y, CAST(k AS INT) AS z, v FROM vox JOIN s ON vox.z = s.z")
def vox_stack(f):
    return points.stack(f.vox.where("z % 3 <> 1").selectExpr("z AS slice_no", "x", "y", "v"))


@query("SELECT x - 10 AS x, y, z - 2 AS z, v FROM vox WHERE x BETWEEN 10 AND 40 AND z BETWEEN 2 AND 8")
def vox_crop_block(f):
    return points.crop(f.vox, (10, -1, 2), (40, -1, 8))


@query("SELECT x - 15 AS x, y - 15 AS y, z + 9 AS z, v FROM vox WHERE (x-30)*(x-30) + (y-30)*(y-30) + (z-6)*(z-6) <= 100")
def vox_crop_sphere(f):
    return points.crop_sphere(f.vox, (30, 30, 6), 10)


@query("SELECT x - 31 AS x, y, z, v FROM vox WHERE x > 30")
def vox_cut(f):
    return points.cut(f.vox, "x", 30)[1]


@query("SELECT * FROM vox")
def vox_cut_join(f):
    return points.join(*points.cut(f.vox, "x", 30), "x", 31)


@query("SELECT CAST(x >= 32 AS INT) AS qx, CAST(y >= 32 AS INT) AS qy, x % 32 AS x, y % 32 AS y, z, v FROM vox")
def vox_quarter(f):
    return points.quarter(f.vox, W, H)


# --- stencils --------------------------------------------------------------


@query(f"""{DENSE}, s AS (SELECT x, y, z, sum(v) OVER (PARTITION BY y, z ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM dense),
t AS (SELECT x, y, z, sum(v) OVER (PARTITION BY x, z ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM s),
u AS (SELECT x, y, z, sum(v) OVER (PARTITION BY x, y ORDER BY z RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM t)
SELECT x, y, z, CAST(floor(v / ((least(x+2, {W-1}) - greatest(x-2, 0) + 1) * (least(y+2, {H-1}) - greatest(y-2, 0) + 1) * (least(z+2, {D-1}) - greatest(z-2, 0) + 1)) + 0.5) AS INT) AS v FROM u
WHERE floor(v / ((least(x+2, {W-1}) - greatest(x-2, 0) + 1) * (least(y+2, {H-1}) - greatest(y-2, 0) + 1) * (least(z+2, {D-1}) - greatest(z-2, 0) + 1)) + 0.5) <> 0""")
def vox_smooth(f):
    return stencils.smooth(f.vox, 2, SIZE)


@query(f"SELECT l.* FROM lit l JOIN {pushed_sql('lit', [o for o in cube(2) if o != (0, 0, 0)])} p ON l.x = p.x AND l.y = p.y AND l.z = p.z WHERE p.n >= 3")
def vox_despeckle(f):
    return stencils.despeckle(f.lit, 3)


@query(f"SELECT l.* FROM lit l JOIN {pushed_sql('lit', cube(1))} p ON l.x = p.x AND l.y = p.y AND l.z = p.z WHERE p.n > 2")
def vox_despeckle_lite(f):
    return stencils.despeckle_lite(f.lit)


@query(f"big AS MATERIALIZED (SELECT x, y, z FROM {pushed_sql('lit', cube(1))} p WHERE {BOX}) SELECT x, y, z, 255 AS v FROM {pushed_sql('big', cube(1))} p WHERE n * 2 > 27 AND {BOX}")
def vox_denoise(f):
    return stencils.denoise(stencils.fatten(f.lit, 3, SIZE), 1, SIZE)


@query("""w AS (SELECT a.i*3 AS wx, b.i*3 AS wy, c.i*3 AS wz FROM range(22) a(i), range(22) b(i), range(6) c(i)),
h AS (SELECT wx, wy, wz FROM w JOIN lit l ON l.x >= wx AND l.x < wx+5 AND l.y >= wy AND l.y < wy+5 AND l.z >= wz AND l.z < wz+5 GROUP BY 1, 2, 3 HAVING count(*) > 0.2*125)
SELECT l.* FROM lit l WHERE NOT EXISTS (SELECT 1 FROM h WHERE l.x >= wx AND l.x < wx+5 AND l.y >= wy AND l.y < wy+5 AND l.z >= wz AND l.z < wz+5)""")
def vox_deblob(f):
    return stencils.deblob(f.lit, 5, 0.2, 3)


@query(f"SELECT x, y, z, 255 AS v FROM {pushed_sql('lit', ball(2))} p WHERE {BOX}")
def vox_dilate(f):
    return stencils.dilate_ball(f.lit, 2, SIZE)


ER = f"SELECT l.x, l.y, l.z FROM big l WHERE NOT EXISTS (SELECT 1 FROM ({offset_sql(ball(1))}) o(dx, dy, dz) WHERE l.x+dx BETWEEN 0 AND {W-1} AND l.y+dy BETWEEN 0 AND {H-1} AND l.z+dz BETWEEN 0 AND {D-1} AND NOT EXISTS (SELECT 1 FROM big k WHERE k.x = l.x+dx AND k.y = l.y+dy AND k.z = l.z+dz))"
BIG = f"big AS MATERIALIZED (SELECT x, y, z FROM {pushed_sql('lit', cube(1))} p WHERE {BOX})"


@query(f"{BIG}, er AS ({ER}) SELECT x, y, z, 255 AS v FROM er")
def vox_erode(f):
    return stencils.erode_ball(stencils.fatten(f.lit, 3, SIZE), 1, SIZE)


@query(f"{BIG} SELECT x, y, z, 255 AS v FROM big")
def vox_fatten(f):
    return stencils.fatten(f.lit, 3, SIZE)


@query(f"{BIG}, er AS ({ER}) SELECT * FROM big EXCEPT SELECT * FROM er")
def vox_boundary(f):
    return stencils.boundary(stencils.fatten(f.lit, 3, SIZE), SIZE)


@query(f"gr AS (SELECT x, y, z FROM {pushed_sql('lit', ball(2))} p) SELECT x, y, z, 255 AS v FROM {pushed_sql('gr', ball(2))} q WHERE n = {len(ball(2))} AND {BOX}")
def vox_close(f):
    return stencils.close_ball(f.lit, 2, SIZE)


@query("SELECT count(*) AS n_faces FROM lit l, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx, dy, dz) WHERE NOT EXISTS (SELECT 1 FROM lit k WHERE k.x = l.x+dx AND k.y = l.y+dy AND k.z = l.z+dz)")
def vox_surface(f):
    return stencils.surface_faces(f.lit)


@query(f"SELECT l.x, l.y, l.z, CAST(coalesce(p.n, 0) AS INT) AS n FROM lit l LEFT JOIN {pushed_sql('lit', [o for o in cube(1) if o != (0, 0, 0)])} p ON l.x = p.x AND l.y = p.y AND l.z = p.z")
def vox_adjacency(f):
    return stencils.degrees(f.lit)


# --- regions ---------------------------------------------------------------


def reach_sql(name: str, start: str, nodes: str, table) -> str:
    """Voxels of ``nodes`` that ways over the offsets lead to from ``start``."""
    return f"{name}(x, y, z) AS (SELECT x, y, z FROM {start} UNION SELECT n.x, n.y, n.z FROM {name} r, ({offset_sql(table)}) o(dx, dy, dz), {nodes} n WHERE n.x = r.x + o.dx AND n.y = r.y + o.dy AND n.z = r.z + o.dz)"


OBJ = f"""li AS (SELECT x, y, z, (CAST(z AS BIGINT) * {H} + y) * {W} + x AS id FROM lit),
ln AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM li a, ({offset_sql(N26)}) o(dx, dy, dz), li b WHERE b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz),
ob(id, label) AS (SELECT id, id FROM li UNION SELECT l.b, o.label FROM ob o JOIN ln l ON l.a = o.id WHERE l.b > o.label),
nm AS (SELECT label, count(*) AS n_voxels FROM (SELECT id, min(label) AS label FROM ob GROUP BY id) q GROUP BY label)"""


@query(f"{OBJ} SELECT label, n_voxels FROM nm WHERE n_voxels >= 3 ORDER BY n_voxels DESC, label LIMIT 5")
def vox_connect(f):
    return regions.largest_objects(f.lit, SIZE, 3, 5)


@query(f"{OBJ} SELECT label, n_voxels FROM nm WHERE n_voxels >= 2 ORDER BY n_voxels DESC, label LIMIT 20")
def vox_fibre_connect(f):
    return regions.largest_objects(f.lit, SIZE, 2, 20)


@query(f"""{BIG}, {GRID}, bk AS MATERIALIZED (SELECT * FROM grid EXCEPT SELECT CAST(x AS INT), CAST(y AS INT), CAST(z AS INT) FROM big),
bf AS (SELECT * FROM bk WHERE x IN (0, {W-1}) OR y IN (0, {H-1}) OR z IN (0, {D-1})), {reach_sql('rb', 'bf', 'bk', N6)}
SELECT x, y, z, 255 AS v FROM (SELECT * FROM grid EXCEPT SELECT * FROM rb) q""")
def vox_fill_holes(f):
    return regions.fill_holes(stencils.fatten(f.lit, 3, SIZE), SIZE)


@query(f"sd AS (SELECT x, y, z FROM lit WHERE x + y < 20), {reach_sql('rf', 'sd', 'lit', N26)} SELECT x, y, z, 255 AS v FROM rf")
def vox_flood(f):
    return regions.flood(f.lit, SIZE, f.lit.where("x + y < 20").select("x", "y", "z"))


@query()
def vox_flood2d(f):
    return kernels.fill_slices(stencils.fatten(f.lit, 3, SIZE), SIZE, 12)


# --- parabolic morphology ---------------------------------------------------


def passes_sql(name: str, src: str, curvature: float, dilate: bool = False) -> str:
    """Three passes of a parabolic erosion (or dilation) of the values v of ``src``, by the definition of each."""
    out, best, sign = [], "max" if dilate else "min", "-" if dilate else "+"
    for i, a in enumerate("xyz"):
        b, c = (k for k in "xyz" if k != a)
        out.append(f"{name}{i} AS MATERIALIZED (SELECT p.x, p.y, p.z, {best}(q.v {sign} CAST({curvature} AS DOUBLE) * (p.{a} - q.{a}) * (p.{a} - q.{a})) AS v FROM {src} p JOIN {src} q ON q.{b} = p.{b} AND q.{c} = p.{c} GROUP BY p.x, p.y, p.z)")
        src = f"{name}{i}"
    return ", ".join(out)


FAR = float(W * W + H * H + D * D)
MASK = f"{BIG}, {GRID}, mk AS (SELECT g.x, g.y, g.z, b.x IS NOT NULL AS lit FROM grid g LEFT JOIN big b ON b.x = g.x AND b.y = g.y AND b.z = g.z), mi AS MATERIALIZED (SELECT x, y, z, CASE WHEN lit THEN CAST({FAR} AS DOUBLE) ELSE 0 END AS v FROM mk)"


def value_sql(src: str) -> str:
    return f"{DENSE}, dv AS MATERIALIZED (SELECT x, y, z, CAST(v AS DOUBLE) AS v FROM {src})"


@query(f"{MASK}, {passes_sql('dt', 'mi', 1.0)} SELECT x, y, z, round(sqrt(v), 4) AS dist FROM dt2")
def vox_distance_transform(f):
    return rounded(parabolic.distance_transform(stencils.fatten(f.lit, 3, SIZE), SIZE))


@query(f"""{MASK}, mo AS MATERIALIZED (SELECT x, y, z, {FAR} - v AS v FROM mi), {passes_sql('din', 'mi', 1.0)}, {passes_sql('dou', 'mo', 1.0)}
SELECT a.x, a.y, a.z, round(sqrt(a.v) - sqrt(b.v), 4) AS dist FROM din2 a JOIN dou2 b ON b.x = a.x AND b.y = a.y AND b.z = a.z""")
def vox_signed_distance(f):
    return rounded(parabolic.signed_distance(stencils.fatten(f.lit, 3, SIZE), SIZE))


@query(f"{value_sql('dense')}, {passes_sql('lo', 'dv', 2.0)}, {passes_sql('op', 'lo2', 2.0, dilate=True)} SELECT x, y, z, v FROM op2")
def vox_parabolic_open(f):
    return parabolic.opened(points.dense(f.vox, *SIZE), 0.25)


@query(f"{value_sql('dense')}, {passes_sql('hi', 'dv', 2.0, dilate=True)}, {passes_sql('cl', 'hi2', 2.0)} SELECT x, y, z, v FROM cl2")
def vox_parabolic_close(f):
    return parabolic.closed(points.dense(f.vox, *SIZE), 0.25)


@query(f"""{value_sql('dense')}, {passes_sql('lo', 'dv', 8.0)}, {passes_sql('hi', 'dv', 8.0, dilate=True)}
SELECT d.x, d.y, d.z, CASE WHEN h.v - d.v < d.v - l.v THEN h.v WHEN d.v - l.v < h.v - d.v THEN l.v ELSE d.v END AS v
FROM dv d JOIN lo2 l ON l.x = d.x AND l.y = d.y AND l.z = d.z JOIN hi2 h ON h.x = d.x AND h.y = d.y AND h.z = d.z""")
def vox_sharpen(f):
    return parabolic.sharpened(points.dense(f.vox, *SIZE), 0.0625)


def reached_sql(name: str, src: str, r2: int) -> str:
    """Voxels that a voxel of ``src`` reaches within squared distances under r2."""
    n = math.isqrt(r2 - 1)
    return f"(SELECT DISTINCT s.x + o.dx AS x, s.y + o.dy AS y, s.z + o.dz AS z FROM {src} s, ({offset_sql([o for o in cube(n) if sum(v * v for v in o) < r2])}) o(dx, dy, dz)) {name}"


@query(f"""{MASK}, un AS (SELECT x, y, z FROM mk WHERE NOT lit), kp AS MATERIALIZED (SELECT x, y, z FROM mk WHERE lit EXCEPT SELECT * FROM {reached_sql('e', 'un', 3)})
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, 255 AS v FROM {reached_sql('k', 'kp', 3)} WHERE {BOX}""")
def vox_binary_open(f):
    return parabolic.binary_open(stencils.fatten(f.lit, 3, SIZE), SIZE, 1)


@query(f"""wg AS (SELECT CAST(a.i - 4 AS INT) AS x, CAST(b.i - 4 AS INT) AS y, CAST(c.i - 4 AS INT) AS z FROM range({W + 8}) a(i), range({H + 8}) b(i), range({D + 8}) c(i)),
gr AS MATERIALIZED (SELECT * FROM {reached_sql('g', 'lit', 6)}), un AS (SELECT * FROM wg EXCEPT SELECT * FROM gr)
SELECT x, y, z, 255 AS v FROM (SELECT * FROM gr EXCEPT SELECT * FROM {reached_sql('u', 'un', 6)}) q WHERE {BOX}""")
def vox_binary_close(f):
    return parabolic.binary_close(f.lit, SIZE, 2)


@query("SELECT z, CAST(sum(v) AS BIGINT) AS raw, count(*) AS n FROM vox WHERE v > 20 GROUP BY z")
def vox_streamed_sums(f):
    return slices.streamed_sums(f.spark, f.vox, 20)


@query()
def vox_skeleton(f):
    return kernels.skeleton(stencils.fatten(f.lit, 3, SIZE), SIZE)


@query()
def vox_watershed(f):
    return kernels.watershed(f.vox, f.lit.where("x % 16 = 3 and y % 16 = 5").select("x", "y", "z", (F.col("x") + 64 * F.col("y") + 1).alias("label")), SIZE)


@query()
def vox_equalise(f):
    return kernels.equalise(f.vox, 20, D)


@query()
def vox_ray_diameter(f):
    ids = f.lit.selectExpr("cast(x + 64 * y + 4096 * z as long) AS id", "x", "y", "z", "0.0D AS tx", "0.6D AS ty", "0.8D AS tz")
    return rounded(kernels.ray_diameters(ids, stencils.fatten(f.lit, 5, SIZE)))


# --- networks --------------------------------------------------------------


@query(f"{DIM} SELECT e_id, npts, round(length, 4) AS length, round(volume, 4) AS volume, round(mean_diam, 4) AS mean_diam, round(equiv_diam, 4) AS equiv_diam FROM dim")
def edge_dimensions(f):
    return rounded(network.edge_dimensions(f.net_point))


def hist_sql(src: str, b: str, w: str | None = None) -> str:
    weight = f", round(coalesce(b.w, 0), 4) AS weight, round(coalesce(b.w, 0) / sum(b.w) OVER (), 4) AS weight_share" if w else ""
    return f"""b AS (SELECT CAST({b} AS BIGINT) AS bin, count(*) AS n{f', sum({w}) AS w' if w else ''} FROM {src} GROUP BY 1),
r AS (SELECT CAST(unnest(generate_series(0, (SELECT max(bin) FROM b) + 1)) AS BIGINT) AS bin)
SELECT r.bin, coalesce(b.n, 0) AS n, round(coalesce(b.n, 0) / sum(b.n) OVER (), 4) AS share{weight} FROM r LEFT JOIN b ON r.bin = b.bin"""


@query(f"{DIM}, {hist_sql('dim', 'floor(equiv_diam / 0.5 + 0.5)', 'length')}")
def diam_histogram(f):
    return rounded(network.histogram(network.edge_dimensions(f.net_point).where("equiv_diam is not null"), bin_nearest(F.col("equiv_diam"), 0.5), F.col("length")))


@query(hist_sql("net_point", "floor(d / 0.5 + 0.5)"))
def point_diam_histogram(f):
    return rounded(network.histogram(f.net_point, bin_nearest(F.col("d"), 0.5)))


@query(f"{DIM}, {hist_sql('dim', 'floor(length / 25 + 0.5)')}")
def len_histogram(f):
    return rounded(network.histogram(network.edge_dimensions(f.net_point), bin_nearest(F.col("length"), 25)))


@query(f"{DIM}, lm AS (SELECT * FROM dim WHERE length >= 300), {hist_sql('lm', 'floor(length / 25 + 0.5)')}")
def len_histogram_by_length(f):
    return rounded(network.histogram(network.edge_dimensions(f.net_point).where("length >= 300"), bin_nearest(F.col("length"), 25)))


@query(f"{DIM}, lm AS (SELECT * FROM dim WHERE length / equiv_diam >= 100), {hist_sql('lm', 'floor(length / 25 + 0.5)')}")
def len_histogram_by_ratio(f):
    return rounded(network.histogram(network.edge_dimensions(f.net_point).where("length / equiv_diam >= 100"), bin_nearest(F.col("length"), 25)))


@query(f"{DIM} SELECT count(*) AS n_edges, round(sum(length), 2) AS length, round(avg(length), 4) AS mean_length, round(avg(equiv_diam), 4) AS mean_diam, round(sum(equiv_diam * length) / sum(length), 4) AS weighted_diam, round(sum(length * {PI} * equiv_diam * equiv_diam / 4), 2) AS volume FROM dim WHERE length > 0")
def network_summary(f):
    d = network.edge_dimensions(f.net_point).where("length > 0")
    e, n = F.col("equiv_diam"), F.col("length")
    return d.agg(F.count("*").alias("n_edges"), F.round(F.sum(n), 2).alias("length"), F.round(F.avg(n), 4).alias("mean_length"), F.round(F.avg(e), 4).alias("mean_diam"), F.round(F.sum(e * n) / F.sum(n), 4).alias("weighted_diam"), F.round(F.sum(n * PI * e * e / 4), 2).alias("volume"))


@query("b AS (SELECT CAST(floor(d / 0.5 + 0.5) AS BIGINT) AS bin, count(*) AS n FROM net_point GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS c FROM b) SELECT round((min(bin) - 1) * 0.5, 4) AS d95 FROM c WHERE c > 0.05")
def d95_cumulative(f):
    from pyspark.sql import Window

    b = network.histogram(f.net_point, bin_nearest(F.col("d"), 0.5))  # a row per bin, not per point
    c = b.withColumn("c", F.sum("share").over(Window.orderBy("bin")))
    return c.where("c > 0.05").agg(F.round((F.min("bin") - 1) * 0.5, 4).alias("d95"))


DSEL = "s AS (SELECT e_id, avg(d) AS m, count(CASE WHEN d >= 3 AND d < 5 THEN 1 END) AS k, count(*) AS n FROM net_point GROUP BY e_id)"


@query(f"{DSEL} SELECT e_id FROM s WHERE m BETWEEN 3 AND 5")
def select_diam_avg(f):
    return network.select_diameter(f.net_point, 3, 5)


@query(f"{DSEL} SELECT e_id FROM s WHERE k > n // 2")
def select_diam_majority(f):
    return network.select_diameter(f.net_point, 3, 5, "majority")


@query(f"{DSEL} SELECT e_id FROM s WHERE k = n")
def select_diam_all(f):
    return network.select_diameter(f.net_point, 3, 5, "all")


@query(f"{DIM} SELECT e_id FROM dim WHERE length BETWEEN 200 AND 600")
def select_length(f):
    return network.edge_dimensions(f.net_point).where("length between 200 and 600").select("e_id")


@query(f"{DIM} SELECT e_id FROM dim WHERE length / mean_diam <= 100")
def select_ratio_le(f):
    return network.edge_dimensions(f.net_point).where("length / mean_diam <= 100").select("e_id")


@query(f"{DIM} SELECT e_id FROM dim WHERE length / mean_diam > 100")
def select_ratio_gt(f):
    return network.edge_dimensions(f.net_point).where("length / mean_diam > 100").select("e_id")


def touch_sql(test: str) -> str:
    return f"i AS (SELECT v_id FROM net_vertex WHERE {test}) SELECT * FROM net_edge WHERE v0 IN (SELECT v_id FROM i) OR v1 IN (SELECT v_id FROM i)"


D2 = "(x-500)*(x-500)+(y-500)*(y-500)+(z-250)*(z-250)"


@query(touch_sql(f"{D2} <= 40000"))
def zoom_sphere(f):
    return network.touching(f.net_edge, f.net_vertex, network.in_sphere((500, 500, 250), 200))


@query(touch_sql("abs(x-500) <= 200 AND abs(y-500) <= 200 AND abs(z-250) <= 200"))
def zoom_cube(f):
    return network.touching(f.net_edge, f.net_vertex, network.in_cube((500, 500, 250), 200))


@query(touch_sql(f"{D2} < 40000"))
def am_block_sphere(f):
    return network.touching(f.net_edge, f.net_vertex, network.in_sphere((500, 500, 250), 200, strict=True))


@query(touch_sql("x BETWEEN 100 AND 400 AND y BETWEEN 200 AND 700 AND z BETWEEN 50 AND 300"))
def am_block_box(f):
    return network.touching(f.net_edge, f.net_vertex, F.expr("x BETWEEN 100 AND 400 AND y BETWEEN 200 AND 700 AND z BETWEEN 50 AND 300"))


@query("""b AS (SELECT v_id, bx.k + bby.k + bz.k AS block FROM net_vertex, (VALUES (0), (1)) bx(k), (VALUES (0), (2)) bby(k), (VALUES (0), (4)) bz(k)
WHERE CASE bx.k WHEN 0 THEN x <= 500 ELSE x >= 500 END AND CASE bby.k WHEN 0 THEN y <= 500 ELSE y >= 500 END AND CASE bz.k WHEN 0 THEN z <= 250 ELSE z >= 250 END)
SELECT DISTINCT CAST(block AS INT) AS block, e_id FROM net_edge JOIN b ON b.v_id = v0 OR b.v_id = v1""")
def am_cut_octants(f):
    return network.half_space_blocks(f.net_edge, f.net_vertex, (500, 500, 250))


@query(f"{ENDS} SELECT * FROM (SELECT CAST(e_id % 2 AS INT) AS block, * FROM ends UNION ALL SELECT 2, e_id, v1, v0, x1+0.03, y1, z1, x0, y0-0.02, z0 FROM ends WHERE e_id % 5 = 0) p WHERE NOT (block = 2 OR (block = 1 AND EXISTS (SELECT 1 FROM ends q WHERE q.e_id % 2 = 0 AND ((q.x0 = p.x0 AND q.y0 = p.y0 AND q.z0 = p.z0 AND q.x1 = p.x1 AND q.y1 = p.y1 AND q.z1 = p.z1) OR (q.x0 = p.x1 AND q.y0 = p.y1 AND q.z0 = p.z1 AND q.x1 = p.x0 AND q.y1 = p.y0 AND q.z1 = p.z0)))))")
def am_join_dedupe(f):
    e = network.endpoints(f.net_edge, f.net_vertex).select((F.col("e_id") % 2).cast("int").alias("block"), "e_id", "v0", "v1", *(f"{a}{i}" for i in "01" for a in "xyz"))
    copy = e.where("e_id % 5 = 0").select(F.lit(2).alias("block"), "e_id", F.col("v1").alias("v0"), F.col("v0").alias("v1"), (F.col("x1") + 0.03).alias("x0"), F.col("y1").alias("y0"), F.col("z1").alias("z0"), F.col("x0").alias("x1"), (F.col("y0") - 0.02).alias("y1"), F.col("z0").alias("z1"))
    return network.join_networks(e.unionByName(copy))


@query("d AS (SELECT e_id, avg(d) AS m FROM net_point GROUP BY e_id), r AS (SELECT e.e_id, row_number() OVER (PARTITION BY least(v0, v1), greatest(v0, v1) ORDER BY m DESC, e.e_id) AS k FROM net_edge e JOIN d ON d.e_id = e.e_id) SELECT e_id FROM r WHERE k = 1")
def parallel_edge_dedupe(f):
    return network.parallel_edges(f.net_edge, f.net_point)


@query(f"{DEG} SELECT * FROM deg")
def vertex_degree(f):
    return network.degree(f.net_edge)


@query(f"{DEG} SELECT v.* FROM net_vertex v JOIN deg ON deg.v_id = v.v_id WHERE n_links = 1")
def dead_ends(f):
    return distances.sprouts(f.net_edge, f.net_vertex)


@query(f"{DEG} SELECT e.*, a.n_links = 1 AS free0, b.n_links = 1 AS free1 FROM net_edge e JOIN deg a ON a.v_id = v0 JOIN deg b ON b.v_id = v1 WHERE a.n_links = 1 AND b.n_links = 1")
def unconnected_edges(f):
    return network.loose_ends(f.net_edge).where("free0 and free1")


@query(f"{DIM}, {DEG} SELECT e.* FROM net_edge e JOIN dim ON dim.e_id = e.e_id JOIN deg a ON a.v_id = v0 JOIN deg b ON b.v_id = v1 WHERE NOT ((a.n_links = 1 OR b.n_links = 1) AND (length <= 300 OR length <= 50 * mean_diam))")
def prune_one_cycle(f):
    return network.prune(f.net_edge, f.net_point, 50, 300)


@query(f"""{DIM}, tk AS (SELECT e.*, length, mean_diam FROM net_edge e JOIN dim ON dim.e_id = e.e_id WHERE equiv_diam IS NULL OR equiv_diam >= 4.2),
dt AS (SELECT v_id, count(*) AS n_links FROM (SELECT v0 AS v_id FROM tk UNION ALL SELECT v1 FROM tk) q GROUP BY v_id)
SELECT e_id, v0, v1 FROM tk JOIN dt a ON a.v_id = v0 JOIN dt b ON b.v_id = v1 WHERE NOT ((a.n_links = 1 OR b.n_links = 1) AND (length <= 300 OR length <= 50 * mean_diam))""")
def prune_least_diam(f):
    return network.prune(f.net_edge, f.net_point, 50, 300, least_diam=4.2)


FIRSTS = """kp AS (SELECT e_id, v0, v1, row_number() OVER (ORDER BY e_id) - 1 AS e FROM net_edge WHERE v0 <> v1),
ft AS (SELECT v_id, row_number() OVER (ORDER BY min(k)) - 1 AS v FROM (SELECT 2*e AS k, v0 AS v_id FROM kp UNION ALL SELECT 2*e+1, v1 FROM kp) q GROUP BY v_id)"""


@query(f"{FIRSTS} SELECT e AS e_id, a.v AS v0, b.v AS v1, p.seq, round(p.x, 4) AS x FROM kp JOIN ft a ON a.v_id = v0 JOIN ft b ON b.v_id = v1 JOIN net_point p ON p.e_id = kp.e_id")
def squeeze(f):
    _, edge, point = network.squeeze(f.net_edge, f.net_vertex, f.net_point)
    return rounded(edge.join(point.select("e_id", "seq", "x"), "e_id"))


@query("""mv AS (SELECT e.e_id FROM net_edge e JOIN net_vertex a ON a.v_id = v0 JOIN net_vertex b ON b.v_id = v1 JOIN (SELECT e_id, max(seq) AS m FROM net_point GROUP BY e_id) k ON k.e_id = e.e_id
JOIN net_point p ON p.e_id = e.e_id AND p.seq = 0 JOIN net_point q ON q.e_id = e.e_id AND q.seq = k.m WHERE p.x <> a.x OR p.y <> a.y OR p.z <> a.z OR q.x <> b.x OR q.y <> b.y OR q.z <> b.z)
SELECT count(*) AS n_edges, count(CASE WHEN v0 = v1 THEN 1 END) AS n_loops, (SELECT count(*) FROM mv) AS n_moved, count(*) - count(DISTINCT (least(v0, v1), greatest(v0, v1))) AS n_repeats FROM net_edge""")
def check_network(f):
    return network.check_network(f.net_edge, f.net_vertex, f.net_point)


@query(f"{DEG} SELECT 2 * e.e_id + k AS v_id, v.x, v.y, v.z FROM net_edge e JOIN deg a ON a.v_id = v0 JOIN deg b ON b.v_id = v1, (VALUES (0), (1)) t(k) JOIN net_vertex v ON v.v_id = CASE k WHEN 0 THEN e.v0 ELSE e.v1 END WHERE a.n_links = 1 OR b.n_links = 1")
def sprout_network(f):
    return network.sprout_network(f.net_edge, f.net_vertex)[0]


@query("""pc AS (SELECT p.e_id, p.seq, p.x, p.y, p.z, e.v0, e.v1, floor(p.x/25) AS cx, floor(p.y/25) AS cy, floor(p.z/25) AS cz, max(p.seq) OVER (PARTITION BY p.e_id) AS m FROM net_point p JOIN net_edge e ON e.e_id = p.e_id),
jp AS (SELECT a.e_id, a.seq, b.e_id AS to_edge, b.seq AS to_seq, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM pc a JOIN pc b ON a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz
WHERE a.seq > 0 AND a.seq < a.m AND a.e_id <> b.e_id AND a.v0 <> b.v0 AND a.v0 <> b.v1 AND a.v1 <> b.v0 AND a.v1 <> b.v1),
jn AS (SELECT *, row_number() OVER (PARTITION BY e_id, seq ORDER BY d2, to_edge, to_seq) AS k FROM jp), jb AS (SELECT *, row_number() OVER (PARTITION BY e_id ORDER BY d2, seq) AS k2 FROM jn WHERE k = 1 AND d2 > 0)
SELECT e_id, seq, to_edge, to_seq, round(sqrt(d2), 4) AS dist FROM jb WHERE k2 = 1""")
def jump_points(f):
    return rounded(network.jump_points(f.net_edge, f.net_point, 25))


@query("SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM net_vertex")
def bounding_box(f):
    return network.bounding_box(f.net_vertex)


@query("SELECT v_id, x - 500 AS x, y - 500 AS y, z - 250 AS z FROM net_vertex")
def shift_origin(f):
    return f.net_vertex.select("v_id", (F.col("x") - 500).alias("x"), (F.col("y") - 500).alias("y"), (F.col("z") - 250).alias("z"))


INB = "ib AS (SELECT v_id FROM net_vertex WHERE x >= 0 AND x < 600 AND y >= 0 AND y < 600 AND z >= 0 AND z < 400)"


@query(f"{DIM}, {DEG}, {INB} SELECT (SELECT count(*) FROM deg WHERE n_links >= 3 AND v_id IN (SELECT v_id FROM ib)) AS n_branch, (SELECT round(coalesce(sum(length), 0), 3) FROM dim JOIN net_edge e ON e.e_id = dim.e_id WHERE v0 IN (SELECT v_id FROM ib) AND v1 IN (SELECT v_id FROM ib) AND equiv_diam BETWEEN 3 AND 6) AS length")
def vessel_density(f):
    return rounded(network.vessel_density(f.net_edge, f.net_vertex, network.edge_dimensions(f.net_point), (0, 0, 0), (600, 600, 400), 3, 6), 3)


SITES = "('a', 200.0, 200.0, 100.0, 150.0), ('b', 600.0, 500.0, 250.0, 250.0), ('c', 900.0, 900.0, 400.0, 300.0)"


@query(f"""{DIM}, s(site, x0, y0, z0, r) AS (VALUES {SITES}), h AS (SELECT DISTINCT s.site, s.r, e.e_id FROM s, net_edge e JOIN net_vertex v ON v.v_id = e.v0 OR v.v_id = e.v1 WHERE (x-x0)*(x-x0)+(y-y0)*(y-y0)+(z-z0)*(z-z0) < r*r)
SELECT site, round(count(*) * 1e9 / (4.0/3.0*{PI}*CAST(r AS DOUBLE)*r*r), 4) AS vess_per_mm3, round(sum(length) * 1e9 / (4.0/3.0*{PI}*CAST(r AS DOUBLE)*r*r), 1) AS len_per_mm3, round(sum(volume) / (4.0/3.0*{PI}*CAST(r AS DOUBLE)*r*r), 6) AS vol_fraction FROM h JOIN dim ON dim.e_id = h.e_id GROUP BY site, r""")
def site_batch_metrics(f):
    s = values(f.spark, SITES, "site, x0, y0, z0, r").selectExpr("site", *(f"cast({c} as double) AS {c}" for c in ("x0", "y0", "z0", "r")))
    out = network.sites(f.net_edge, f.net_vertex, network.edge_dimensions(f.net_point), s)
    return out.select("site", F.round("vess_per_mm3", 4).alias("vess_per_mm3"), F.round("len_per_mm3", 1).alias("len_per_mm3"), F.round("vol_fraction", 6).alias("vol_fraction"))


FIB = f"{ENDS}, fib AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0)) AS n FROM ends)"


@query(f"""{FIB}, {DEG}, o AS (SELECT e_id, v0 AS v_id, (x1-x0)/n AS ux, (y1-y0)/n AS uy, (z1-z0)/n AS uz FROM fib WHERE n > 0 UNION ALL SELECT e_id, v1, (x0-x1)/n, (y0-y1)/n, (z0-z1)/n FROM fib WHERE n > 0)
SELECT CAST(floor(degrees(acos(greatest(least(a.ux*b.ux+a.uy*b.uy+a.uz*b.uz, 1.0), -1.0))) / 4.0) AS BIGINT) AS bin, count(*) AS n FROM o a JOIN o b ON a.v_id = b.v_id AND a.e_id <> b.e_id JOIN deg ON deg.v_id = a.v_id WHERE n_links >= 3 GROUP BY 1""")
def branch_angle_histogram(f):
    return network.branch_angles(f.net_edge, f.net_vertex)


@query(f"{FIB} SELECT o.dx, o.dy, o.dz, round(sum(abs((x1-x0)*o.dx+(y1-y0)*o.dy+(z1-z0)*o.dz) / n / sqrt(o.dx*o.dx+o.dy*o.dy+o.dz*o.dz)) / (2 * count(*)), 4) AS mean FROM fib, ({offset_sql([o for o in cube(1) if o != (0, 0, 0)])}) o(dx, dy, dz) WHERE n > 0 GROUP BY 1, 2, 3")
def direction_projection(f):
    return rounded(network.direction_projection(f.net_edge, f.net_vertex))


@query("""c AS (SELECT *, floor(x/100) AS cx, floor(y/100) AS cy, floor(z/100) AS cz FROM net_vertex), p AS (SELECT a.v_id, b.v_id AS w, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM c a JOIN c b ON a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND a.v_id <> b.v_id
WHERE NOT EXISTS (SELECT 1 FROM net_edge e WHERE (e.v0 = a.v_id AND e.v1 = b.v_id) OR (e.v1 = a.v_id AND e.v0 = b.v_id))), r AS (SELECT *, row_number() OVER (PARTITION BY v_id ORDER BY d2, w) AS k FROM p) SELECT v_id, w AS nearest, d2 FROM r WHERE k = 1""")
def nearest_vertex(f):
    return network.nearest_unconnected(f.net_edge, f.net_vertex, 100)


@query(f"""{FIB}, {DEG}, o AS (SELECT v1 AS v_id, v0 AS back, x1 AS x, y1 AS y, z1 AS z, x1-x0 AS gx, y1-y0 AS gy, z1-z0 AS gz, n FROM fib UNION ALL SELECT v0, v1, x0, y0, z0, x0-x1, y0-y1, z0-z1, n FROM fib),
p AS (SELECT o.v_id, v.v_id AS target, sqrt((v.x-o.x)*(v.x-o.x)+(v.y-o.y)*(v.y-o.y)+(v.z-o.z)*(v.z-o.z)) AS dd, (v.x-o.x)*gx+(v.y-o.y)*gy+(v.z-o.z)*gz AS dot, n FROM o JOIN deg ON deg.v_id = o.v_id AND n_links = 1 JOIN net_vertex v ON v.v_id <> o.v_id AND v.v_id <> o.back AND abs(v.x-o.x) <= 250 AND abs(v.y-o.y) <= 250 AND abs(v.z-o.z) <= 250),
q AS (SELECT v_id, target, (0.5 + dot/(dd*n))/dd AS score FROM p WHERE dd > 0 AND dd <= 250), r AS (SELECT *, row_number() OVER (PARTITION BY v_id ORDER BY score DESC, target) AS k FROM q WHERE score > 0) SELECT v_id, target, round(score, 5) AS score FROM r WHERE k = 1""")
def heal_dead_ends(f):
    return rounded(network.heal(f.net_edge, f.net_vertex, 250), 5)


@query(f"{CC} SELECT e_id, component FROM net_edge JOIN cc ON cc.v_id = v0")
def edge_components(f):
    return network.edge_components(f.net_edge)


@query(f"{CC}, n AS (SELECT component, count(*) AS n FROM net_edge JOIN cc ON cc.v_id = v0 GROUP BY 1), t AS (SELECT component FROM n ORDER BY n DESC, component LIMIT 1) SELECT e_id FROM net_edge JOIN cc ON cc.v_id = v0 JOIN t ON t.component = cc.component")
def largest_component(f):
    return network.largest_component(f.net_edge)


@query(f"{CC}, n AS (SELECT component, count(*) AS n FROM net_edge JOIN cc ON cc.v_id = v0 GROUP BY 1) SELECT e_id FROM net_edge JOIN cc ON cc.v_id = v0 JOIN n ON n.component = cc.component WHERE n >= 10")
def fragments(f):
    return network.fragments(f.net_edge, 10)


@query(f"""{DEG}, k AS (SELECT v_id, min(e_id) AS a, max(e_id) AS b FROM (SELECT e_id, v0 AS v_id FROM net_edge UNION ALL SELECT e_id, v1 FROM net_edge) q WHERE v_id IN (SELECT v_id FROM deg WHERE n_links = 2) GROUP BY 1),
c(e_id, chain) AS (SELECT e_id, e_id FROM net_edge UNION SELECT CASE WHEN k.a = c.e_id THEN k.b ELSE k.a END, c.chain FROM c JOIN k ON k.a = c.e_id OR k.b = c.e_id) SELECT e_id, min(chain) AS chain FROM c GROUP BY 1""")
def contract_chains(f):
    return network.contract_chains(f.net_edge)


def chain_sql(edge: str) -> str:
    """Walks along the chains of an edge table: wk2 (first, dart, i) of each edge, on the way that begins at the lesser vertex."""
    return f"""dg AS (SELECT v_id, count(*) AS k FROM (SELECT v0 AS v_id FROM {edge} UNION ALL SELECT v1 FROM {edge}) q GROUP BY v_id),
lo AS (SELECT v_id FROM dg WHERE k = 2 AND v_id NOT IN (SELECT v0 FROM {edge} WHERE v0 = v1)),
tw AS (SELECT v_id, min(e_id) AS a, max(e_id) AS b FROM (SELECT e_id, v0 AS v_id FROM {edge} UNION ALL SELECT e_id, v1 FROM {edge}) q WHERE v_id IN (SELECT v_id FROM lo) GROUP BY 1),
cn(e_id, chain) AS (SELECT e_id, e_id FROM {edge} UNION SELECT CASE WHEN tw.a = cn.e_id THEN tw.b ELSE tw.a END, cn.chain FROM cn JOIN tw ON tw.a = cn.e_id OR tw.b = cn.e_id),
ch AS (SELECT e_id, min(chain) AS chain FROM cn GROUP BY 1),
ri AS (SELECT chain, min(v_id) AS v_id FROM (SELECT chain, v0 AS v_id FROM {edge} e JOIN ch ON ch.e_id = e.e_id UNION ALL SELECT chain, v1 FROM {edge} e JOIN ch ON ch.e_id = e.e_id) q GROUP BY chain HAVING count(CASE WHEN v_id IN (SELECT v_id FROM lo) THEN NULL ELSE 1 END) = 0),
jn AS MATERIALIZED (SELECT v_id FROM lo WHERE v_id NOT IN (SELECT v_id FROM ri)),
da AS MATERIALIZED (SELECT 2 * e_id AS dart, v0 AS tail, v1 AS head FROM {edge} UNION ALL SELECT 2 * e_id + 1, v1, v0 FROM {edge}),
nx AS MATERIALIZED (SELECT a.dart, b.dart AS nxt FROM da a JOIN da b ON b.tail = a.head WHERE b.dart // 2 <> a.dart // 2 AND a.head IN (SELECT v_id FROM jn)),
wk(first, tail, dart, i) AS (SELECT dart, tail, dart, 0 FROM da WHERE tail NOT IN (SELECT v_id FROM jn) UNION ALL SELECT w.first, w.tail, nx.nxt, w.i + 1 FROM wk w JOIN nx ON nx.dart = w.dart),
wk2 AS MATERIALIZED (SELECT dart // 2 AS e_id, dart % 2 AS k, first, i FROM (SELECT *, row_number() OVER (PARTITION BY dart // 2 ORDER BY tail, first) AS r FROM wk) q WHERE r = 1),
nm AS (SELECT first, min(e_id) AS chain FROM wk2 GROUP BY first)"""


@query(f"""{chain_sql('net_edge')}, np AS (SELECT e_id, count(*) AS n FROM net_point GROUP BY e_id),
sz AS (SELECT w.*, nm.chain, np.n, sum(np.n - 1) OVER (PARTITION BY w.first ORDER BY i) - (np.n - 1) AS before FROM wk2 w JOIN nm ON nm.first = w.first JOIN np ON np.e_id = w.e_id),
pt AS (SELECT s.chain AS e_id, s.before, s.i, CASE WHEN s.k = 0 THEN p.seq ELSE s.n - 1 - p.seq END AS ix, p.x, p.y, p.z, p.d FROM net_point p JOIN sz s ON s.e_id = p.e_id)
SELECT e_id, CAST(before + ix AS BIGINT) AS seq, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(d, 4) AS d FROM pt WHERE ix > 0 OR i = 0""")
def chain_points(f):
    return rounded(network.join_chains(f.net_edge, f.net_point)[1])


@query(f"""li AS (SELECT x, y, z, (CAST(z AS BIGINT) * {H} + y) * {W} + x AS id FROM lit),
lk AS MATERIALIZED (SELECT a.id * 13 + o.i AS e_id, a.id AS v0, b.id AS v1 FROM li a, (VALUES {", ".join(str((*o, i)) for i, o in enumerate(N13))}) o(dx, dy, dz, i), li b WHERE b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz),
{chain_sql('lk')}, rw AS (SELECT w.*, CASE WHEN k = 0 THEN v0 ELSE v1 END AS a, CASE WHEN k = 0 THEN v1 ELSE v0 END AS b FROM wk2 w JOIN lk ON lk.e_id = w.e_id)
SELECT nm.chain AS e_id, arg_min(a, i) AS v0, arg_max(b, i) AS v1, count(*) + 1 AS npts FROM rw JOIN nm ON nm.first = rw.first GROUP BY nm.chain""")
def vox_trace(f):
    _, edge, point = network.trace(f.lit, SIZE)
    return edge.join(point.groupBy("e_id").agg(F.count("*").alias("npts")), "e_id")


@query(f"""{DIM}, {DEG}, bo AS (SELECT e.*, length, a.n_links AS n0, b.n_links AS n1 FROM net_edge e JOIN dim ON dim.e_id = e.e_id JOIN deg a ON a.v_id = v0 JOIN deg b ON b.v_id = v1),
se AS (SELECT e_id, greatest(n0, n1) AS links, row_number() OVER (PARTITION BY CASE WHEN n0 = 1 THEN v1 ELSE v0 END ORDER BY CASE WHEN n0 = 1 THEN v0 ELSE v1 END, e_id) AS k FROM bo WHERE length < 600 AND ((n0 = 1 AND n1 > 2) OR (n1 = 1 AND n0 > 2)))
SELECT e_id FROM se WHERE k <= links - 2 UNION ALL SELECT min(e_id) FROM bo WHERE v0 = v1 AND n0 > 2 GROUP BY v0""")
def superfluous_edges(f):
    return network.superfluous(f.net_edge, network.edge_dimensions(f.net_point), 600)


@query()
def vox_strip(f):
    _, edge, point = network.trace(f.lit, SIZE)
    return network.strip(edge, point, 3.0)[0]


@query(f"""{DIM}, arc AS (SELECT v0 AS a, v1 AS b, CAST(floor(length*10) AS BIGINT) AS w FROM net_edge JOIN dim ON dim.e_id = net_edge.e_id WHERE v0 <> v1 UNION ALL SELECT v1, v0, CAST(floor(length*10) AS BIGINT) FROM net_edge JOIN dim ON dim.e_id = net_edge.e_id WHERE v0 <> v1)
SELECT count(*) AS n_arcs, CAST(sum(w) AS BIGINT) AS w FROM arc""")
def shortest_path_arcs(f):
    w = f.net_edge.where("v0 <> v1").join(network.edge_dimensions(f.net_point).select("e_id", "length"), "e_id").select(F.floor(F.col("length") * 10).cast("long").alias("w"))
    return w.agg((2 * F.count("*")).alias("n_arcs"), (2 * F.sum("w")).alias("w"))


@query()
def shortest_paths(f):
    root = network.degree(f.net_edge).agg(F.max_by("v_id", F.struct("n_links", -F.col("v_id"))).alias("v_id"))
    paths = materialise(network.shortest_paths(f.net_edge, network.edge_dimensions(f.net_point), root), "paths")
    return paths.join(network.branch_counts(paths), "v_id")


@query()
def branch_histogram(f):
    size = materialise(network.edge_dimensions(f.net_point).select("e_id", "length", "mean_diam"), "sizes")
    root = network.degree(f.net_edge).agg(F.max_by("v_id", F.struct("n_links", -F.col("v_id"))).alias("v_id"))
    paths = materialise(network.shortest_paths(f.net_edge, size, root), "paths")
    return network.branch_histogram(network.branch_counts(paths, network.even_vertices(f.net_edge, size, 1.5)))


# --- distances, rasters, slices --------------------------------------------

def tissue_sql(step: float) -> str:
    """The distances of a grid's points over the network's box from the segments whose midpoints lie in the 27 blocks around them."""
    axis = lambda a: f"(SELECT lo + (i + 0.5) * {step} AS {a} FROM (SELECT min({a}) AS lo, unnest(range(CAST(greatest(ceil((max({a}) - min({a})) / {step} - 0.5), 0) AS BIGINT))) AS i FROM net_point) q)"
    return f"""{SEG}, p AS MATERIALIZED (SELECT x, y, z FROM {axis('x')}, {axis('y')}, {axis('z')}),
pn AS (SELECT p.*, floor(x/120) + dx AS cx, floor(y/120) + dy AS cy, floor(z/120) + dz AS cz FROM p, ({offset_sql(cube(1))}) o(dx, dy, dz)),
s AS MATERIALIZED (SELECT px AS ax, py AS ay, pz AS az, x AS bx, y AS by_, z AS bz, pd/2 AS ra, d/2 AS rb, floor((x+px)/2/120) AS cx, floor((y+py)/2/120) AS cy, floor((z+pz)/2/120) AS cz FROM seg),
q AS (SELECT p.x, p.y, p.z, ra, rb, sqrt((p.x-ax)*(p.x-ax)+(p.y-ay)*(p.y-ay)+(p.z-az)*(p.z-az)) AS lw, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az)) AS lv, (p.x-ax)*(bx-ax)+(p.y-ay)*(by_-ay)+(p.z-az)*(bz-az) AS dot, sqrt((p.x-bx)*(p.x-bx)+(p.y-by_)*(p.y-by_)+(p.z-bz)*(p.z-bz)) AS le
FROM pn p JOIN s ON p.cx = s.cx AND p.cy = s.cy AND p.cz = s.cz),
e AS (SELECT x, y, z, CASE WHEN lv = 0 OR lw = 0 THEN 0 ELSE greatest(CASE WHEN dot/lv <= 0 THEN lw - ra WHEN dot/lv >= lv THEN le - rb ELSE sqrt(greatest(lw*lw - (dot/lv)*(dot/lv), 0)) - ((1 - dot/lv/lv)*ra + dot/lv/lv*rb) END, 0) END AS dd FROM q),
td AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, min(dd) AS dist FROM e GROUP BY 1, 2, 3)"""


@query(f"{tissue_sql(50.0)} SELECT round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(dist, 4) AS dist FROM td")
def tissue_distance(f):
    return rounded(distances.vessel_distance(distances.tissue_grid(f.spark, *distances.bounding_box(f.net_point), 50), f.net_point))


@query(f"{tissue_sql(25.0)} SELECT CAST(least(floor(dist / 0.5) + 1, 500) AS BIGINT) AS bin, count(*) AS n FROM td WHERE dist > 0 GROUP BY 1")
def tissue_distance_histogram(f):
    return distances.distance_histogram(distances.vessel_distance(distances.tissue_grid(f.spark, *distances.bounding_box(f.net_point), 25), f.net_point))


@query(f"""{SEG}, m AS (SELECT e_id, seq, (x+px)/2 AS x, (y+py)/2 AS y, (z+pz)/2 AS z FROM seg),
mn AS (SELECT m.*, floor(x/60) + dx AS cx, floor(y/60) + dy AS cy, floor(z/60) + dz AS cz FROM m, ({offset_sql(cube(1))}) o(dx, dy, dz)),
b AS (SELECT x*15.0 AS bx, y*15.0 AS by_, z*30.0 AS bz, floor(x*15.0/60) AS cx, floor(y*15.0/60) AS cy, floor(z*30.0/60) AS cz FROM lit)
SELECT e_id, seq, round(min(sqrt((x-bx)*(x-bx)+(y-by_)*(y-by_)+(z-bz)*(z-bz))), 4) AS dist FROM mn JOIN b ON mn.cx = b.cx AND mn.cy = b.cy AND mn.cz = b.cz GROUP BY 1, 2""")
def lymphatic_distance(f):
    b = f.lit.selectExpr("cast(x * 15 as double) AS x", "cast(y * 15 as double) AS y", "cast(z * 30 as double) AS z")
    return rounded(distances.boundary_distance(f.net_point, b))


@query()
def raster_network(f):
    return distances.rasterise(f.net_point, 2.0)


@query(f"{SEG} SELECT count(*) AS n_crossings, round(coalesce(sum(3.14159*((d+pd)/2)*((d+pd)/2)/4/greatest(abs(z-pz)/sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)), sin(pi()/12))), 0), 3) AS area FROM seg WHERE (pz <= 250 AND 250 < z) OR (z < 250 AND 250 <= pz)")
def slice_crossings(f):
    return rounded(distances.slice_crossings(f.net_point, "z", 250.0), 3)


#: The grid of the tissue in histology queries: voxels, and their sides.
TISSUE, SIDES = tuple(4 * n for n in SIZE), (4.0, 4.0, 8.0)
BLOCK = ((20, 200), (40, 240), (8, 48))
TISSUE_SQL = "ti AS (SELECT 4 * x AS x, 4 * y AS y, 4 * z AS z FROM vox WHERE v >= 100)"


def tissue(f) -> DataFrame:
    return f.vox.where("v >= 100").selectExpr("4 * x AS x", "4 * y AS y", "4 * z AS z")


def slices_sql(axis: str, block=None) -> str:
    """h<axis> (slice, n_vessels, n_vessel_pixels, n_tissue_pixels, tissue_area) by the definition of a section."""
    k, (a, b) = "xyz".index(axis), histology.ACROSS[axis]
    i, j = "xyz".index(a), "xyz".index(b)
    lo, hi = block[k] if block else (1, TISSUE[k])
    (xlo, xhi), (ylo, yhi) = ((block[i], block[j]) if block else ((0, TISSUE[i]), (0, TISSUE[j])))
    near = f"WHERE trunc(x0/{SIDES[i]}) BETWEEN {xlo} AND {xhi} AND trunc(y0/{SIDES[j]}) BETWEEN {ylo} AND {yhi}" if block else ""
    within = " AND ".join(f"{c} BETWEEN {p-1} AND {q-1}" for c, (p, q) in zip("xyz", block, strict=True)) if block else "true"
    away = lambda s: f"sqrt((ix*{SIDES[i]}-(x0{s}f*ux))*(ix*{SIDES[i]}-(x0{s}f*ux)) + (iy*{SIDES[j]}-(y0{s}f*uy))*(iy*{SIDES[j]}-(y0{s}f*uy)))"
    box = lambda n, m, side, p, q: f"unnest(range(CAST(greatest(trunc(({n}0 - (CASE WHEN fl = 0 THEN d/2 + 1 ELSE a*abs(u{n}) + b*abs(u{m}) END))/{side}), {p}) AS BIGINT), CAST(least(trunc(({n}0 + (CASE WHEN fl = 0 THEN d/2 + 1 ELSE a*abs(u{n}) + b*abs(u{m}) END))/{side}), {q}) AS BIGINT))) AS i{n}"
    t = axis
    return f"""c{t} AS (SELECT k AS slice, p{a} AS px, p{b} AS py, p{t} AS pz, {a} AS qx, {b} AS qy, {t} AS qz, (d+pd)/2 AS d FROM seg, range({lo}, {hi}+1) r(k) WHERE (p{t} <= k*{SIDES[k]} AND k*{SIDES[k]} < {t}) OR ({t} < k*{SIDES[k]} AND k*{SIDES[k]} <= p{t})),
o{t} AS (SELECT * FROM (SELECT *, px + (slice*{SIDES[k]}-pz)/(qz-pz)*(qx-px) AS x0, py + (slice*{SIDES[k]}-pz)/(qz-pz)*(qy-py) AS y0 FROM c{t}) q {near}),
g{t} AS (SELECT *, CASE WHEN fl = 0 THEN 0 ELSE (qx-px)/fl END AS ux, CASE WHEN fl = 0 THEN 0 ELSE (qy-py)/fl END AS uy, sqrt(greatest(a*a-b*b, 0)) AS f FROM (SELECT *, sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)) AS fl, d/2/greatest(abs(qz-pz)/sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)+(qz-pz)*(qz-pz)), {histology.LEAST_SINE!r}e0) AS a, d/2 AS b FROM o{t}) q),
i{t} AS (SELECT *, {box('y', 'x', SIDES[j], max(0, ylo), min(TISSUE[j], yhi))} FROM (SELECT *, {box('x', 'y', SIDES[i], max(0, xlo), min(TISSUE[i], xhi))} FROM g{t}) q),
e{t} AS (SELECT slice, count(*) AS n FROM i{t} WHERE CASE WHEN fl = 0 THEN sqrt((ix*{SIDES[i]}-x0)*(ix*{SIDES[i]}-x0) + (iy*{SIDES[j]}-y0)*(iy*{SIDES[j]}-y0)) <= d/2 ELSE {away('+')} + {away('-')} <= 2*a END GROUP BY slice),
h{t} AS (SELECT r.k AS slice, coalesce(v.n, 0) AS n_vessels, coalesce(e.n, 0) AS n_vessel_pixels, coalesce(w.n, 0) AS n_tissue_pixels, coalesce(w.n, 0) * {SIDES[i] * SIDES[j]} AS tissue_area FROM range({lo}, {hi}+1) r(k)
LEFT JOIN (SELECT slice, count(*) AS n FROM o{t} GROUP BY slice) v ON v.slice = r.k LEFT JOIN e{t} e ON e.slice = r.k LEFT JOIN (SELECT {t}+1 AS slice, count(*) AS n FROM ti WHERE {within} GROUP BY 1) w ON w.slice = r.k)"""


@query(f"{SEG}, {TISSUE_SQL}, {', '.join(slices_sql(a) for a in 'xyz')} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, slice, n_vessels, n_vessel_pixels, n_tissue_pixels, CAST(tissue_area AS DOUBLE) AS tissue_area FROM h{a}" for a in "xyz"))
def slice_histology(f):
    return histology.slice_histology(f.net_point, tissue(f), TISSUE, SIDES)


@query(f"{SEG}, {TISSUE_SQL}, {', '.join(slices_sql(a, BLOCK) for a in 'xyz')} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, " + ", ".join(f"CAST(floor(sum({c}) / count(*) + 0.5) AS BIGINT) AS {c}" for c in ("n_vessels", "n_vessel_pixels", "n_tissue_pixels")) + f", round(CAST(sum(tissue_area) AS DOUBLE) / count(*), 4) AS tissue_area FROM h{a}" for a in "xyz"))
def volume_histology(f):
    return rounded(histology.volume_histology(f.net_point, tissue(f), TISSUE, SIDES, block=BLOCK))


def density_sql(diam: str = "true") -> str:
    box = lambda p: " AND ".join(f"{p}{a} >= {lo*s} AND {p}{a} < {hi*s}" for a, (lo, hi), s in zip("xyz", BLOCK, SIDES, strict=True))
    within = " AND ".join(f"{a} BETWEEN {lo-1} AND {hi-1}" for a, (lo, hi) in zip("xyz", BLOCK, strict=True))
    return f"""{SEG}, {TISSUE_SQL}, tv AS (SELECT count(*) AS n FROM ti WHERE {within})
SELECT (SELECT count(*) FROM net_vertex WHERE {box('')}) AS n_branch, (SELECT round(coalesce(sum(sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz))), 0), 2) FROM seg WHERE {box('')} AND {box('p')} AND {diam}) AS length, n AS tissue_voxels, CAST(n * {math.prod(SIDES)} AS DOUBLE) AS tissue_volume FROM tv"""


@query(density_sql("d BETWEEN 3 AND 6 AND pd BETWEEN 3 AND 6"))
def block_density(f):
    return rounded(histology.block_density(f.net_vertex, f.net_point, tissue(f), SIDES, BLOCK, (3, 6)), 2)


@query(density_sql())
def block_branching(f):
    return rounded(histology.block_density(f.net_vertex, f.net_point, tissue(f), SIDES, BLOCK), 2)


@query("""sp AS (SELECT DISTINCT CAST(trunc(x/4.0) AS INT) AS i, CAST(trunc(y/4.0) AS INT) AS j, CAST(trunc(z/4.0) AS INT) AS k, d/2 + 1.0 AS r FROM net_point),
so AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i))
SELECT DISTINCT CAST(i + dx AS INT) AS x, CAST(j + dy AS INT) AS y, CAST(k + dz AS INT) AS z, 255 AS v FROM sp, so WHERE (dx*dx + dy*dy + dz*dz) * 16.0 < r*r AND i + dx >= 0 AND j + dy >= 0 AND k + dz >= 0""")
def raster_spheres(f):
    return distances.rasterise_spheres(f.net_point, (4.0, 4.0, 4.0), 1.0)


@query()
def sprout_intensity(f):
    return rounded(distances.shell_intensity(f.net_point.selectExpr("e_id", "seq", "x", "y", "z / 32 AS z", "d"), f.vox))


@query()
def am_smooth(f):
    return rounded(kernels.decimate(f.net_point, 2.0))


#: Points of which some inner ones have no diameter.
GAPS = "SELECT e_id, seq, x, y, z, CASE WHEN seq > 0 AND d <> 4 AND (e_id + seq) % 3 = 0 THEN 0 ELSE d END AS d FROM net_point"


@query(f"""gp AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY e_id) AS n FROM ({GAPS}) q WINDOW w AS (PARTITION BY e_id ORDER BY seq)),
tp AS (SELECT e_id, arg_min(x, i) AS ax, arg_min(y, i) AS ay, arg_min(z, i) AS az, arg_max(x, i) AS bx, arg_max(y, i) AS by_, arg_max(z, i) AS bz FROM gp GROUP BY e_id),
s1 AS (SELECT gp.* EXCLUDE (d), CASE WHEN i > 0 AND i < n-1 AND (sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)+(z-az)*(z-az)) < 0.3*d OR sqrt((x-bx)*(x-bx)+(y-by_)*(y-by_)+(z-bz)*(z-bz)) < 0.3*d) THEN 0 ELSE d END AS d FROM gp JOIN tp ON tp.e_id = gp.e_id),
gd AS (SELECT e_id, arg_min(d, i) AS d0, arg_max(d, i) AS d1, min(i) AS i0, max(i) AS i1 FROM s1 WHERE i > 0 AND i < n-1 AND d > 0 GROUP BY e_id),
s2 AS (SELECT s1.* EXCLUDE (d), d0, d1, CASE WHEN i > 0 AND i < n-1 AND i < i0 THEN d0 WHEN i > 0 AND i < n-1 AND i > i1 THEN d1 ELSE d END AS d FROM s1 LEFT JOIN gd ON gd.e_id = s1.e_id),
vd AS (SELECT v_id, max(d) AS vd FROM (SELECT v0 AS v_id, greatest(d, coalesce(d0, 0)) AS d FROM s2 JOIN net_edge e ON e.e_id = s2.e_id WHERE i = 0 UNION ALL SELECT v1, greatest(d, coalesce(d1, 0)) FROM s2 JOIN net_edge e ON e.e_id = s2.e_id WHERE i = n-1) q GROUP BY 1),
s3 AS (SELECT s2.* EXCLUDE (d), v0, v1, a.vd AS e0, b.vd AS e1, CASE i WHEN 0 THEN a.vd WHEN n-1 THEN b.vd ELSE d END AS d FROM s2 JOIN net_edge e ON e.e_id = s2.e_id JOIN vd a ON a.v_id = v0 JOIN vd b ON b.v_id = v1),
zz AS (SELECT *, min(CASE WHEN d = 0 THEN i END) OVER (PARTITION BY e_id) - 1 AS z0, max(CASE WHEN d = 0 THEN i END) OVER (PARTITION BY e_id) + 1 AS z1 FROM s3),
s4 AS (SELECT zz.* EXCLUDE (d), CASE WHEN zz.i > zz.z0 AND zz.i < zz.z1 THEN a.d + (b.d - a.d) * (zz.i - zz.z0) / (zz.z1 - zz.z0) ELSE zz.d END AS d FROM zz LEFT JOIN zz a ON a.e_id = zz.e_id AND a.i = zz.z0 LEFT JOIN zz b ON b.e_id = zz.e_id AND b.i = zz.z1),
sg AS (SELECT *, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w)) AS st, lag(d) OVER w AS pd FROM s4 WINDOW w AS (PARTITION BY e_id ORDER BY i)),
un AS (SELECT e_id, sum(st) AS ls, sum(st*(pd*pd+d*d)/2) AS vs, max(CASE WHEN i = 1 THEN st END) AS l0, max(CASE WHEN i = n-1 THEN st END) AS l1 FROM sg GROUP BY e_id),
s5 AS (SELECT s4.* EXCLUDE (d), CASE WHEN i > 0 AND i < n-1 AND n >= 4 AND ls - l0/2 - l1/2 > 0 THEN sqrt(greatest((vs - e0*e0*l0/2 - e1*e1*l1/2) / (ls - l0/2 - l1/2), 0)) ELSE d END AS d FROM s4 JOIN un ON un.e_id = s4.e_id),
mt AS (SELECT v_id, CASE WHEN max(d) > 1.2 * min(d) THEN max(d) ELSE avg(m) END AS vd FROM (SELECT v0 AS v_id, CASE WHEN n > 2 THEN d END AS d, CASE WHEN n > 2 THEN d ELSE (e0+e1)/2 END AS m FROM s5 WHERE i = CASE WHEN n > 2 THEN 1 ELSE 0 END UNION ALL SELECT v1, CASE WHEN n > 2 THEN d END, CASE WHEN n > 2 THEN d ELSE (e0+e1)/2 END FROM s5 WHERE i = CASE WHEN n > 2 THEN n-2 ELSE n-1 END) q GROUP BY 1)
SELECT e_id, seq, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(CASE i WHEN 0 THEN a.vd WHEN n-1 THEN b.vd ELSE d END, 4) AS d FROM s5 JOIN mt a ON a.v_id = v0 JOIN mt b ON b.v_id = v1""")
def fix_diameters(f):
    gaps = f.net_point.selectExpr("e_id", "seq", "x", "y", "z", "CASE WHEN seq > 0 AND d <> 4 AND (e_id + seq) % 3 = 0 THEN 0 ELSE d END AS d")
    return rounded(diameters.fix_diameters(f.net_edge, gaps, max_ratio=1.2))


@query()
def motility_cm(f):
    return rounded(kernels.motility(f.net_edge, f.net_vertex, network.edge_dimensions(f.net_point), 200, 13.0, 0.2, [5.0 * k for k in range(1, 25)]))


# --- rewrites, chains, files -----------------------------------------------

PTS = "pts AS (SELECT p.* FROM net_point p JOIN (SELECT e_id, max(seq) AS last FROM net_point GROUP BY e_id) k ON k.e_id = p.e_id WHERE k.last > 4 OR p.seq = 0 OR p.seq = k.last)"


def mostly_straight(f) -> DataFrame:
    """The points, without the inner ones of edges that have three or fewer."""
    w = f.net_point.groupBy("e_id").agg(F.max("seq").alias("last"))
    return f.net_point.join(w, "e_id").where("last > 4 or seq = 0 or seq = last").drop("last")


@query(f"""{PTS}, {ENDS}, n AS (SELECT e_id, count(*) AS npts FROM pts GROUP BY e_id),
s AS (SELECT e.e_id, least(e.v0, e.v1) AS a, greatest(e.v0, e.v1) AS b, n.npts, sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)+(z0-z1)*(z0-z1)) AS l FROM ends e JOIN n ON n.e_id = e.e_id),
again AS (SELECT DISTINCT s.e_id FROM s JOIN s t ON t.a = s.a AND t.b = s.b AND t.e_id > s.e_id WHERE s.npts = 2),
sh AS (SELECT * FROM s WHERE npts = 2 AND a <> b AND e_id NOT IN (SELECT e_id FROM again)),
lk AS (SELECT v_id, count(*) AS k FROM (SELECT e_id, v0 AS v_id FROM net_edge UNION SELECT e_id, v1 FROM net_edge) q GROUP BY v_id),
tri AS (SELECT x.a AS p, x.b AS q, y.b AS r, x.e_id AS e1, y.e_id AS e2, w.e_id AS e3, x.l AS l1, y.l AS l2, w.l AS l3, kp.k = 2 AS lp, kq.k = 2 AS lq, kr.k = 2 AS lr
FROM sh x JOIN sh y ON y.a = x.a AND x.b < y.b JOIN sh w ON w.a = x.b AND w.b = y.b JOIN lk kp ON kp.v_id = x.a JOIN lk kq ON kq.v_id = x.b JOIN lk kr ON kr.v_id = y.b),
side AS (SELECT p, q, r, e1 AS e, l1 AS l, lp OR lq AS low, lp OR lq OR lr AS corner FROM tri UNION ALL SELECT p, q, r, e2, l2, lp OR lr, lp OR lq OR lr FROM tri UNION ALL SELECT p, q, r, e3, l3, lq OR lr, lp OR lq OR lr FROM tri),
broken AS (SELECT e FROM (SELECT *, row_number() OVER (PARTITION BY p, q, r ORDER BY l DESC, e) AS i FROM side) q WHERE CASE WHEN corner THEN low ELSE i = 1 END)
SELECT e_id FROM net_edge WHERE e_id NOT IN (SELECT e_id FROM again) AND e_id NOT IN (SELECT e FROM broken)""")
def deloop(f):
    return rewrites.deloop(f.net_edge, f.net_vertex, mostly_straight(f))


@query()
def reduce_edges(f):
    vertex, edge, _ = rewrites.reduce_edges(f.net_edge, f.net_vertex, f.net_point, 60.0)
    return rounded(network.endpoints(edge, vertex))


@query()
def join_loose_ends(f):
    return rounded(rewrites.join_loose_ends(f.net_edge, f.net_point))


@query()
def vox_peel(f):
    return chains.peel(f.vox, SIZE, 120, 2, 1, margin=1, least=100)


@query()
def vox_peel2(f):
    return chains.peel(f.vox, SIZE, 120, 2, 1, least=100, one_background=True)


@query()
def vox_fill_probes(f):
    return chains.fill(f.lit, SIZE, 4.0, 9)


@query("SELECT * FROM vox")
def vox_tiff_deflate(f):
    path = put_bytes(f.spark, tiff.tiff_bytes(f.vox, SIZE, "deflate"), "volume.tif")
    return tiff.read_tiff(f.spark, path).drop("file")


@query("SELECT * FROM vox")
def vox_tiff_recompress(f):
    path = put_bytes(f.spark, tiff.tiff_bytes(f.vox, SIZE, "packbits"), "volume.tif")
    again = put_bytes(f.spark, tiff.recompress(f.spark, path, SIZE, "lzw"), "volume.tif")
    return tiff.read_tiff(f.spark, again).drop("file")


@query(f"{BIG}, er AS ({ER}) SELECT x * 15.0e0 AS x, y * 15.0e0 AS y, z * 30.0e0 AS z FROM (SELECT * FROM big EXCEPT SELECT * FROM er) q")
def boundary_list(f):
    path = folder(f.spark) + "/boundary"
    lists.write_boundary(stencils.boundary(stencils.fatten(f.lit, 3, SIZE), SIZE).withColumn("v", F.lit(255)), path)
    return lists.read_boundary(f.spark, path, (15.0, 15.0, 30.0))


@query(f"{FIRSTS}, lp AS (SELECT e_id, max(seq) AS m FROM net_point GROUP BY e_id) SELECT e AS e_id, CASE p.seq WHEN 0 THEN 0 ELSE 1 END AS seq, p.x, p.y, p.z, greatest(p.d, 4.5) AS d FROM kp JOIN net_point p ON p.e_id = kp.e_id JOIN lp ON lp.e_id = p.e_id WHERE p.seq = 0 OR p.seq = m")
def network_text(f):
    path = folder(f.spark) + "/network"
    vertex, edge, point = network.squeeze(f.net_edge, f.net_vertex, f.net_point)
    vertex, edge, point = (materialise(t, "part") for t in (vertex, edge, files.with_diameter(files.ends_only(point), least=4.5)))
    files.write_network(vertex, edge, point, path)
    return files.read_networks(f.spark, path + "/part-*")[2].drop("file")


@query()
def cmgui_elements(f):
    return cmgui.cmgui_lines(f.net_point)[1]
