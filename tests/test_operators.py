"""Shapes with closed-form answers, properties, and brute force for what SQL can't say."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexus.functions.geom import ball, cube
from plexus.operators import distances, kernels, network, points, regions, stencils
from plexus.plans.components import connected_components
from plexus.sources import files

SIZE = (12, 12, 12)


def vox(spark, cells, v=255):
    return spark.createDataFrame([(*map(int, c), v) for c in cells], "x int, y int, z int, v int")


def cells(df):
    return {(r["x"], r["y"], r["z"]) for r in df.collect()}


@pytest.fixture(scope="module")
def blob():
    rng = random.Random(2)
    return {(rng.randrange(1, 11), rng.randrange(1, 11), rng.randrange(1, 11)) for _ in range(300)}


def tube(spark, n=11, d=10.0):
    return spark.createDataFrame([(1, i, 10.0 * i, 0.0, 0.0, d) for i in range(n)], "e_id long, seq long, x double, y double, z double, d double")


def test_straight_tube(spark):
    r = network.edge_dimensions(tube(spark)).first()
    assert r["length"] == pytest.approx(100) and r["volume"] == pytest.approx(3.14159 * 25 * 100) and r["equiv_diam"] == pytest.approx(10)


def test_morphology_is_ordered(spark, blob):
    a = vox(spark, blob)
    eroded, dilated = cells(stencils.erode_ball(a, 1, SIZE)), cells(stencils.dilate_ball(a, 1, SIZE))
    assert eroded <= blob <= dilated
    assert blob <= cells(stencils.close_ball(a, 2, SIZE))
    assert cells(stencils.open_ball(a, 1, SIZE)) <= blob


def test_median_by_brute_force(spark, blob):
    want = {(x, y, z) for x in range(12) for y in range(12) for z in range(12) if 2 * sum((x + a, y + b, z + c) in blob for a, b, c in cube(1)) > 27}
    assert cells(stencils.denoise(vox(spark, blob), 1, SIZE)) == want


def test_invert_twice(spark, blob):
    a = vox(spark, blob, 90)
    twice = points.invert(points.invert(a, *SIZE), *SIZE)
    assert cells(twice) == blob and twice.where("v <> 90").count() == 0


def test_cut_and_join(spark, blob):
    a = vox(spark, blob)
    assert cells(points.join(*points.cut(a, "y", 4), "y", 5)) == blob


def labels_by_search(lit, near):
    left, out = set(lit), []
    while left:
        todo = [left.pop()]
        one = set(todo)
        while todo:
            p = todo.pop()
            for o in near:
                q = tuple(a + b for a, b in zip(p, o, strict=True))
                if q in left:
                    left.remove(q)
                    one.add(q)
                    todo.append(q)
        out.append(one)
    return out


def test_objects_by_brute_force(spark):
    rng = random.Random(4)
    lit = {(rng.randrange(12), rng.randrange(12), rng.randrange(12)) for _ in range(120)}
    want = sorted((len(c) for c in labels_by_search(lit, [o for o in cube(1) if any(o)])), reverse=True)[:5]
    got = [r["n_voxels"] for r in regions.largest_objects(vox(spark, lit), SIZE, 1, 5).collect()]
    assert got == want


def test_hollow_cube_is_filled(spark):
    shell = {c for c in ((x, y, z) for x in range(2, 8) for y in range(2, 8) for z in range(2, 8)) if any(v in (2, 7) for v in c)}
    filled = cells(regions.fill_holes(vox(spark, shell), SIZE))
    assert filled == {(x, y, z) for x in range(2, 8) for y in range(2, 8) for z in range(2, 8)}


def test_distance_transform_by_brute_force(spark):
    lit = {c for c in ball(4)}
    lit = {tuple(v + 5 for v in c) for c in lit}
    got = {(r["x"], r["y"], r["z"]): r["dist"] for r in kernels.distance_transform(vox(spark, lit), SIZE).collect()}
    off = np.array([(x, y, z) for x in range(12) for y in range(12) for z in range(12) if (x, y, z) not in lit])
    for c in lit:
        assert got[c] == pytest.approx(math.sqrt(((off - c) ** 2).sum(axis=1).min()))


def test_skeleton_keeps_objects_and_is_thin(spark):
    bar = {(x, y, z) for x in range(1, 11) for y in (4, 5, 6) for z in (4, 5, 6)}
    thin = cells(kernels.skeleton(vox(spark, bar), SIZE))
    assert thin < bar and len(thin) <= 12 and len(labels_by_search(thin, [o for o in cube(1) if any(o)])) == 1


def test_watershed_splits_between_markers(spark):
    full = spark.createDataFrame([(x, 0, 0, abs(x - 5) * -10 + 100) for x in range(12)], "x int, y int, z int, v int")
    marks = spark.createDataFrame([(0, 0, 0, 1), (11, 0, 0, 2)], "x int, y int, z int, label int")
    got = {r["x"]: r["label"] for r in kernels.watershed(full, marks, (12, 1, 1)).collect()}
    assert len(got) == 12 and got[3] == 1 and got[8] == 2


def test_flood2d_fills_a_ring(spark):
    ring = {(x, y, 3) for x in range(3, 8) for y in range(3, 8) if x in (3, 7) or y in (3, 7)}
    assert cells(kernels.fill_slices(vox(spark, ring), SIZE, 9)) == {(x, y, 3) for x in range(3, 8) for y in range(3, 8)}
    assert cells(kernels.fill_slices(vox(spark, ring), SIZE, 8)) == ring


def test_ray_diameter_of_a_cylinder(spark):
    body = {(x, y, z) for x in range(30) for y in range(30) for z in range(8) if (x - 15) ** 2 + (y - 15) ** 2 <= 64}
    at = spark.createDataFrame([(1, 15, 15, 4, 0.0, 0.0, 1.0)], "id long, x int, y int, z int, tx double, ty double, tz double")
    assert kernels.ray_diameters(at, vox(spark, body), rays=32).first()["diameter"] == pytest.approx(17, abs=1.5)


def test_lowess_keeps_a_line_and_resists_an_outlier():
    x = np.arange(60.0)
    y = 2 * x + 1
    assert kernels.lowess(x, y) == pytest.approx(y)
    y += np.random.default_rng(1).normal(0, 0.5, 60)  # without any noise the median residual is 0, and the rounds end
    y[12] += 100
    assert abs(kernels.lowess(x, y, 2 / 3)[12] - 25) < 1.5


def test_decimation_keeps_ends(spark):
    got = sorted(r["seq"] for r in kernels.decimate(tube(spark, 11, 15.0), 1.0).collect())
    assert got[0] == 0 and got[-1] == 10 and len(got) < 11
    assert kernels.decimate(tube(spark), 0.1).count() == 11


def test_components_of_a_chain_and_odd_links(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (7, None), (900, 901), (901, 900)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and got[500] == 500 and got[900] == got[901] == 900 and len(got) == 204
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shortest_paths_by_brute_force(spark):
    import heapq

    rng = random.Random(6)
    edges = [(i, rng.randrange(40), rng.randrange(40), rng.uniform(1, 30)) for i in range(90)]
    edge = spark.createDataFrame([e[:3] for e in edges], "e_id long, v0 long, v1 long")
    sizes = spark.createDataFrame([(e[0], e[3]) for e in edges], "e_id long, length double")
    near = {}
    for _, a, b, w in edges:
        if a != b:
            near.setdefault(a, []).append((b, int(w * 10)))
            near.setdefault(b, []).append((a, int(w * 10)))
    dist, todo = {0: 0}, [(0, 0)]
    while todo:
        d, v = heapq.heappop(todo)
        for u, w in near.get(v, ()) if d == dist[v] else ():
            if d + w < dist.get(u, 1 << 60):
                dist[u] = d + w
                heapq.heappush(todo, (d + w, u))
    paths = network.shortest_paths(edge, sizes, spark.createDataFrame([(0,)], "v_id long")).cache()
    rows = {r["v_id"]: r for r in paths.collect()}
    assert {v: round(r["distance"] * 10) for v, r in rows.items()} == dist
    steps = {r["v_id"]: r["n_steps"] for r in network.branch_counts(paths).collect()}
    assert all(steps[v] == steps[r["parent"]] + 1 for v, r in rows.items() if r["parent"] is not None) and steps[0] == 0


def test_raster_by_brute_force(spark):
    got = cells(distances.rasterise(tube(spark, 3, 6.5), 1.0))  # a radius that no voxel centre has as its distance
    want = {(x, y, z) for x in range(-4, 26) for y in range(-4, 5) for z in range(-4, 5) if y * y + z * z <= 3.25**2 and (0 <= x <= 20 or min(x * x, (x - 20) ** 2) + y * y + z * z <= 3.25**2)}
    assert got == want


def test_motility_grows_with_time(spark):
    edge = spark.createDataFrame([(i, i, i + 1) for i in range(200)], "e_id long, v0 long, v1 long")
    vertex = spark.createDataFrame([(i, 10.0 * i, 0.0, 0.0) for i in range(201)], "v_id long, x double, y double, z double")
    sizes = spark.createDataFrame([(i, 10.0) for i in range(200)], "e_id long, length double")
    got = kernels.motility(edge, vertex, sizes, 100, 5.0, 0.0, [2.0, 4.0]).orderBy("t").collect()
    assert got[0]["d2"] == pytest.approx(100, rel=0.1) and got[1]["d2"] == pytest.approx(400, rel=0.1)


def test_motility_on_a_network_of_more_than_two_million_edges(spark):
    n = 2_000_001
    edge = spark.range(n).selectExpr("id AS e_id", "id AS v0", "id + 1 AS v1")
    vertex = spark.range(n + 1).selectExpr("id AS v_id", "10.0D * id AS x", "0D AS y", "0D AS z")
    got = kernels.motility(edge, vertex, spark.range(n).selectExpr("id AS e_id", "10D AS length"), 20, 5.0, 0.0, [1.0, 2.0]).orderBy("t").collect()
    assert [r["d2"] for r in got] == pytest.approx([25, 100])


def test_fibres_are_picked_by_their_share_of_all_lengths(spark):
    rng = random.Random(5)
    rows = sorted((rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 9)), e) for e in range(300))
    fibre = spark.createDataFrame(rows, "v0 long, v1 long, length double, e_id long")
    draws = [0.0, 0.5, 1 - 2**-53, *(rng.random() for _ in range(50))]
    got = kernels.picked_fibres(fibre, spark.createDataFrame(list(enumerate(draws)), "trial long, u double"), block=7)
    cum = np.cumsum([r[2] for r in rows])
    assert {r["trial"]: r["e_id"] for r in got.collect()} == {i: rows[np.searchsorted(cum, u * cum[-1])][3] for i, u in enumerate(draws)}


def test_mean_diameter_on_the_limit_is_in_whatever_the_order(spark):
    ways = list(itertools.permutations([4.0, 4.3, 5.3, 6.0, 6.4, 4.0]))
    rows = [(e, i, d) for e, ds in enumerate(ways) for i, d in enumerate(ds)]
    over = [(len(ways), i, d) for i, d in enumerate([5.0, 5.0, 5.000001])]
    point = spark.createDataFrame(rows + over, "e_id long, seq int, d double").coalesce(1)
    assert {r["e_id"] for r in network.select_diameter(point, 3, 5).collect()} == set(range(len(ways)))


def test_dead_ends_heal_without_looking_at_all_in_reach(spark):
    """20,000 loose edges, of which all ends are in reach of each other: 40,000 times 40,000 pairs, were all looked at."""
    rng = np.random.default_rng(4)
    p = np.round(rng.normal(0, 100, (40_000, 3)), 1)
    p[100:140] = p[60:100]  # places of several vertices
    p[140:180] = p[60:100]
    p[-1] = (2e3, 2e3, 2e3)
    vertex = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "v_id long, x double, y double, z double")
    edge = spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(20_000)], "e_id long, v0 long, v1 long")
    began = time.time()
    got = {r["v_id"]: (r["target"], r["score"]) for r in network.heal(edge, vertex, 4e3).collect()}
    assert time.time() - began < 120
    for v in [*range(60, 180), *rng.integers(0, 40_000, 100), 39_998, 39_999]:
        way, g = p - p[v], p[v] - p[v ^ 1]
        d = np.linalg.norm(way, axis=1)
        ok = (d > 0) & (np.arange(len(p)) != v ^ 1)
        score = np.where(ok, (0.5 + way @ g / np.maximum(d, 1e-300) / np.linalg.norm(g)) / np.maximum(d, 1e-300), -1)
        if score.max() <= 0:
            assert v not in got
        else:
            assert got[v][1] == pytest.approx(score.max(), rel=1e-9) and score[got[v][0]] == pytest.approx(score.max(), rel=1e-9)
            assert got[v][0] == min(np.flatnonzero((p == p[got[v][0]]).all(axis=1) & ok))


def test_network_text_round_trip(spark, tmp_path):
    vertex = spark.createDataFrame([(7, 0.0, 0.0, 0.0), (9, 20.0, 0.0, 0.0)], "v_id long, x double, y double, z double")
    edge = spark.createDataFrame([(1, 7, 9)], "e_id long, v0 long, v1 long")
    files.write_network(vertex, edge, tube(spark, 3), str(tmp_path / "n"))
    v, e, p = files.read_networks(spark, str(tmp_path / "n" / "part-*"))
    assert [tuple(r)[1:] for r in e.collect()] == [(0, 0, 1)]
    assert sorted(tuple(r)[2:] for r in v.collect()) == [(0.0, 0.0, 0.0), (20.0, 0.0, 0.0)]
    assert sorted(tuple(r)[1:] for r in p.collect()) == [(0, i, 10.0 * i, 0.0, 0.0, 10.0) for i in range(3)]


def test_networks_are_read_in_splits(spark, tmp_path):
    rng, want, conf = np.random.default_rng(6), {"vertex": [], "edge": [], "point": []}, {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.enabled": "false"}
    for name, ne, long in (("a.am", 4_000, 25_000), ("b.am", 3, 2)):
        n = rng.integers(0, 4, ne)  # edges without points too
        n[ne // 2] = long
        vertex, edge, xyz, d = rng.integers(0, 99, (2 * ne, 3)) / 2, rng.integers(0, 2 * ne, (ne, 2)), rng.integers(0, 999, (n.sum(), 3)) / 10, rng.integers(1, 99, n.sum()) / 4
        numbers = xyz.ravel().tolist()
        lines = [" ".join(map(str, numbers[i : i + 7])) for i in range(0, len(numbers), 7)]  # lines that don't end where points do
        parts = ["# of 3 parts\n1 2 3\ndefine VERTEX 9", "VERTEX { float[3] C } @1", "@3", *map(str, n), "@7", "1 2 3", "@1", *(" ".join(map(str, v)) for v in vertex), "end 4 5 6", "7 8", "", "@5\r", *(f"{v:6.2f}\t" for v in d), "@4", *lines, "@2", "9 9", "@2 ", *(f"{a} {b}" for a, b in edge), ""]
        (tmp_path / name).write_text("\n".join(parts))
        e = np.repeat(np.arange(ne), n)
        seq = np.concatenate([np.arange(k) for k in n])
        want["vertex"] += [(name, i, *v) for i, v in enumerate(vertex.tolist())]
        want["edge"] += [(name, i, *v) for i, v in enumerate(edge.tolist())]
        want["point"] += [(name, *r) for r in zip(e.tolist(), seq.tolist(), *xyz.T.tolist(), d.tolist(), strict=True)]
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = dict(zip(want, files.read_networks(spark, str(tmp_path / "*.am")), strict=True))
        for kind, t in got.items():
            assert sorted((r[0].rsplit("/", 1)[1], *r[1:]) for r in t.collect()) == sorted(want[kind])
        big = got["point"].where(F.col("file").endswith("a.am")).select(F.spark_partition_id().alias("k"))
        assert big.distinct().count() > 1  # no task has the whole of a file
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_networks_cut_short_are_errors(spark, tmp_path):
    (tmp_path / "n.am").write_text("define EDGE 1\n@1\n0 0 0\n1 1 1\n@2\n0 1\n@3\n2\n@4\n0 0 0\n1 1 1\n@5\n3\n")
    vertex, edge, point = files.read_networks(spark, str(tmp_path / "n.am"))
    assert vertex.count() == 2 and [tuple(r)[1:] for r in edge.collect()] == [(0, 0, 1)]
    with pytest.raises(Exception, match="point table"):
        point.collect()
    (tmp_path / "o.am").write_text("")
    with pytest.raises(Exception, match="vertex table"):
        files.read_networks(spark, str(tmp_path / "*.am"))[0].collect()


def test_bits_round_trip(spark, tmp_path, blob):
    (tmp_path / "v.bin").write_bytes(files.pack_bits(vox(spark, blob), SIZE))
    assert cells(files.read_bits(spark, str(tmp_path / "v.bin"))) == blob


def test_rays_go_on_until_unlit(spark):
    body = {(x, y, z) for x in range(56) for y in range(56) for z in range(2) if (x - 27) ** 2 + (y - 27) ** 2 <= 25**2}
    at = spark.createDataFrame([(1, 27, 27, 1, 0.0, 0.0, 1.0), (2, 27, 5, 0, 0.0, 0.0, 1.0), (3, 0, 0, 0, 1.0, 0.0, 0.0)], "id long, x int, y int, z int, tx double, ty double, tz double")
    got = {r["id"]: r["diameter"] for r in kernels.ray_diameters(at, vox(spark, body)).collect()}
    want = {}
    for i, x, y in ((1, 27, 27), (2, 27, 5)):
        s2 = []
        for k in range(32):
            u, w, s = np.cross([0, 0, 1.0], [1.0, 0, 0]), np.cross([0, 0, 1.0], np.cross([0, 0, 1.0], [1.0, 0, 0])), 0
            d = np.cos(2 * np.pi * k / 32) * u + np.sin(2 * np.pi * k / 32) * w
            while tuple(int(c) for c in np.floor(np.array([x, y, 0]) + d * s / 10 + 0.5)) in body:
                s += 1
            s2.append(s * s / 100)
        want[i] = 2 * math.sqrt(sum(s2) / 32)
    assert got == pytest.approx(want | {3: 0.0}) and got[1] == pytest.approx(51, abs=1.5)


def test_equalise_brings_slices_to_the_curve(spark):
    rng = random.Random(3)
    rows = [(x, y, z, rng.randrange(1, 120 + 20 * (z % 3))) for x in range(12) for y in range(12) for z in range(9) if z != 4]
    v = spark.createDataFrame(rows, "x int, y int, z int, v int")
    gains = {r["z"]: r for r in kernels.slice_gains(v, 20, 10).collect()}
    raw = [float(sum(r[3] for r in rows if r[2] == z and r[3] > 20)) for z in range(10)]
    smooth = kernels.lowess(np.arange(10.0), np.array(raw))
    assert [gains[z]["raw"] for z in range(10)] == raw and [gains[z]["smooth"] for z in range(10)] == pytest.approx(list(smooth))
    assert gains[4]["gain"] == gains[9]["gain"] == 1

    def off(z, a):
        return sum(w for w in (int(a * r[3] + 0.5) for r in rows if r[2] == z) if w > 20) - smooth[z]

    for z in range(9):
        assert raw[z] == 0 or smooth[z] <= 0 or off(z, gains[z]["gain"] - 0.01) <= 0 <= off(z, gains[z]["gain"] + 0.01)
    want = set()
    for x, y, z, k in rows:
        w = min(int(gains[z]["gain"] * k + 0.5), 255)
        want.add((x, y, z, w if w > 20 else k))
    assert {tuple(r) for r in kernels.equalise(v, 20, 10).collect()} == want


def test_shell_intensity_takes_all_points(spark):
    rng = random.Random(4)
    v = {(x, y, z): rng.randrange(1, 250) for x in range(8) for y in range(8) for z in range(8) if rng.random() < 0.3}
    pts = [(e, q, rng.uniform(-4, 14), rng.uniform(-4, 14), rng.uniform(0, 8), rng.uniform(1, 9)) for e in range(5) for q in range(6)] + [(9, 0, 500.0, 0.0, 0.0, 3.0)]
    got = {r["e_id"]: r["intensity"] for r in distances.shell_intensity(spark.createDataFrame(pts, "e_id long, seq long, x double, y double, z double, d double"), spark.createDataFrame([(*k, n) for k, n in v.items()], "x int, y int, z int, v int")).collect()}
    best = {(e, q): max((n for k, n in v.items() if 0.5 * d / 2 <= math.dist(k, (x, y, z)) <= 1.5 * d / 2), default=0) for e, q, x, y, z, d in pts}
    assert got == pytest.approx({e: np.mean([m for (f, _), m in best.items() if f == e]) for e in {p[0] for p in pts}})


SF = "/root/testdata/sf0.001"


def test_skeleton_query_thins_the_whole_volume(spark):
    from plexus.fixtures import SIZE as size
    from plexus.fixtures import Fixtures
    from plexus.queries import QUERIES

    whole, thin = cells(stencils.fatten(Fixtures(spark, SF).lit, 3, size)), cells(QUERIES["vox_skeleton"](spark, SF))
    near = [o for o in cube(1) if any(o)]
    assert thin < whole and len(labels_by_search(thin, near)) == len(labels_by_search(whole, near)) and max(c[0] for c in thin) > 32


def test_ray_query_casts_from_every_lit_voxel(spark):
    from plexus.fixtures import Fixtures
    from plexus.queries import QUERIES

    assert QUERIES["vox_ray_diameter"](spark, SF).count() == Fixtures(spark, SF).lit.count()


def test_sprout_and_tissue_queries_take_the_whole_network(spark):
    from plexus.fixtures import Fixtures
    from plexus.queries import QUERIES

    p = Fixtures(spark, SF).net_point
    assert QUERIES["sprout_intensity"](spark, SF).count() == p.select("e_id").distinct().count()
    lo, hi = distances.bounding_box(p)
    cells_of = [math.ceil((b - a) / 25 - 0.5) for a, b in zip(lo, hi, strict=True)]
    assert 12**3 < QUERIES["tissue_distance_histogram"](spark, SF).agg({"n": "sum"}).first()[0] <= math.prod(cells_of)


def test_queries_without_sql_see_all_orders(spark):
    from plexus.fixtures import Fixtures
    from plexus.queries import QUERIES

    f = Fixtures(spark, SF)
    orders, items = f.orders.count(), f.lineitem.join(f.orders, f.lineitem["l_orderkey"] == f.orders["o_orderkey"], "left_semi").count()
    assert f.net_edge.count() == orders and f.net_point.count() == 2 * orders + items
    assert QUERIES["am_smooth"](spark, SF).select("e_id").distinct().count() == orders


def test_raster_of_oblique_tubes_by_brute_force(spark):
    rng, rows = random.Random(8), []
    for e in range(12):
        a = [rng.uniform(4, 16) for _ in range(3)]
        b = a if e == 0 else [v + rng.uniform(-9, 9) * (i != e % 3 or e > 6) for i, v in enumerate(a)]
        rows += [(e, 0, *a, rng.uniform(0.5, 5)), (e, 1, *b, rng.uniform(0.5, 5))]
    got = cells(distances.rasterise(spark.createDataFrame(rows, "e_id long, seq long, x double, y double, z double, d double"), 0.75))
    n = np.arange(-20, 60) * 0.75
    at = np.stack(np.meshgrid(n, n, n, indexing="ij"), axis=-1)
    hit = np.zeros(at.shape[:3], dtype=bool)
    for p, q in zip(rows[::2], rows[1::2], strict=True):
        a, b, ra, rb = np.array(p[2:5]), np.array(q[2:5]), p[5] / 2, q[5] / 2
        w, axis = at - a, b - a
        hit |= ((w**2).sum(-1) <= ra**2) | (((at - b) ** 2).sum(-1) <= rb**2)
        if axis.any():
            t = (w @ axis) / (axis @ axis)
            off = (w**2).sum(-1) - t * t * (axis @ axis)
            hit |= (t >= 0) & (t <= 1) & (off <= ((1 - t) * ra + t * rb) ** 2)
    assert got == {tuple((i - 20).tolist()) for i in np.argwhere(hit)}


def test_chains_of_the_fixture_shapes(spark):
    """A Y junction with a divided arm, a ring, a figure of two rings at one vertex, a theta, and a loop."""
    edges = {1: (10, 11), 2: (12, 11), 3: (12, 13), 4: (10, 14), 5: (10, 15), 6: (20, 21), 7: (21, 22), 8: (22, 20), 9: (30, 31), 10: (31, 30), 11: (30, 32), 12: (33, 32), 13: (30, 33), 14: (40, 41), 15: (41, 40), 16: (40, 42), 17: (42, 41), 18: (50, 50)}
    place = lambda v: (float(v), float(v * v % 7), float(v % 3))
    points = []
    for e, (a, b) in edges.items():
        points += [(e, 0, *place(a), 1.0), (e, 1, float(e), -1.0, -1.0, 2.0), (e, 2, *place(b), 1.0)]
    e = spark.createDataFrame([(k, *v) for k, v in edges.items()], "e_id long, v0 long, v1 long")
    p = spark.createDataFrame(points, "e_id long, seq long, x double, y double, z double, d double")
    edge, point = network.join_chains(e, p)
    got = {r["e_id"]: (r["v0"], r["v1"]) for r in edge.collect()}
    assert got == {1: (10, 13), 4: (10, 14), 5: (10, 15), 6: (20, 20), 9: (30, 30), 11: (30, 30), 14: (40, 41), 15: (40, 41), 16: (40, 41), 18: (50, 50)}
    rows = {}
    for r in sorted(point.collect(), key=lambda r: (r["e_id"], r["seq"])):
        rows.setdefault(r["e_id"], []).append((r["x"], r["y"], r["z"]))
    mid = lambda e: (float(e), -1.0, -1.0)
    assert rows[1] == [place(10), mid(1), place(11), mid(2), place(12), mid(3), place(13)]
    assert rows[6] == [place(20), mid(6), place(21), mid(7), place(22), mid(8), place(20)]
    assert rows[15] == [place(40), mid(15), place(41)]
    assert rows[11][0] == rows[11][-1] == place(30) and len(rows[11]) == 7
    assert network.join_chains(e.limit(0), p.limit(0))[0].count() == 0


def test_trace_of_a_skeleton(spark):
    """Three arms from one voxel."""
    lit = {(5, 5, 5), *((5 + i, 5, 5) for i in range(2, 5)), *((5 - i, 5 + i, 5) for i in range(2, 5)), *((5 - i, 5 - i, 5) for i in range(2, 5)), (6, 5, 5), (4, 6, 5), (4, 4, 5)}
    vertex, edge, point = network.trace(vox(spark, lit), SIZE, (2.0, 2.0, 2.0))
    assert vertex.count() == len(lit) and edge.count() == 3
    assert sorted(r["count"] for r in point.groupBy("e_id").count().collect()) == [5, 5, 5]


def test_parabolic_passes_by_brute_force(spark):
    from plexus.operators import parabolic

    rng, size = np.random.default_rng(4), (6, 5, 4)
    v = rng.integers(0, 50, size).astype(float)
    at = np.argwhere(np.ones(size))
    t = spark.createDataFrame([(*map(int, c), float(v[tuple(c)])) for c in at], "x int, y int, z int, v double")
    back = lambda df, c="v": np.array([r[c] for r in sorted(df.collect(), key=lambda r: (r["x"], r["y"], r["z"]))]).reshape(size)
    d2 = lambda s: (((at[:, None, :] - at[None, :, :]) * np.array(s)) ** 2).sum(-1)
    low = lambda a, k, s=(1, 1, 1): (a.reshape(-1)[None, :] + k * d2(s)).min(1).reshape(size)
    assert back(parabolic.parabolic(t, 0.1)) == pytest.approx(low(v, 5))
    assert back(parabolic.parabolic(t, 0.1, dilate=True, spacing=(1, 2, 3))) == pytest.approx(-low(-v, 5, (1, 2, 3)))
    assert back(parabolic.opened(t, 0.1)) == pytest.approx(-low(-low(v, 5), 5)) and back(parabolic.closed(t, 0.1)) == pytest.approx(low(-low(-v, 5), 5))
    up, down = -low(-v, 5) - v, v - low(v, 5)
    assert back(parabolic.sharpened(t, 0.1)) == pytest.approx(np.where(up < down, v + up, np.where(down < up, v - down, v)))
    lit = v > 20
    dist = np.sqrt(np.where(d2((1, 1, 2)).reshape(*size, -1) * 0 + lit.reshape(-1)[None, None, None, :] != lit[..., None], d2((1, 1, 2)).reshape(*size, -1), 1e9).min(-1))
    assert back(parabolic.signed_distance(t.where("v > 20"), size, (1, 1, 2)), "dist") == pytest.approx(np.where(lit, dist, -dist))
    near = d2((1, 1, 1)).reshape(*size, -1)
    reached = lambda mask: (np.where(mask.reshape(-1)[None, None, None, :], near, 99) < 6).any(-1)
    assert cells(parabolic.binary(t.where("v > 40"), size, 2, True)) == {tuple(c.tolist()) for c in np.argwhere(reached(v > 40))}
    assert cells(parabolic.binary(t.where("v > 3"), size, 2, False)) == {tuple(c.tolist()) for c in np.argwhere(~reached(v <= 3))}


def test_lines_in_bundles_are_the_same(spark):
    from plexus.operators import parabolic

    t = vox(spark, {(x, y, z) for x in range(9) for y in range(9) for z in range(5) if (x * 7 + y * 3 + z) % 5}).withColumn("v", ((F.col("x") * 31 + F.col("y") * 17) % 23).cast("double"))
    a, b = (sorted(tuple(r) for r in parabolic.pass_along(t, "x", {"v": 0.5}, n).collect()) for n in (2, 1000))
    assert a == b


def test_joints_turn_least():
    """No other point of the halving plane, near or far, turns less; a straight way goes through the middle."""
    from plexus.operators import rewrites

    rng = np.random.default_rng(9)
    p0, p1 = rng.uniform(-5, 5, (20, 3)), rng.uniform(-5, 5, (20, 3))
    gap = p1 - p0
    e0, e1 = gap + rng.normal(0, 2, (20, 3)), -gap + rng.normal(0, 2, (20, 3))
    e0[0], e1[0] = gap[0], -gap[0]
    p = rewrites.joints(p0, p1, e0, e1)
    assert p[0] == pytest.approx((p0[0] + p1[0]) / 2, abs=1e-6)
    assert np.linalg.norm(p - p0, axis=1) == pytest.approx(np.linalg.norm(p - p1, axis=1))
    best = rewrites.turning(e0, e1, p0, p1, p)
    for _ in range(300):
        q = rng.normal(0, 1, (20, 3)) * np.linalg.norm(gap, axis=1)[:, None] * rng.choice([1e-3, 0.05, 0.4])
        q = p + q - (q * gap).sum(1, keepdims=True) / (gap**2).sum(1, keepdims=True) * gap
        ok = np.linalg.norm(q - p0, axis=1) <= rewrites.STRETCH / 2 * np.linalg.norm(gap, axis=1)
        assert (rewrites.turning(e0, e1, p0, p1, q)[ok] >= best[ok] - 1e-7).all()


def test_streamed_sums_equal_plain_ones(spark):
    from plexus.streaming import slices

    t = vox(spark, {(x, y, z) for x in range(5) for y in range(5) for z in range(4)}).withColumn("v", F.col("x") * 10).repartition(5)
    assert cells_of_sums(slices.streamed_sums(spark, t, 15)) == cells_of_sums(slices.slice_sums(t, 15))


def cells_of_sums(df):
    return sorted((r["z"], r["raw"], r["n"]) for r in df.collect())


def test_shortest_paths_over_arcs_without_length(spark):
    """A ring of arcs without length behind a long one: parents lead to the root, by the fewest arcs."""
    e = spark.createDataFrame([(1, 0, 5), (2, 5, 3), (3, 3, 4), (4, 4, 5), (5, 3, 2)], "e_id long, v0 long, v1 long")
    size = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.05)], "e_id long, length double")
    paths = network.shortest_paths(e, size, spark.createDataFrame([(0,)], "v_id long"))
    assert {r["v_id"]: (r["distance"], r["parent"]) for r in paths.collect()} == {0: (0.0, None), 5: (2.0, 0), 3: (2.0, 5), 4: (2.0, 5), 2: (2.0, 3)}
    assert {r["v_id"]: r["n_steps"] for r in network.branch_counts(paths).collect()} == {0: 0, 5: 1, 3: 2, 4: 2, 2: 3}
