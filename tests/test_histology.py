"""Planes through networks, ids from 0, jump points and branch counts on shapes whose results are known."""

import math
import random
import time

import numpy as np
import pytest

from plexus.operators import distances, histology, network

POINT = "e_id long, seq long, x double, y double, z double, d double"
VERTEX = "v_id long, x double, y double, z double"
EDGE = "e_id long, v0 long, v1 long"
CLOSE = "x int, y int, z int"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_a_straight_vessel_shows_as_a_disc(spark):
    point = spark.createDataFrame([(1, 0, 50.0, 50.0, 5.0, 20.0), (1, 1, 50.0, 50.0, 25.0, 20.0)], POINT)
    close = spark.createDataFrame([(x, y, 9) for x in range(4) for y in range(5)], CLOSE)
    got = {(r["axis"], r["slice"]): r for r in histology.slice_histology(point, close, (100, 100, 30), (1.0, 1.0, 1.0)).collect()}
    assert len(got) == 230
    disc = sum((x - 50) ** 2 + (y - 50) ** 2 <= 100 for x in range(100) for y in range(100))
    for k in range(1, 31):
        r = got["z", k]
        # Half-open: the plane at the first end counts, that at the last doesn't.
        assert (r["n_vessels"], r["n_vessel_pixels"]) == ((1, disc) if 5 <= k < 25 else (0, 0))
        assert (r["n_tissue_pixels"], r["tissue_area"]) == ((20, 20.0) if k == 10 else (0, 0.0))
    assert sum(got["x", k]["n_vessels"] for k in range(1, 101)) == 0


def test_slices_by_brute_force_with_a_block(spark):
    rnd = random.Random(5)
    data = [(e, s, *(round(rnd.uniform(-5, 65), 2) for _ in "xyz"), rnd.uniform(2, 14)) for e in range(25) for s in range(3)]
    close = {(rnd.randrange(20), rnd.randrange(20), rnd.randrange(20)) for _ in range(900)}
    voxel, block = (3.0, 2.0, 4.0), ((2, 15), (3, 24), (1, 14))
    got = rows(histology.slice_histology(spark.createDataFrame(data, POINT), spark.createDataFrame(sorted(close), CLOSE), (20, 30, 15), voxel, "xyz", block), "axis", "slice")
    want = []
    for k, axis in enumerate("xyz"):
        i, j = ("xyz".index(a) for a in histology.ACROSS[axis])
        for n in range(block[k][0], block[k][1] + 1):
            vessels = pixels = 0
            for p, q in ((data[m], data[m + 1]) for m in range(len(data) - 1) if data[m][0] == data[m + 1][0]):
                (a, b), at, d = (p[2:5], q[2:5]), n * voxel[k], (p[5] + q[5]) / 2
                if not (a[k] <= at < b[k] or b[k] < at <= a[k]):
                    continue
                t = (at - a[k]) / (b[k] - a[k])
                u0, v0 = (a[c] + t * (b[c] - a[c]) for c in (i, j))
                if not all(block[c][0] <= int(w / voxel[c]) <= block[c][1] for c, w in ((i, u0), (j, v0))):
                    continue
                vessels += 1
                du, dv = b[i] - a[i], b[j] - a[j]
                flat = math.hypot(du, dv)
                du, dv = du / flat, dv / flat
                major = d / 2 / max(abs(b[k] - a[k]) / math.dist(a, b), math.sin(math.pi / 12))
                focus = math.sqrt(major**2 - d * d / 4)
                span = []
                for c, w, along, beside in ((i, u0, du, dv), (j, v0, dv, du)):
                    half = major * abs(along) + d / 2 * abs(beside)
                    span.append(range(max(int((w - half) / voxel[c]), block[c][0]), min(int((w + half) / voxel[c]), block[c][1], (20, 30, 15)[c])))
                for x in span[0]:
                    for y in span[1]:
                        o = (x * voxel[i], y * voxel[j])
                        far = sum(math.dist(o, (u0 + s * focus * du, v0 + s * focus * dv)) for s in (1, -1))
                        pixels += far <= 2 * major
            tissue = sum(c[k] == n - 1 and all(block[m][0] - 1 <= c[m] <= block[m][1] - 1 for m in range(3)) for c in close)
            want.append((axis, n, vessels, pixels, tissue, tissue * voxel[i] * voxel[j]))
    assert got == want and sum(w[3] for w in want) > 50


def test_tables_without_rows(spark):
    point, close, vertex, edge = (spark.createDataFrame([], s) for s in (POINT, CLOSE, VERTEX, EDGE))
    got = rows(histology.volume_histology(point, close, (3, 3, 3), (1.0, 1.0, 1.0)), "axis")
    assert got == [(a, 0, 0, 0, 0.0) for a in "xyz"]
    assert rows(histology.block_density(vertex, point, close, (1, 1, 1), ((1, 2),) * 3)) == [(0, 0.0, 0, 0.0)]
    assert rows(network.check_network(edge, vertex, point)) == [(0, 0, 0, 0)]
    assert distances.rasterise_spheres(point, (1, 1, 1)).count() == 0
    assert network.jump_points(edge, point, 10).count() == 0
    assert [t.count() for t in network.squeeze(edge, vertex, point)] == [0, 0, 0]


def test_ids_from_zero_whatever_the_gaps(spark):
    rnd = random.Random(3)
    keys = sorted(rnd.sample(range(-5_000, 100_000), 500))
    got = rows(network.dense_ids(spark.createDataFrame([(k,) for k in keys], "k long"), "k", "n", block=1000), "k")
    assert got == [(k, i) for i, k in enumerate(keys)]


def test_squeeze_drops_loops_and_names_vertices_as_they_come(spark):
    vertex = spark.createDataFrame([(v, float(v), 0.0, 0.0) for v in (3, 7, 9, 11, 20)], VERTEX)
    edge = spark.createDataFrame([(5, 9, 3), (6, 7, 7), (8, 3, 11)], EDGE)
    point = spark.createDataFrame([(e, s, 0.0, 0.0, 0.0, 1.0) for e in (5, 6, 8) for s in (0, 1)], POINT)
    v, e, p = network.squeeze(edge, vertex, point)
    assert rows(e, "e_id") == [(0, 0, 1), (1, 1, 2)]
    assert [(r[0], r[1]) for r in rows(v, "v_id")] == [(0, 9.0), (1, 3.0), (2, 11.0)]
    assert [r[0] for r in rows(p, "e_id", "seq")] == [0, 0, 1, 1]


def test_check_network_counts_each_fault(spark):
    vertex = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], VERTEX)
    edge = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 1, 1)], EDGE)
    ends = {1: (0.0, 1.0), 2: (1.0, 0.5), 3: (0.0, 0.0)}
    point = spark.createDataFrame([(e, s, x, 0.0, 0.0, 1.0) for e, xs in ends.items() for s, x in enumerate(xs)], POINT)
    assert rows(network.check_network(edge, vertex, point)) == [(3, 1, 1, 1)]


def test_branch_counts_leave_uneven_vertices_out(spark):
    """A chain 1 - 2 - 3 - 4 from the root 1; the vessels at 3 are unlike, so the step from 3 isn't counted."""
    edge = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4)], EDGE)
    sizes = spark.createDataFrame([(1, 10.0, 5.0), (2, 10.0, 5.0), (3, 10.0, 20.0)], "e_id long, length double, mean_diam double")
    paths = network.shortest_paths(edge, sizes, spark.createDataFrame([(1,)], "v_id long"))
    assert rows(network.branch_counts(paths), "v_id") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    counts = network.branch_counts(paths, network.even_vertices(edge, sizes, 1.5))
    assert rows(counts, "v_id") == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(network.branch_histogram(counts, 1), "n_steps") == [(0, 1), (1, 3)]
    assert rows(network.edges_of_paths(edge, counts, paths), "e_id") == [(1, 0, 0.0), (2, 1, 10.0), (3, 1, 20.0)]


def test_jump_points_never_lead_to_a_joined_edge(spark):
    point = [(1, 0, 0.0, 0, 0), (1, 1, 5.0, 0, 0), (1, 2, 9.0, 0, 0), (2, 0, 9.0, 0, 0), (2, 1, 5.0, 1, 0), (2, 2, 2.0, 5, 0), (3, 0, 1.0, 9, 0), (3, 1, 5.0, 3, 0), (3, 2, 9.0, 9, 0)]
    point = spark.createDataFrame([(e, s, float(x), float(y), float(z), 1.0) for e, s, x, y, z in point], POINT)
    edge = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 4, 5)], EDGE)
    assert rows(network.jump_points(edge, point, 10), "e_id") == [(1, 1, 3, 1, 3.0), (2, 1, 3, 1, 2.0), (3, 1, 2, 1, 2.0)]


def test_jump_points_without_all_pairs_of_a_cell(spark):
    """30,000 points in one cell: 10,000 inner ones, which met all others."""
    rng = np.random.default_rng(6)
    n = 10_000
    p = np.round(rng.normal(50, 4, (n, 3, 3)), 2).clip(0, 99)
    point = spark.createDataFrame([(e, s, *map(float, p[e, s]), 1.0) for e in range(n) for s in range(3)], POINT)
    edge = spark.createDataFrame([(e, e, (e + 1) % n) for e in range(n)], EDGE)
    began = time.time()
    got = {r["e_id"]: tuple(r) for r in network.jump_points(edge, point, 100).collect()}
    assert time.time() - began < 60
    flat, own = p.reshape(-1, 3), np.repeat(np.arange(n), 3)
    for e in range(0, n, 40):
        d2 = ((flat - p[e, 1]) ** 2).sum(axis=1)
        d2[np.isin(own, [e, (e + 1) % n, (e - 1) % n])] = np.inf
        if d2.min() == 0:
            assert e not in got
        else:
            assert got[e][4] == pytest.approx(math.sqrt(d2.min())) and d2[3 * got[e][2] + got[e][3]] == pytest.approx(d2.min())


@pytest.mark.parametrize("margin", [0.0, 1.5])
def test_spheres_by_brute_force(spark, margin):
    data = [(1, 0, 3.2, 8.9, 4.0, 5.0), (1, 1, -0.5, 2.0, 11.0, 8.0), (2, 0, 3.2, 8.9, 4.0, 5.0)]
    got = {tuple(r)[:3] for r in distances.rasterise_spheres(spark.createDataFrame(data, POINT), (1.0, 2.0, 1.0), margin).collect()}
    want = set()
    for _, _, x, y, z, d in data:
        at = [int(c / s) for c, s in ((x, 1.0), (y, 2.0), (z, 1.0))]
        want |= {v for v in ((i, j, k) for i in range(30) for j in range(30) for k in range(30)) if (v[0] - at[0]) ** 2 + 4 * (v[1] - at[1]) ** 2 + (v[2] - at[2]) ** 2 < (d / 2 + margin) ** 2}
    assert got == want
