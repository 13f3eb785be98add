"""Rewrites of networks against one-by-one brute force, and TIFF against known bytes."""

import random

import numpy as np
import pytest

from plexus.operators import rewrites
from plexus.sources import tiff

POINT = "e_id long, seq long, x double, y double, z double, d double"


def network(spark, rng, n_v, n_e, spread=20.0):
    pos = {i: tuple(rng.uniform(0, spread) for _ in range(3)) for i in range(n_v)}
    edges = [(i, rng.randrange(n_v), rng.randrange(n_v)) for i in range(n_e)]
    points = []
    for e, a, b in edges:
        inner = [tuple(rng.uniform(0, spread) for _ in range(3)) for _ in range(rng.choice([0, 0, 0, 1]))]
        points += [(e, k, *p, rng.uniform(1, 9)) for k, p in enumerate([pos[a], *inner, pos[b]])]
    v = spark.createDataFrame([(i, *p) for i, p in pos.items()], "v_id long, x double, y double, z double")
    return pos, edges, points, spark.createDataFrame(edges, "e_id long, v0 long, v1 long"), v, spark.createDataFrame(points, POINT)


def far(p, q):
    return sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5


@pytest.mark.parametrize("seed", [1, 2])
def test_deloop_by_brute_force(spark, seed):
    pos, edges, points, e, v, p = network(spark, random.Random(seed), 9, 26)
    npts = {i: sum(r[0] == i for r in points) for i, _, _ in edges}
    again = {i for i, a, b in edges if npts[i] == 2 and any(j > i and {a, b} == {c, d} for j, c, d in edges)}
    short = {i: {a, b} for i, a, b in edges if npts[i] == 2 and i not in again and a != b}
    k = {w: sum(w in (a, b) for _, a, b in edges) for w in pos}
    length = {i: far(*(pos[w] for w in s)) for i, s in short.items()}
    gone = set(again)
    for i in short:
        for j in short:
            for m in short:
                if i < j < m and len(short[i] | short[j] | short[m]) == 3:
                    low = {w for w in short[i] | short[j] if k[w] == 2}
                    gone |= {x for x in (i, j, m) if short[x] & low} if low else {max((i, j, m), key=lambda x: (length[x], -x))}
    assert {r["e_id"] for r in rewrites.deloop(e, v, p).collect()} == {i for i, _, _ in edges} - gone


@pytest.mark.parametrize("seed", [3, 4])
def test_reduce_one_by_one(spark, seed):
    pos, edges, points, e, v, p = network(spark, random.Random(seed), 22, 26, 9.0)
    own = {i: [r[2:] for r in points if r[0] == i] for i, _, _ in edges}
    ratio = {i: sum(far(a[:3], b[:3]) for a, b in zip(r, r[1:])) / (sum(q[3] for q in r) / len(r)) for i, r in own.items()}
    at, ends, tip = dict(pos), {i: [a, b] for i, a, b in edges}, {i: [r[0][3], r[-1][3]] for i, r in own.items()}
    for i, _, _ in edges:
        a, b = ends[i]
        if ratio[i] > 1.5 or a == b:
            continue
        links = {w: [(j, s) for j, x in ends.items() for s in (0, 1) if x[s] == w] for w in (a, b)}
        others = [{ends[j][1 - s] for j, s in links[w] if j != i} for w in (a, b)]
        if others[0] & others[1] or len(links[b]) in (1,) or len(links[a]) > 3 or len(links[b]) > 3:
            continue
        at[a] = tuple((p + q) / 2 for p, q in zip(at[a], at[b]))
        d = sum(tip[i]) / 2
        del ends[i], at[b]
        for j, s in links[a] + links[b]:
            if j != i:
                ends[j][s], tip[j][s] = a, d
    v2, e2, p2 = rewrites.reduce_edges(e, v, p, 1.5)
    assert len(ends) < len(edges)
    assert {r["e_id"]: [r["v0"], r["v1"]] for r in e2.collect()} == ends
    assert {r["v_id"]: pytest.approx((r["x"], r["y"], r["z"])) for r in v2.collect()} == at
    for i in ends:
        rows = sorted(tuple(r) for r in p2.where(f"e_id = {i}").collect())
        assert [rows[0][5], rows[-1][5]] == pytest.approx(tip[i]) and rows[0][2:5] == pytest.approx(at[ends[i][0]]) and rows[-1][2:5] == pytest.approx(at[ends[i][1]])


def test_loose_ends_take_turns(spark):
    rng = random.Random(5)
    rows, edges = [], []
    for i in range(30):
        a = np.array([rng.uniform(0, 60) for _ in range(3)])
        b = a + np.array([rng.uniform(-9, 9) for _ in range(3)])
        edges.append((i, 2 * i, 2 * i + 1))
        rows += [(i, 0, *map(float, a), 3.0), (i, 1, *map(float, b), 3.0)]
    e, p = spark.createDataFrame(edges, "e_id long, v0 long, v1 long"), spark.createDataFrame(rows, POINT)
    tips = {}
    for i in range(30):
        a, b = np.array(rows[2 * i][2:5]), np.array(rows[2 * i + 1][2:5])
        u = (a - b) / np.linalg.norm(a - b)
        tips[2 * i], tips[2 * i + 1] = (a, u), (b, -u)
    free, want = set(tips), {}
    for i in sorted(tips):
        best = None
        for j in sorted(free):
            if i in free and j > i:
                w = tips[j][0] - tips[i][0]
                d = np.linalg.norm(w)
                s = (1 + w @ tips[i][1] / d) / 2 * (1 - w @ tips[j][1] / d) / 2 / d
                if d <= 40 and s >= 1 / 40 and (best is None or s > best[0]):
                    best = (s, j)
        if best:
            want[i] = best[1]
            free -= {i, best[1]}
    got = rewrites.join_loose_ends(e, p, 40.0).collect()
    assert {r["tip0"]: r["tip1"] for r in got} == want and want
    for r in got:
        m = np.array((r["x"], r["y"], r["z"]))
        assert np.linalg.norm(m - tips[r["tip0"]][0]) == pytest.approx(np.linalg.norm(m - tips[r["tip1"]][0]))


def test_no_loose_ends(spark):
    e, p = spark.createDataFrame([(1, 1, 1)], "e_id long, v0 long, v1 long"), spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0), (1, 1, 1.0, 0.0, 0.0, 1.0)], POINT)
    assert rewrites.join_loose_ends(e, p).count() == 0


@pytest.mark.parametrize("method", sorted(tiff.METHODS))
def test_tiff_codecs(method):
    rng = np.random.default_rng(1)
    for data in (b"", b"a", bytes(300), rng.integers(0, 256, 70_000, dtype=np.uint8).tobytes(), rng.integers(0, 2, 9_000, dtype=np.uint8).tobytes(), b"ab" * 400 + bytes(7)):
        assert tiff.DECODE[tiff.METHODS[method]](tiff.ENCODE[method](data)) == data


def test_packbits_known_bytes():
    packed = bytes.fromhex("feaa0280002afdaa0380002a22f7aa")  # the example of the format's specification
    assert tiff.unpack_bits(packed) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    assert len(tiff.pack_bits(bytes(1000))) == 16


@pytest.mark.parametrize("method, bits", [("none", 8), ("packbits", 8), ("lzw", 16), ("deflate", 16)])
def test_tiff_round_trip(spark, tmp_path, method, bits):
    rng = random.Random(6)
    cells = {(rng.randrange(13), rng.randrange(7), rng.choice([0, 2, 3])): rng.randrange(1, 1 << bits) for _ in range(200)}
    vox = spark.createDataFrame([(*c, v) for c, v in cells.items()], "x int, y int, z int, v int")
    (tmp_path / "a.tif").write_bytes(tiff.tiff_bytes(vox, (13, 7, 5), method, bits))
    assert {(r["x"], r["y"], r["z"]): r["v"] for r in tiff.read_tiff(spark, str(tmp_path / "a.tif")).collect()} == cells
