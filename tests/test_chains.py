"""Chains of operators and the CMGUI text against brute force."""

import math
import random
from itertools import product

from plexus.functions.geom import N26
from plexus.operators import chains
from plexus.sources import cmgui

SIZE = (14, 14, 14)
POINT = "e_id long, seq long, x double, y double, z double, d double"


def vox(spark, cells, v=255):
    return spark.createDataFrame([(*map(int, c), v) for c in cells], "x int, y int, z int, v int")


def cells(df):
    return {(r["x"], r["y"], r["z"]) for r in df.collect()}


def test_fill_by_brute_force(spark):
    rng = random.Random(8)
    lit = {c for c in product(range(14), repeat=3) if 18 <= sum((v - 6.5) ** 2 for v in c) <= 30 and rng.random() < 0.8}
    voxel, reach, n = (1.0, 1.0, 1.5), 6.0, 18
    limit, inside = chains.direction_limit(), set(product(range(14), repeat=3))

    def probe(lit, p):
        found = []
        for o in N26:
            dd = sum((c * s) ** 2 for c, s in zip(o, voxel))
            k = 1
            while k * k * dd < reach * reach:
                if tuple(a + k * b for a, b in zip(p, o)) in lit:
                    found.append((o, k * dd))
                    break
                k += 1
        return found

    now = {p for p in lit if sum(tuple(a + b for a, b in zip(p, o)) in lit for o in N26) >= 2}
    start = now
    candidates = {p for p in inside - now if len(probe(now, p)) >= n // 2}
    for _ in range(2):
        new, done = set(), set()
        for p in candidates - now:
            hits = probe(now, p)[:n]
            if len(hits) < n:
                continue
            done.add(p)
            r2 = min(h[1] for h in hits)
            reach_ = [range(-math.floor(math.sqrt(r2) / s + 0.5), math.floor(math.sqrt(r2) / s + 0.5) + 1) for s in voxel]
            for o in product(*reach_):
                way = [a * b for a, b in zip(o, voxel)]
                d2 = sum(c * c for c in way)
                if d2 <= r2 and (d2 == 0 or any(sum(a * b for a, b in zip(h[0], way)) / math.dist(h[0], (0, 0, 0)) > limit * math.sqrt(d2) for h in hits)):
                    new.add(tuple(a + b for a, b in zip(p, o)))
        now, candidates = now | (new & inside), candidates - done
    assert len(now) > len(start)
    assert cells(chains.fill(vox(spark, lit), SIZE, reach, n, voxel, sweeps=2)) == now


def test_peel_takes_the_shell(spark):
    big = {c for c in product(range(14), repeat=3) if sum((v - 7) ** 2 for v in c) <= 25}
    speck = {(1, 1, 1)}
    for one in (False, True):
        got = cells(chains.peel(vox(spark, big | speck), SIZE, 100, 2, 2, margin=1, least=50, one_background=one))
        assert got and got < big and (7, 7, 7) in got and (7, 7, 12) not in got and not got & speck


def test_cmgui_text(spark):
    p = spark.createDataFrame([(1, i, 1.0 * i, 0.0, 0.0, 4.0) for i in range(6)], POINT)
    assert sorted(map(tuple, cmgui.kept_segments(p).select("seq0", "seq1").collect())) == [(0, 3), (3, 5)]
    nodes, elements = ([r["value"] for r in df.collect()] for df in cmgui.cmgui_lines(p))
    assert nodes[0].startswith("Group name: vessels") and nodes[1] == "Node: 7\n   0.0    0.0    0.0\n  2.00" and len(nodes) == 7
    assert elements[1:] == ["Element: 10 0 0\n  Nodes: 7 10\n  Scale factors: 1 1", "Element: 12 0 0\n  Nodes: 10 12\n  Scale factors: 1 1"]


def test_cmgui_colours(spark):
    paths = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0)], "v_id long, distance double")
    got = {r["v_id"]: r["r"] for r in cmgui.path_colours(paths, "distance", (1.0, 0.0, 0.0)).collect()}
    assert got == {1: 1.0, 2: 0.25, 3: 0.0}
