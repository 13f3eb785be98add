"""Repair of diameters and cleaning of skeletons, on networks small enough to work out by hand."""

import pytest

from plexus.operators import diameters, network

POINT = "e_id long, seq long, x double, y double, z double, d double"
EDGE = "e_id long, v0 long, v1 long"


def line(e_id, xs, ds=None):
    return [(e_id, s, float(x), 0.0, 0.0, float(ds[s] if ds else 1)) for s, x in enumerate(xs)]


def by_edge(df):
    out = {}
    for r in df.orderBy("e_id", "seq").collect():
        out.setdefault(r["e_id"], []).append(round(r["d"], 4))
    return out


def gaps(spark):
    edge = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 7, 8)], EDGE)
    rows = line(1, [0, 10, 20, 30], [0, 4, 8, 0]) + line(2, [30, 40, 50], [0, 0, 0]) + line(3, [0, 5], [0, 0])
    return edge, spark.createDataFrame(rows, POINT)


def test_diameters_fill_ways_and_spread_to_neighbours(spark):
    edge, point = gaps(spark)
    assert by_edge(diameters.fix_diameters(edge, point, uniform=False)) == {1: [4, 4, 8, 8], 2: [8, 8, 8], 3: [0, 0]}


@pytest.mark.parametrize(("kw", "joint"), [({}, 7.1623), ({"max_ratio": 1.2}, 8.0), ({"junction_max": True}, 8.0)])
def test_one_diameter_keeps_the_volume(spark, kw, joint):
    """1200 of length times squares, less the ends' 80 and 320, over a length of 20: the root of 40."""
    edge, point = gaps(spark)
    got = by_edge(diameters.fix_diameters(edge, point, **kw))
    assert got == {1: [6.3246, 6.3246, 6.3246, joint], 2: [joint, 8.0, 8.0], 3: [0, 0]}


def test_diameters_near_a_junction_and_gaps_between(spark):
    """The wide point 1 away from the end isn't trusted; the unknown ones lie on a line between 6 and 3."""
    edge = spark.createDataFrame([(1, 1, 2)], EDGE)
    point = spark.createDataFrame(line(1, [0, 1, 10, 20, 30, 40], [0, 9, 6, 0, 0, 3])[:6] + [(9, 0, 0.0, 0.0, 0.0, 1.0)], POINT)
    got = by_edge(diameters.fix_diameters(edge, point, uniform=False))
    assert got == {1: [6, 6, 6, 6, 6, 6]}
    point = spark.createDataFrame(line(1, [0, 10, 20, 30, 40, 50], [0, 6, 0, 0, 3, 0]), POINT)
    assert by_edge(diameters.fix_diameters(edge, point, uniform=False)) == {1: [6, 6, 5, 4, 3, 3]}


def test_diameters_of_nothing(spark):
    edge, point = spark.createDataFrame([], EDGE), spark.createDataFrame([], POINT)
    assert diameters.fix_diameters(edge, point).count() == 0


def test_spurs_and_loops_go(spark):
    edge = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 2, 4), (4, 5, 6), (5, 6, 7), (6, 6, 8), (7, 9, 10), (8, 10, 10), (9, 10, 11)], EDGE)
    rows = line(1, [0, 10]) + line(2, [10, 20]) + line(3, [10, 11])  # one spur on a long way
    rows += line(4, [0, 10]) + line(5, [10, 11]) + line(6, [10, 11])  # of two spurs one is the way's end
    rows += line(7, [0, 10]) + line(8, [10, 15, 10]) + line(9, [10, 20])  # a loop on a way
    e, p = network.strip(edge, spark.createDataFrame(rows, POINT), 2.0)
    assert [tuple(r) for r in e.orderBy("e_id").collect()] == [(1, 1, 3), (4, 5, 8), (7, 9, 11)]
    assert {r["e_id"]: r["length"] for r in network.edge_dimensions(p).collect()} == {1: 20.0, 4: 11.0, 7: 20.0}
