"""Text lists, and diameters and points as writers want them."""

import pytest

from plexus.operators import network
from plexus.sources import files, lists

POINT = "e_id long, seq long, x double, y double, z double, d double"


def test_boundary_round_trip(spark, tmp_path):
    vox = spark.createDataFrame([(1, 2, 3, 255), (100, 0, 7, 255), (4, 4, 4, 0)], "x int, y int, z int, v int")
    assert sorted(r[0] for r in lists.boundary_lines(vox).collect()) == ["     1      2      3", "   100      0      7"]
    lists.write_boundary(vox, str(tmp_path / "b"))
    assert sorted(map(tuple, lists.read_boundary(spark, str(tmp_path / "b"), (2.0, 2.0, 0.5)).collect())) == [(2.0, 4.0, 1.5), (200.0, 0.0, 3.5)]


def test_sites_by_spaces_or_commas(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a 1 2 3 10\nb, 4,5, 6 ,0.5\n\nshort 1 2\n")
    got = sorted(map(tuple, lists.read_sites(spark, str(tmp_path / "s.txt")).collect()))
    assert got == [("a", 1.0, 2.0, 3.0, 10.0), ("b", 4.0, 5.0, 6.0, 0.5)]


def test_site_spheres_of_unlike_sizes(spark):
    vertex = spark.createDataFrame([(v, float(10 * v), 0.0, 0.0) for v in range(10)], "v_id long, x double, y double, z double")
    edge = spark.createDataFrame([(v, v, v + 1) for v in range(9)], "e_id long, v0 long, v1 long")
    sizes = spark.createDataFrame([(v, 10.0, 1.0) for v in range(9)], "e_id long, length double, volume double")
    site = spark.createDataFrame([("wide", 0.0, 0.0, 0.0, 35.0), ("thin", 50.0, 0.0, 0.0, 5.0), ("none", 0.0, 500.0, 0.0, 9.0)], "site string, x0 double, y0 double, z0 double, r double")
    got = {r["site"]: r for r in network.sites(edge, vertex, sizes, site).collect()}
    volume = lambda r: 1e9 / (4 / 3 * 3.14159 * r**3)
    assert set(got) == {"wide", "thin"}
    # Vertices 0 to 3 lie within 35: edges 0 to 3; vertex 5 alone within 5: edges 4 and 5.
    for name, r, n in (("wide", 35.0, 4), ("thin", 5.0, 2)):
        assert got[name]["vess_per_mm3"] == pytest.approx(n * volume(r)) and got[name]["len_per_mm3"] == pytest.approx(10 * n * volume(r))


def test_diameters_and_points_for_writers(spark):
    point = spark.createDataFrame([(1, s, float(s), 0.0, 0.0, d) for s, d in enumerate((1.0, 5.0, 3.0))] + [(2, 0, 9.0, 9.0, 9.0, 2.0)], POINT)
    assert sorted(r["d"] for r in files.with_diameter(point, least=2.5).collect()) == [2.5, 2.5, 3.0, 5.0]
    assert {r["d"] for r in files.with_diameter(point, fixed=4).collect()} == {4.0}
    # An edge of one point is written with that point twice.
    assert sorted((r["e_id"], r["seq"], r["x"], r["d"]) for r in files.ends_only(point).collect()) == [(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.0), (2, 0, 9.0, 2.0), (2, 1, 9.0, 2.0)]
