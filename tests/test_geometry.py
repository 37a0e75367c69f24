"""Geometry functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import boxes, grid, scalars, simplices, vectors
from tessella.operators import predicates


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def at(*values):
    return [F.lit(float(v)) for v in values]


TRIANGLE = [(0, 0), (1, 0), (0, 1)]


def test_in_simplex_and_nearest_vertex(spark):
    t = [at(*v) for v in TRIANGLE]
    inside = one(spark, *[simplices.in_simplex(t, at(*p)) for p in ((0.25, 0.25), (0.5, 0.5), (1, 1))])
    assert list(inside) == [True, True, False]
    near = one(spark, *[simplices.nearest_vertex(t, at(*p)) for p in ((0.25, 0.25), (0.75, 0.25), (0.25, 0.85), (0.95, 0.75))])
    assert list(near) == [0, 1, 2, 1]
    assert list(one(spark, simplices.in_simplex([at(0, 0), at(1, 1), at(2, 2)], at(1, 1)))) == [False]


def test_in_sphere_whatever_the_orientation(spark):
    a, b, c, up, down = at(0, 0, 0), at(2, 0, 0), at(1, 2, 0), at(1, 1, 1), at(1, 1, -1)
    for t in ([a, b, c, down], [a, b, c, up], [a, c, b, down], [a, c, b, up]):
        assert list(one(spark, simplices.in_sphere(t, at(1, 1, 0)), simplices.in_sphere(t, at(5, 5, 5)))) == [True, False]


def test_fingerprints(spark):
    v = {"x": [2553, 3528, 4184, 6413], "same": [2553, 4184, 3528, 6413], "next": [3528, 4184, 5555, 6413], "other": [2543, 3268, 4345, 6093], "zero": [97, 892, 1371, 3932]}
    table = spark.createDataFrame(list(v.items()), "name string, v array<long>").withColumn("fp", simplices.fingerprint(F.col("v")))
    faces = F.transform("v", lambda i: simplices.face_fingerprint(F.col("fp"), i))
    got = {r.name: r for r in table.select("name", "fp", faces.alias("faces")).collect()}
    assert got["x"].fp == got["same"].fp and got["x"].fp != got["other"].fp and got["zero"].fp != 0 and all(got["zero"].faces)
    assert len(set(got["x"].faces) & set(got["next"].faces)) == 1

    def rotl(i):
        low, by = i & 0xFFFFFFFF, i & 31
        return (low << by | low >> (32 - by)) & 0xFFFFFFFF

    want = 0
    for i in v["x"]:
        want ^= rotl(i)
    assert got["x"].fp == want


def test_boxes(spark):
    box = at(0, 0, 0), at(100, 100, 100)
    half = at(50, 0, 0), at(100, 100, 100)
    low, high = boxes.subtract(box, half)
    assert list(one(spark, *[c.alias(f"c{k}") for k, c in enumerate(low + high)])) == [0, 0, 0, 50, 100, 100]
    with pytest.raises(Exception, match="one face"):
        one(spark, boxes.subtract(box, (at(50, 50, 0), at(100, 100, 100)))[0][0])
    got = one(spark, boxes.intersects_sphere(box, at(-1, 50, 50), F.lit(1.0)), boxes.intersects_sphere(box, at(-1, 50, 50), F.lit(0.99)), boxes.intersects_sphere(box, at("nan", 0, 0), F.lit(1.0)), boxes.contains_sphere(box, at(50, 50, 50), F.lit(2500.0)), boxes.contains_sphere(box, at(50, 50, 50), F.lit(2501.0)))
    assert list(got) == [True, False, True, True, False]


def test_grid_floors(spark):
    assert list(one(spark, *grid.cell_of(at(0.49, -0.49), 1.0))) == [0, -1]
    assert grid.diagonal(3, 2.0) == pytest.approx(12**0.5)


def test_numbers_in_text(spark):
    ints = {"124": 1, "1": 1, "0": 1, "+230": 1, "-230": 1, "": 0, "24.3": 0, "24a": 0, "a24": 0}
    floats = {"0": 1, "1": 1, "0.0": 1, "234": 1, "+234": 1, "234.3": 1, "-234.3": 1, "1.4e3": 1, "3.5E3": 1, ".23432": 1, "-.234": 1, "234a": 0, "234.3.2": 0, "234..234": 0, "": 0}
    for known, f in ((ints, scalars.is_int), (floats, scalars.is_float)):
        table = spark.createDataFrame(list(known.items()), "s string, y int")
        assert table.where(f(F.col("s")).cast("int") != F.col("y")).count() == 0
    assert [scalars.next_pow2(5), scalars.log2_floor(9), scalars.log_floor(17, 4), scalars.is_pow2(6), scalars.sample_size("sqrt", 101), scalars.sample_size("log2", 9)] == [8, 3, 2, False, 10, 3]


def test_vectors(spark):
    a, b = at(1, 2, 3), at(4, 5, 6)
    got = one(spark, vectors.dot(a, b), vectors.square_distance(a, b), vectors.length(at(3, 4)), vectors.above_plane(a, at(0, 0, 1), 3.0), vectors.array_dot(F.array(*a), F.array(*b)))
    assert list(got) == [32.0, 27.0, 5.0, False, 32.0]


def test_exact_predicates_where_floats_fail():
    e = 2.0**-52
    assert predicates.orient2((0.5, 0.5), (0.5 + e, 0.5 + e), (0.5 + 2 * e, 0.5 + 2 * e)) == 0
    assert predicates.orient2((12.0, 12.0), (24.0, 24.0), (0.5, 0.5 + e)) == predicates.exact_orient([(12.0, 12.0), (24.0, 24.0), (0.5, 0.5 + e)]) != 0
    assert predicates.sphere2((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)) == 0
    assert predicates.sphere3((1.0, 0, 0), (0, 1.0, 0), (-1.0, 0, 0), (0, 0, 1.0), (0, 0, -1.0)) == 0
    assert predicates.orient3((0, 0, 0), (1e-30, 0, 0), (0, 1e-30, 0), (0, 0, -1e-30)) == 1
