"""Meshes: the kernel against brute force, every partitioner and checker against one task, the checks themselves."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.vectors import axes
from tessella.operators import checkers, locate, mesh, partition, sample, triangulate, validate
from tessella.operators.graph import cut_graph
from tessella.operators.kernel import Mesh
from tessella.operators.predicates import orient2, orient3, sphere2, sphere3
from tessella.sources import generators, points, reports
from tessella.sources.scratch import settle


def brute(at):
    n, d = at.shape
    orient, sphere = (orient2, sphere2) if d == 2 else (orient3, sphere3)
    p = [tuple(map(float, row)) for row in at]
    for c in itertools.combinations(range(n), d + 1):
        q = [p[i] for i in c]
        side = orient(*q)
        if side < 0:
            q[0], q[1] = q[1], q[0]
        if side and all(sphere(*q, p[k]) <= 0 for k in range(n) if k not in c):
            yield c


@pytest.mark.parametrize("dim, n", [(2, 30), (3, 16)])
def test_kernel_is_delaunay(dim, n):
    for seed in range(4):
        at = np.random.default_rng(seed).normal(size=(n, dim))
        assert set(map(tuple, Mesh(at).simplices().tolist())) == set(brute(at))


@pytest.mark.parametrize("dim, side", [(2, 6), (3, 4)])
def test_ties_do_not_depend_on_the_order(dim, side):
    at = np.array(list(itertools.product(range(side), repeat=dim)), float)
    seen = set()
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(at))
        s = np.sort(order[Mesh(at[order]).simplices()], axis=1)
        volume = sum(abs(np.linalg.det(at[v[1:]] - at[v[0]])) for v in s) / (2 if dim == 2 else 6)
        assert volume == pytest.approx((side - 1) ** dim)
        seen.add(tuple(sorted(map(tuple, s.tolist()))))
    assert len(seen) == 1


def test_flat_inputs():
    line = np.array([[k, 2.0 * k] for k in range(5)])
    assert Mesh(line).flat and len(Mesh(line).simplices()) == 0
    assert Mesh(np.zeros((0, 2))).flat and Mesh(np.zeros((2, 3))).flat


def table(spark, at, first=1):
    return spark.createDataFrame([(i + first, *map(float, row)) for i, row in enumerate(at)], points.spatial_schema(at.shape[1]))


def whole(df, dim):
    return settle(mesh.with_neighbours(mesh.identified(settle(mesh.mesh_of(df, dim), "one"))), "one")


CASES = [("u", 2, "d", "bounds"), ("l", 2, "c", "bounds"), ("e", 3, "d", "bounds"), ("patch-bubble", 2, "e", "grid"), ("b", 2, "c", "accurate-grid")]


@pytest.mark.parametrize("kind, dim, splitter, checker", CASES)
def test_parts_merge_to_the_whole(spark, kind, dim, splitter, checker):
    own = settle(mesh.distinct_points(generators.generate(spark, kind, 120, ([0.0] * dim, [100.0] * dim)), dim), "points")
    got = settle(triangulate.triangulate(own, dim, splitter, 1, checker, 12.5, task_points=60), "mesh")
    assert validate.cross_check(got, whole(own, dim)).collect() == []
    assert [r for r in validate.verify(got, own, dim).collect() if r.kind != "unused"] == []


def test_parts_follow_the_size_of_skewed_points(spark):
    at = np.concatenate([np.random.default_rng(5).random((90, 2)) * 0.01, np.random.default_rng(6).random((30, 2))])
    own = table(spark, at)
    assert partition.depth_within("d", 2, 120, 40) == 1 and partition.depth_within("c", 2, 120, 20) == 3
    parts = partition.assign(own, 2, "d", 1 + triangulate.SKEW_LEVELS, 40)
    assert parts.count() == 120 and parts.groupBy("path").count().agg(F.max("count")).first()[0] <= 40
    got = settle(triangulate.triangulate(own, 2, task_points=40), "mesh")
    assert validate.cross_check(got, whole(own, 2)).collect() == []


def test_off_origin_far_points(spark):
    own = settle(table(spark, 10_000 + np.random.default_rng(3).random((36, 2))), "points")
    got = triangulate.triangulate(own, 2, "d", 1, far="mid")
    with_far = own.unionByName(points.far_points(own, 2))
    assert validate.cross_check(got, whole(with_far, 2)).collect() == []


@pytest.mark.parametrize("name", [*sample.PARTITIONERS, "kway", "cycle"])
def test_sample_partitioners(spark, name):
    own = settle(table(spark, np.random.default_rng(1).random((150, 2))), "points")
    options = {"cutoff": 30} if name.endswith(("pasb", "besp")) else {}
    parts = settle(sample.partition(own, 2, name, 4, **options), "parts")
    assert parts.count() == 150 and parts.select("part").distinct().count() > 1
    got = triangulate.triangulate(own, 2, assigned=parts)
    assert validate.cross_check(got, whole(own, 2)).collect() == []


def test_plane_checker_keeps_what_the_other_side_reaches(spark):
    own = table(spark, np.random.default_rng(2).random((60, 2)))
    parts = settle(own.withColumn("part", F.when(F.col("x") > 0.5, "01").otherwise("00")), "parts")
    pieces = settle(mesh.local_meshes(parts, 2), "pieces")
    plane = {(r.part, tuple(r.v)) for r in checkers.edge_by_plane(pieces.where("kind = 's'"), 2, [1.0, 0.0], 0.5).collect()}
    box = {(r.part, tuple(r.v)) for r in checkers.edge_simplices(pieces, parts, 2).collect()}
    assert box <= plane


def test_checks_find_what_is_wrong(spark):
    own = table(spark, np.random.default_rng(4).random((20, 2)))
    good = whole(own, 2)
    first = good.orderBy("id").first()
    assert validate.verify(good, own, 2).count() == 0
    assert "duplicate" in {r.kind for r in validate.verify(good.unionByName(good.where(F.col("id") == first.id)), own, 2).collect()}
    less = good.where(F.col("id") != first.id)
    assert "neighbour" in {r.kind for r in validate.verify(less, own, 2).collect()}
    assert {r.kind for r in validate.cross_check(less, good).collect()} >= {"missing"}
    assert {r.kind for r in validate.verify(good, own.where("id > 1"), 2).collect()} >= {"foreign"}
    more = own.unionByName(table(spark, np.array([[0.5, 0.5]]), 99))
    assert [r.simplex_id for r in validate.unused_points(good, more).collect()] == [99]
    flipped = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.1, 1.1), (4, 0.0, 1.0)], points.spatial_schema(2))
    bad = mesh.with_neighbours(mesh.identified(spark.createDataFrame([([1, 2, 3],), ([1, 3, 4],)], "v array<long>")))
    assert {r.kind for r in validate.verify(bad, flipped, 2).collect()} == {"sphere"}


def test_nearest_simplex(spark):
    own = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (4, 1.0, 1.0)], points.spatial_schema(2))
    two = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4])], "id long, v array<long>")
    asked = spark.createDataFrame([(1, 0.25, 0.25), (2, 0.75, 0.75), (3, 1.25, 1.25)], "qid long, x double, y double")
    assert {r.qid: r.simplex_id for r in locate.locate(asked, two, own, 2, 2.0).collect()} == {1: 1, 2: 2, 3: 2}


def test_duplicate_places_keep_the_smallest_id(spark):
    own = spark.createDataFrame([(5, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 0.0), (4, 0.0, 1.0)], points.spatial_schema(2))
    assert [(r.id, r.kept) for r in mesh.dropped_points(own, 2).collect()] == [(5, 2)]
    assert [r.v for r in triangulate.triangulate(own, 2).collect()] == [[2, 3, 4]]


def test_graph_cut_is_balanced():
    n = 12
    src = np.array([a for a in range(n * n) for b in (a + 1, a + n) if b < n * n and (b != a + 1 or b % n)])
    dst = np.array([b for a in range(n * n) for b in (a + 1, a + n) if b < n * n and (b != a + 1 or b % n)])
    both = np.concatenate([src, dst]), np.concatenate([dst, src])
    for k in (1, 2, 4, 7):
        label = cut_graph(n * n, *both, np.ones(2 * len(src)), k)
        size = np.bincount(label, minlength=k)
        assert len(size) == k and size.min() > 0 and size.max() <= 1.05 * -(-n * n // k)
    assert (label == cut_graph(n * n, *both, np.ones(2 * len(src)), 7)).all()


@pytest.mark.parametrize("kind", ["u", "n", "b", "e", "l", "patch-bubble", "malicious-bubble", "unbound-bubble"])
def test_generators(spark, kind):
    bounds = ([0.0, 10.0, -5.0], [100.0, 20.0, 5.0])
    got = generators.generate(spark, kind, 301, bounds, seed=4)
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[0] for r in rows] == list(range(1, 302))
    assert all(lo <= c <= hi for r in rows for c, lo, hi in zip(r[1:], *bounds))
    assert rows == sorted(tuple(r) for r in generators.generate(spark, kind, 301, bounds, seed=4).repartition(3).collect())
    with pytest.raises(ValueError):
        generators.generate(spark, "nothing", 1, bounds)


def test_ids_follow_the_curve(spark):
    got = generators.generate(spark, "u", 200, ([0.0, 0.0], [1.0, 1.0]), spatial_ids=True).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 201))
    step = np.hypot(np.diff([r.x for r in got]), np.diff([r.y for r in got])).mean()
    assert step < 0.2


def test_text_points(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 2 3\n4.5 5 6\n7 8 9e1\n")
    got = points.read_points(spark, str(tmp_path / "p.txt"), 3)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 1.0, 2.0, 3.0), (2, 4.5, 5.0, 6.0), (3, 7.0, 8.0, 90.0)]
    points.write_points(got, str(tmp_path / "out"), 3)
    assert points.read_points(spark, str(tmp_path / "out"), 3).count() == 3
    (tmp_path / "bad.txt").write_text("1 2\n")
    with pytest.raises(Exception, match="without 3 numbers"):
        points.read_points(spark, str(tmp_path / "bad.txt"), 3).collect()


def test_partition_depth_and_cutoff(spark):
    own = table(spark, np.random.default_rng(1).random((64, 2)))
    assert partition.depth_for("d", 2, 16) == 2 and partition.slab_counts(8, 3) == [2, 2, 2]
    got = partition.assign(own, 2, "c", 3, cutoff=20)
    sizes = {r.path: r.n for r in got.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 64 and all(len(p) == 4 or n <= 20 for p, n in sizes.items())
    with pytest.raises(ValueError):
        partition.split(own.withColumn("path", F.lit("0")), 2, "x")


def test_reports(spark, tmp_path):
    run = reports.run_record(spark, {"alg": "c", "basecase": "500", "host": "a"}, {"times": [4, 7], "memory": [10]})
    line = reports.result_line(run)
    assert line.first().line == "RESULT alg=c basecase=500 host=a memory=10 times=5"
    same = run.select(reports.same_run(F.col("traits"), reports.parse_traits(F.lit("RESULT alg=c basecase=500 host=b"))).alias("s")).first().s
    assert same
    path = str(tmp_path / "runs")
    reports.append_run(reports.run_record(spark, {"run-number": "6"}, {}), path)
    assert reports.next_run_number(spark, path) == 7
    edges = spark.createDataFrame([(0, 1, 5), (1, 0, 5), (1, 2, 7), (2, 1, 7)], "src long, dst long, w int")
    assert [r.line for r in reports.metis_lines(edges, 4).orderBy("idx").collect()] == ["4 2 1", "2 5", "1 5 3 7", "2 7", ""]
    own = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0)], points.spatial_schema(2))
    assert reports.svg(spark.createDataFrame([([1, 2, 3],)], "v array<long>"), own).count("<line") == 3
    assert axes(2) == ["x", "y"]
