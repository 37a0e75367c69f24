"""Bottom-up merging: equal to the mesh in one task for deep trees, skewed, flat and far points; tasks stay small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import mesh, tree, triangulate, validate
from tessella.sources import points
from tessella.sources.scratch import settle


def table(spark, at):
    return spark.createDataFrame([(i + 1, *map(float, row)) for i, row in enumerate(at)], points.spatial_schema(at.shape[1]))


def whole(df, dim):
    return settle(mesh.with_neighbours(mesh.identified(settle(mesh.mesh_of(df, dim), "one"))), "one")


def same(got, own, dim):
    assert validate.cross_check(settle(got, "mesh"), whole(own, dim)).collect() == []


def test_tree_covers_all_points():
    r = np.random.default_rng(3)
    low = r.random((37, 2))
    rows = [{"part": k, "n": k + 1, "lo_x": a, "lo_y": b, "hi_x": a + 0.1, "hi_y": b + 0.1} for k, (a, b) in enumerate(low)]
    t = tree.PartTree(rows, 2, fan=4)
    assert sorted(t.leaf) == list(range(37)) and t.points[""] == sum(range(38)) and t.depth >= 3
    for k, node in t.leaf.items():  # the boxes outside a leaf hold all other leaves
        boxes = [b for j in range(1, len(node) + 1) for b in t.near[node[:j]]]
        for j in range(37):
            assert j == k or any(b[0] <= low[j][0] and b[1] <= low[j][1] and b[2] >= low[j][0] + 0.1 and b[3] >= low[j][1] + 0.1 for b in boxes)
    assert tree.PartTree(rows[:1], 2).leaf == {0: ""} and tree.PartTree([], 2).leaf == {}


@pytest.mark.parametrize("dim, n, side", [(2, 900, 5), (3, 250, 2)])
def test_deep_trees(spark, dim, n, side, monkeypatch):
    at = np.random.default_rng(dim).random((n, dim))
    own = settle(table(spark, at), "points")
    cells = F.concat_ws("-", *[F.floor(F.col(a) * side) for a in ("x", "y", "z")[:dim]])
    parts = own.withColumn("part", cells)
    monkeypatch.setattr(tree, "FAN", 2)
    monkeypatch.setattr(tree.PartTree.__init__, "__defaults__", (2,))
    same(triangulate.triangulate(own, dim, assigned=parts), own, dim)


def test_skewed_and_lattice_points(spark):
    r = np.random.default_rng(8)
    grid = np.array([[i, j] for i in range(14) for j in range(14)], float)
    at = np.concatenate([grid, r.random((150, 2)) * 0.5 + 3.25, [[100.0, 3.0], [101.0, 3.0], [102.0, 3.0]]])
    own = settle(table(spark, at), "points")
    parts = own.withColumn("part", F.when(F.col("x") > 90, "line").otherwise(F.concat_ws("-", F.floor(F.col("x") / 4), F.floor(F.col("y") / 4))))
    same(triangulate.triangulate(own, 2, assigned=parts), own, 2)
    mixed = own.withColumn("part", (F.col("id") % 3).cast("string"))  # parts that overlap everywhere
    same(triangulate.triangulate(own, 2, assigned=mixed), own, 2)


def test_far_points_in_a_tree(spark):
    own = settle(table(spark, 50 + np.random.default_rng(3).random((120, 2))), "points")
    got = triangulate.triangulate(own, 2, "c", 4, far="mid")
    same(got, own.unionByName(points.far_points(own, 2)), 2)


def test_no_task_over_its_points(spark, monkeypatch):
    """Tasks record their sizes: borders over the limit are parted again, by a tree of their own."""
    seen, real = [], tree.local_meshes

    def recorded(df, dim):
        seen.extend(r["count"] for r in df.groupBy("part").count().collect())
        return real(df, dim)

    monkeypatch.setattr(tree, "local_meshes", recorded)
    own = settle(table(spark, np.random.default_rng(1).random((3000, 2))), "points")
    got = settle(triangulate.triangulate(own, 2, task_points=300), "mesh")
    assert max(seen) <= 300 and len(seen) > 20
    same(got, own, 2)
