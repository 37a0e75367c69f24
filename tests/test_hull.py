"""Checks of the hull and exact signs: planted faults of each kind are found, sound meshes pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.vectors import axes
from tessella.operators import mesh, validate
from tessella.sources.scratch import settle


def table(spark, at):
    return spark.createDataFrame([(i + 1, *p) for i, p in enumerate(np.asarray(at, float).tolist())], "id long, " + ", ".join(f"{a} double" for a in axes(len(at[0]))))


def known(spark, own, dim):
    return settle(mesh.with_neighbours(mesh.identified(settle(mesh.mesh_of(own, dim), "one"))), "known")


def kinds(rows):
    return {r.kind for r in rows.collect()}


@pytest.mark.parametrize("dim", [2, 3])
def test_faults_of_the_hull(spark, dim):
    own = settle(table(spark, np.random.default_rng(dim).random((40, dim))), "own")
    good = known(spark, own, dim)
    assert kinds(validate.verify(good, own, dim)) == set()
    inner = good.where(~F.exists("nb", lambda n: n.isNull())).orderBy("id").first().id
    holed = settle(mesh.with_neighbours(good.where(F.col("id") != inner).select("id", "v", "fp")), "holed")
    assert kinds(validate.verify(holed, own, dim)) >= {"hull", "euler"}
    outer = good.where(F.exists("nb", lambda n: n.isNull())).orderBy("id").first().id
    dented = settle(mesh.with_neighbours(good.where(F.col("id") != outer).select("id", "v", "fp")), "dented")
    assert "hull" in kinds(validate.verify(dented, own, dim))


def test_a_hull_that_is_not_closed(spark):
    """Two triangles that meet in a point only: it lies on four edges of the hull."""
    own = table(spark, [(0, 0), (1, 0), (0, 1), (-1, 0), (0, -1)])
    two = mesh.with_neighbours(mesh.identified(spark.createDataFrame([([1, 2, 3],), ([1, 4, 5],)], "v array<long>")))
    assert kinds(validate.verify(two, own, 2)) >= {"ridge", "hull"}
    apart = mesh.with_neighbours(mesh.identified(spark.createDataFrame([([1, 2, 3],), ([4, 5, 6],)], "v array<long>")))
    far = table(spark, [(0, 0), (1, 0), (0, 1), (5, 5), (6, 5), (5, 6)])
    rows = validate.verify(apart, far, 2).collect()
    assert [(r.kind, r.simplex_id, r.other_id) for r in rows] == [("euler", None, 2)]


@pytest.mark.parametrize("shift", [0.0, 2.0**-50, -(2.0**-50)])
def test_spheres_to_the_last_bit(spark, shift):
    """A square whose fourth corner is on the circle, or a rounding error inside or outside it."""
    own = table(spark, [(0, 0), (1, 0), (1 - shift, 1 - shift), (0, 1)])
    two = settle(mesh.with_neighbours(mesh.identified(spark.createDataFrame([([1, 2, 4],), ([2, 3, 4],)], "v array<long>"))), "two")
    assert validate.filled_spheres(two, own, 2).count() == (2 if shift > 0 else 0)
    assert validate.filled_spheres(two, own, 2, strict=True).count() == (2 if shift >= 0 else 0)


def test_points_on_a_line_of_the_hull_and_cospherical_ones(spark):
    grid = [(x, y, z) for x in range(4) for y in range(4) for z in range(3)]
    for dim, at in ((2, [p[:2] for p in grid if p[2] == 0]), (3, grid)):
        own = table(spark, at)
        assert kinds(validate.verify(known(spark, own, dim), own, dim)) == set()
