"""Ids of simplices without collisions, and the curve."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.vectors import axes
from tessella.operators import mesh, order, validate
from tessella.sources.scratch import settle


@pytest.mark.parametrize("parts", [1, 7])
def test_ids_are_places_in_the_order_of_vertices(spark, parts, monkeypatch):
    """Even if every hash were the same: no two simplices share an id, and neighbours are those across the faces."""
    monkeypatch.setattr(mesh.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rng = np.random.default_rng(parts)
    points = spark.createDataFrame([(i + 1, *p) for i, p in enumerate(rng.random((120, 2)).tolist())], "id long, x double, y double")
    whole = settle(mesh.mesh_of(points, 2), "whole").repartition(parts)
    found = settle(mesh.with_neighbours(mesh.identified(whole)), "found")
    rows = sorted((r.id, list(r.v), list(r.nb)) for r in found.collect())
    assert [r[0] for r in rows] == list(range(len(rows))) and [r[1] for r in rows] == sorted(r[1] for r in rows)
    for i, v, nb in rows:
        for d, other in enumerate(nb):
            face = set(v) - {v[d]}
            assert [j for j, w, _ in rows if face <= set(w) and j != i] == ([] if other is None else [other])
    assert validate.verify(found, points, 2).count() == 0


def test_no_simplices(spark):
    assert mesh.with_neighbours(mesh.identified(spark.createDataFrame([], "v array<long>"))).collect() == []


@pytest.mark.parametrize("dim", [2, 3])
def test_the_curve_goes_from_cell_to_neighbouring_cell(spark, dim):
    cells = list(product(range(8), repeat=dim))
    points = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(cells)], "id long, " + ", ".join(f"{a} double" for a in axes(dim)))
    got = points.select("id", order.curve_key(axes(dim), [0.0] * dim, [7.0] * dim, 3).alias("k")).collect()
    assert sorted(r.k for r in got) == list(range(8**dim))
    path = np.array([cells[r.id] for r in sorted(got, key=lambda r: r.k)])
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_places(spark):
    points = spark.createDataFrame([(5, 0.0, 0.0), (3, 0.0, 0.0), (1, 9.0, 9.0), (2, 0.0, 9.0)], "id long, x double, y double")
    got = {r.id: r.place for r in order.spatial_places(points, 2).collect()}
    assert sorted(got.values()) == [0, 1, 2, 3] and got[3] == 0 and got[5] == 1
