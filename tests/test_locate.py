"""Queries outside of a mesh have the nearest simplex, by brute force over all of its corners, edges and faces."""

from itertools import combinations

import numpy as np
import pytest

from tessella.operators import locate, mesh
from tessella.sources import points
from tessella.sources.scratch import settle


def gap(corners, p):
    """The distance to a simplex by least squares in each of its faces."""
    best = np.inf
    for size in range(1, len(corners) + 1):
        for face in combinations(corners, size):
            base = np.array(face[0])
            rest = np.array([q - base for q in face[1:]])
            w = np.linalg.lstsq(rest.T, p - base, rcond=None)[0] if size > 1 else np.zeros(0)
            if (w >= 0).all() and w.sum() <= 1:
                best = min(best, np.linalg.norm(p - base - (w @ rest if size > 1 else 0)))
    return best


@pytest.mark.parametrize("dim", [2, 3])
def test_the_nearest_simplex_of_outer_queries(spark, dim):
    rng = np.random.default_rng(8)
    at = rng.random((24, dim))
    own = spark.createDataFrame([(k + 1, *map(float, p)) for k, p in enumerate(at)], points.spatial_schema(dim))
    whole = settle(mesh.identified(mesh.mesh_of(own, dim)), "whole")
    asked = np.concatenate([rng.random((20, dim)), rng.normal(0.5, 2, (30, dim)), rng.normal(0, 300, (5, dim))])
    rows = [(k, *map(float, p)) for k, p in enumerate(asked)] + [(99, *[None] * dim), (98, *[float("nan")] * dim)]
    queries = spark.createDataFrame(rows, "qid long, " + ", ".join(f"{a} double" for a in "xyz"[:dim]))
    got = {r.qid: r.simplex_id for r in locate.locate(queries, whole, own, dim, 0.2).collect()}
    simplices = {r.id: [at[v - 1] for v in r.v] for r in whole.collect()}
    assert got.pop(99) is None and got.pop(98) is None and len(got) == len(asked)
    for k, p in enumerate(asked):
        gaps = {i: gap(c, p) for i, c in simplices.items()}
        least = min(gaps.values())
        ties = [i for i, d in gaps.items() if d <= least + 1e-9 * max(1, least)]
        assert got[k] == min(ties)
    assert {r.simplex_id for r in locate.locate(queries, whole.limit(0), own, dim, 0.2).collect()} == {None}


def test_cells_follow_the_density(spark, monkeypatch):
    """Many simplices within one cell of the given width are dealt to smaller ones; the result is the same."""
    rng = np.random.default_rng(3)
    own = spark.createDataFrame([(k + 1, *map(float, p)) for k, p in enumerate(rng.random((300, 2)))], points.spatial_schema(2))
    whole = settle(mesh.identified(mesh.mesh_of(own, 2)), "whole")
    queries = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rng.random((100, 2)))], "qid long, x double, y double")
    widths, cells = [], locate._cells
    monkeypatch.setattr(locate, "_cells", lambda placed, names, width: (widths.append(width), cells(placed, names, width))[1])
    got = {r.qid: r.simplex_id for r in locate.locate(queries, whole, own, 2, 5.0).collect()}
    assert widths[0] < 0.1
    monkeypatch.setattr(locate, "_fitted", lambda placed, names, width: width)
    assert got == {r.qid: r.simplex_id for r in locate.locate(queries, whole, own, 2, 5.0).collect()}
