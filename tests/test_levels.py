"""Joins by levels of grid cells against all pairs, and the border checks with very many parts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.vectors import axes
from tessella.operators import checkers, mesh
from tessella.operators.levels import meeting
from tessella.sources.scratch import settle


def boxes(spark, side, dim, seed, n):
    r = np.random.default_rng(seed)
    low = r.uniform(-50, 50, (n, dim))
    wide = np.where(r.random((n, 1)) < 0.1, 0, 10.0 ** r.uniform(-6, 2.5, (n, dim)))
    low[:5], wide[:5] = np.round(low[:5]), 2.0 ** np.arange(5)[:, None]  # on the cells' borders
    rows = [(i, *itertools.chain(*zip(map(float, a), map(float, a + w)))) for i, (a, w) in enumerate(zip(low, wide))]
    cols = [f"{side}{e}_{k} double" for k in range(dim) for e in ("lo", "hi")]
    odd = [(n, *[None] * (2 * dim)), (n + 1, *[float("inf")] * (2 * dim)), (n + 2, *[float("nan")] * (2 * dim))]
    return rows, spark.createDataFrame(rows + odd, f"{side} long, {', '.join(cols)}")


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_all_pairs_once(spark, dim):
    a, x = boxes(spark, "a", dim, 1, 120)
    b, y = boxes(spark, "b", dim, 2, 90)
    a += [(900, *b[0][1:])]
    x = x.unionByName(spark.createDataFrame(a[-1:], x.schema))
    want = sorted((p[0], q[0]) for p in a for q in b if all(p[1 + 2 * k] <= q[2 + 2 * k] and q[1 + 2 * k] <= p[2 + 2 * k] for k in range(dim)))
    assert sorted((r.a, r.b) for r in meeting(x, y, dim).collect()) == want
    assert meeting(x.limit(0), y, dim).count() == 0


def parted(spark, dim, n, parts, seed=3):
    r = np.random.default_rng(seed)
    at = r.random((n, dim)) * 100
    part = (at[:, 0] * parts / 100).astype(int)
    return spark.createDataFrame([(i + 1, *map(float, p), str(k)) for i, (p, k) in enumerate(zip(at, part))], ", ".join(["id long", *[f"{a} double" for a in axes(dim)], "part string"]))


@pytest.mark.parametrize("checker", ["bounds", "grid", "accurate-grid"])
def test_border_by_levels(spark, checker, monkeypatch):
    own = settle(parted(spark, 2, 400, 12), "parted")
    flat = spark.createDataFrame([("3", "s", [1, 2, 3], [1.0, 2.0], float("inf")), ("4", "s", [4, 5, 6], [1.0, 2.0], float("nan"))], mesh.PIECE)
    pieces = settle(mesh.local_meshes(own, 2).unionByName(flat), "pieces")
    found = []
    for most in (100, 0):
        fixed = {"bounds": checkers.edge_by_bounds, "grid": checkers.edge_by_grid, "accurate-grid": checkers.edge_by_points}[checker]
        width = () if checker == "bounds" else (9.0,)
        found.append(sorted((r.part, tuple(r.v)) for r in fixed(pieces.where("kind = 's'"), own, 2, *width, most_parts=most).collect()))
    assert found[0] == found[1] and len(found[0]) > 20
    assert {("3", (1, 2, 3)), ("4", (4, 5, 6))} <= set(found[0])


def test_ten_thousand_parts_without_a_nested_loop(spark, capsys):
    own = settle(spark.range(1, 20_001).select("id", F.rand(1).alias("x"), F.rand(2).alias("y")).withColumn("part", F.concat_ws(".", F.floor(F.col("x") * 100), F.floor(F.col("y") * 100))), "many")
    spheres = settle(own.where("id % 4 = 0").select("part", F.lit("s").alias("kind"), F.array("id").alias("v"), F.array("x", "y").alias("centre"), F.pow(F.rand(3) * 0.01, 2).alias("square_radius")), "spheres")
    assert own.select("part").distinct().count() > 8000
    edge = checkers.edge_by_bounds(spheres, own, 2)
    edge.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.v[0] for r in edge.collect()}
    at = own.toPandas()
    box = at.groupby("part").agg(lx=("x", "min"), hx=("x", "max"), ly=("y", "min"), hy=("y", "max"))
    rows = spheres.toPandas()
    for r in rows.sample(300, random_state=1).itertuples():
        gap = np.maximum(0, np.maximum(box.lx - r.centre[0], r.centre[0] - box.hx)) ** 2 + np.maximum(0, np.maximum(box.ly - r.centre[1], r.centre[1] - box.hy)) ** 2
        assert ((gap <= r.square_radius) & (box.index != r.part)).any() == (r.v[0] in got)
