"""Nearest neighbours by a k-d tree, against brute force."""

import numpy as np
import pytest

from tessella.functions.vectors import axes
from tessella.operators import locate, nearest_tree
from tessella.operators.nearest_tree import KdTree


def gaps(x, low, high):
    return sum((np.maximum(low[None, :, d] - x[:, None, d], 0) + np.maximum(x[:, None, d] - high[None, :, d], 0)) ** 2 for d in range(x.shape[1]))


@pytest.mark.parametrize("dim", [2, 3])
@pytest.mark.parametrize("kind", ["uniform", "grid", "copies", "line", "boxes", "one"])
def test_tree_finds_the_first_of_the_nearest(dim, kind):
    rng = np.random.default_rng(dim)
    at, x = rng.random((3000, dim)), rng.random((500, dim)) * 1.4 - 0.2
    if kind == "grid":
        at, x = rng.integers(0, 12, (3000, dim)).astype(float), rng.integers(-2, 26, (500, dim)) / 2
    elif kind == "copies":
        at[500:2500] = at[7]
    elif kind == "line":
        at[:, 1:] = 0.5
    elif kind == "one":
        at = at[:1]
    high = at + rng.random(at.shape) * 0.05 * (kind == "boxes")
    square, item, compared = KdTree(at, high).nearest(x)
    want = gaps(x, at, high)
    assert (item == want.argmin(1)).all() and (square == want.min(1)).all()
    if kind == "uniform":
        assert compared < 0.1 * len(x) * len(at)


def test_points_as_far_from_all_items():
    turn = np.linspace(0, 2 * np.pi, 70_000, endpoint=False)
    ring = np.stack([np.cos(turn), np.sin(turn)], 1)
    x = np.zeros((200, 2))
    _, item, _ = KdTree(ring, ring).nearest(x)
    assert (item == gaps(x[:1], ring, ring).argmin()).all()


def test_points_that_are_not_finite():
    tree = KdTree(np.array([[3.0, 3.0], [1.0, 1.0]]), np.array([[3.0, 3.0], [1.0, 1.0]]))
    assert tree.nearest(np.array([[np.nan, 1.0], [1.0, 1.0], [np.inf, 0.0]]))[1].tolist() == [0, 1, 0]
    assert KdTree(np.zeros((0, 2)), np.zeros((0, 2))).nearest(np.zeros((2, 2)))[0].tolist() == [np.inf, np.inf]


@pytest.mark.parametrize("most", [10_000, 50])
@pytest.mark.parametrize("dim", [2, 3])
def test_nearest_sample(spark, monkeypatch, dim, most):
    """Broadcast, and dealt to cells with several tasks for those that hold many points."""
    monkeypatch.setattr(nearest_tree, "CELL_ROWS", 40)
    monkeypatch.setattr(nearest_tree.by_cells, "__defaults__", (40,))
    monkeypatch.setattr(nearest_tree, "GROUP_POINTS", 100)
    rng, names = np.random.default_rng(3), axes(dim)
    at, x = rng.random((600, dim)).round(2), (rng.random((1500, dim)) * 1.5 - 0.25).round(2)
    x[:600] = x[:600] * 0.02 + 0.4
    rows = [(i, *p) for i, p in enumerate(x.tolist())] + [(9000, None, *[0.0] * (dim - 1)), (9001, float("nan"), *[0.0] * (dim - 1))]
    place = ", ".join(f"{a} double" for a in names)
    points = spark.createDataFrame(rows, f"id long, {place}").repartition(5)
    sample = spark.createDataFrame([(i, *p, f"p{i % 7}") for i, p in enumerate(at.tolist())], f"idx long, {place}, part string")
    got = {r.id: (r.idx, r.part) for r in locate.nearest_sample(points, sample, dim, most).collect()}
    want = gaps(x, at, at).argmin(1).tolist()
    assert got == {i: (w, f"p{w % 7}") for i, w in enumerate(want)} | {9000: (0, "p0"), 9001: (0, "p0")}
    none = locate.nearest_sample(points, sample.limit(0), dim, most).collect()
    assert len(none) == 1502 and all(r.idx is None and r.part is None for r in none)


def test_a_larger_sample_is_shuffled_whole_to_cells(spark, monkeypatch):
    points = spark.createDataFrame([(1, 0.1, 0.9)], "id long, x double, y double")
    sample = spark.createDataFrame([(i, i / 500, 1 - i / 500, i % 3) for i in range(500)], "idx long, x double, y double, part int")
    out = nearest_tree.by_cells(points, sample.unionByName(sample.where("idx = 50")), 2, 20)
    assert [tuple(r) for r in out.collect()] == [(1, 50, 2)]
    assert nearest_tree.by_cells(points, sample.limit(0), 2).collect()[0][1:] == (None, None)


@pytest.mark.parametrize("most", [200, 10])
def test_many_centres_and_boxes(spark, most):
    rng = np.random.default_rng(4)
    low, x = rng.random((60, 2)), rng.random((300, 2)) * 2 - 0.5
    high = low + 0.1 * rng.random((60, 2))
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(x.tolist())], "id long, x double, y double")
    boxes = spark.createDataFrame([(f"{i:03}", *a, *b) for i, (a, b) in enumerate(zip(low.tolist(), high.tolist()))], "part string, lo_x double, lo_y double, hi_x double, hi_y double")
    got = {r.id: int(r.part) for r in locate.nearest_box(points, boxes, 2, most).collect()}
    assert [got[i] for i in range(300)] == gaps(x, low, high).argmin(1).tolist()
    centres = boxes.selectExpr("part", "lo_x x", "lo_y y")
    got = {r.id: int(r.part) for r in locate.nearest_centre(points, centres, 2, most).collect()}
    assert [got[i] for i in range(300)] == gaps(x, low, low).argmin(1).tolist()
