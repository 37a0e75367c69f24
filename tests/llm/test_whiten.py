"""Whitening against numpy's eigenvectors and exact integers: edge rows, equal eigenvalues, few dimensions, large numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tessella.llm import whiten

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, x string, n int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], SCHEMA).repartition(3)


def check(rows, got, k=4):
    """rows: (vec_id, vector) of the usable rows."""
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    data = np.array([[float(Fraction(x[j]) - Fraction(sums[j], n)) for j in range(d)] for x in fit])
    e, v = np.linalg.eigh(data.T @ data / n)
    e, v = e[::-1], v[:, ::-1]
    own = min(k, int((e > 1e-12 * max(e[0], 0)).sum())) if e[0] > 0 else 0
    assert len(got) == own * len(rows)
    assert {r.n for r in got} <= {n}
    exact = sorted((i if i is not None else -1, c, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in xs for c in range(1, own + 1))
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.component, int(r.deviation)) for r in got) == exact
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(own):
        alone = min((abs(e[c] - o) for k2, o in enumerate(e) if k2 != c), default=1) > 1e-6 * e[0]
        mine = np.array([by[i, c + 1].whitened for i, _ in xs])
        real = np.array([[float(Fraction(x[j]) - Fraction(sums[j], n)) for j in range(d)] for _, x in xs]) @ v[:, c] / math.sqrt(e[c])
        if alone:
            assert min(abs(mine - real).max(), abs(mine + real).max()) < 1e-7
        assert all(abs(r.explained - e[c] / e.sum()) <= 1e-6 * e[c] / e.sum() for r in got if r.component == c + 1)
    assert all(r.identity_error < 1e-8 for r in got)


def test_on_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in table.collect()], whiten.op13(spark, SF).collect())


def test_edge_rows(spark):
    r = np.random.default_rng(4)
    good = [(k, r.normal(size=3).tolist()) for k in range(20)]
    good += [(3, good[3][1]), (3, good[3][1]), (None, good[5][1]), (50, [0.0, 0.0, 0.0]), (51, [-0.0, 0.001, 0.0])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 1.0]), (94, [float("inf"), 1.0, 1.0]), (95, [1.0, 2.0])]
    check(good, whiten.whiten(frame(spark, good + bad)).collect())


def test_copies_do_not_weigh(spark):
    rows = [(k, [float(k % 5), float(k * k % 7), float(k % 3)]) for k in range(15)]
    check(rows + [(100 + k, rows[2][1]) for k in range(200)], whiten.whiten(frame(spark, rows + [(100 + k, rows[2][1]) for k in range(200)])).collect())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_without_variance(spark, rows):
    assert whiten.whiten(frame(spark, rows)).collect() == []


def test_equal_eigenvalues_and_few_directions(spark):
    corners = [(2 * j + s, [0.0] * j + [1.0 - 2 * s] + [0.0] * (5 - j)) for j in range(6) for s in range(2)]
    check(corners, whiten.whiten(frame(spark, corners)).collect())
    line = [(k, [float(k), 2.0 * k, 0.0, 1.0, -k / 2]) for k in range(9)]
    check(line, whiten.whiten(frame(spark, line)).collect())


def test_exact_beyond_a_long(spark):
    rows = [(k, [2.0**40 * (k % 3 - 1), 2.0**39 * (k % 2), float(k)]) for k in range(6)]
    got = whiten.whiten(frame(spark, rows)).collect()
    check(rows, got)
    assert max(int(r.deviation) for r in got) > 1 << 63


@pytest.mark.parametrize("d,kept", [(40, 2), (150, 3), (150, 8)])
def test_restarts(d, kept):
    r = np.random.default_rng(d)
    turn = np.linalg.qr(r.normal(size=(d, d)))[0]
    value = np.concatenate([[9, 8.9, 8.8, 8.0], np.linspace(7, 0.1, d - 4)])
    got, axes, passes = whiten.components(lambda q: (turn * value) @ (turn.T @ q), d, 4, block_x=2, kept=kept)
    assert np.allclose(got, value[:4], rtol=1e-12) and passes < 100
    assert np.allclose(np.abs((turn[:, :4] * axes).sum(axis=0)), 1, atol=1e-9)
