"""Point generators. The contract is distribution, bounds, count and determinism under a seed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.vectors import axes

Bounds = tuple[list[float], list[float]]
TRIES = 64


def _hash01(seed: int, *keys) -> Column:
    """A uniform number in (0, 1) that depends on seed and keys alone, not on partitions."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def _normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(_hash01(seed, *keys))) * F.cos(2 * np.pi * _hash01(seed + 7919, *keys))


def _within(value: Callable[[Column], list[Column]], low: list, high: list) -> Column:
    """The first try whose coordinates are all within bounds; after TRIES the last, clamped.

    The first try is an expression of its own; the rest are made, in a higher-order function, only where it fails.
    """
    low, high = ([x if isinstance(x, Column) else F.lit(float(x)) for x in side] for side in (low, high))
    fine = lambda p: reduce(lambda a, b: a & b, [p[d].between(lo, hi) for d, (lo, hi) in enumerate(zip(low, high))])
    first = F.array(*value(F.lit(0)))
    rest = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIES)), lambda t: F.array(*value(t))), fine), F.lit(0))
    last = F.array(*[F.least(F.greatest(x, lo), hi) for x, lo, hi in zip(value(F.lit(TRIES)), low, high)])
    return F.when(fine(first), first).otherwise(F.coalesce(rest, last))


def _table(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1)


def _unpack(df: DataFrame, dim: int) -> DataFrame:
    return df.select("id", *[F.col("p")[k].alias(a) for k, a in enumerate(axes(dim))])


def uniform(spark, n: int, bounds: Bounds, seed: int = 1986) -> DataFrame:
    low, high = bounds
    value = [(lo + (hi - lo) * _hash01(seed + d, "id")).alias(a) for d, (a, lo, hi) in enumerate(zip(axes(len(low)), low, high))]
    return _table(spark, n).select("id", *value)


def normal(spark, n: int, bounds: Bounds, seed: int = 1986) -> DataFrame:
    """Around the middle with half the span as deviation, drawn again until inside."""
    low, high = map(np.array, bounds)
    value = lambda t: [float(m) + 0.5 * float(s) * _normal(seed + d, "id", t) for d, (m, s) in enumerate(zip((low + high) / 2, high - low))]
    return _unpack(_table(spark, n).select("id", _within(value, bounds[0], bounds[1]).alias("p")), len(low))


def bubble(spark, n: int, bounds: Bounds, seed: int = 1986) -> DataFrame:
    """A normal bubble in each of the 2^D orthants of the bounds; what doesn't divide goes to the last."""
    low, high = map(np.array, bounds)
    dim = len(low)
    which = F.least(F.floor((F.col("id") - 1) / max(1, n // (1 << dim))), F.lit((1 << dim) - 1)).cast("int")
    span = (high - low) / 2

    def value(t):
        out = []
        for d in range(dim):
            middle = F.when(which.bitwiseAND(1 << d) > 0, float(low[d] + 1.5 * span[d])).otherwise(float(low[d] + 0.5 * span[d]))
            out.append(middle + 0.5 * float(span[d]) * _normal(seed + d, "id", t))
        return out

    return _unpack(_table(spark, n).select("id", _within(value, bounds[0], bounds[1]).alias("p")), dim)


def ellipsoid(spark, n: int, bounds: Bounds, seed: int = 1986) -> DataFrame:
    """On the surface of an ellipsoid with 0.45 of the spans as axes."""
    low, high = map(np.array, bounds)
    dim = len(low)
    drawn = _table(spark, n).select("id", *[_normal(seed + d, "id").alias(f"g{d}") for d in range(dim)])
    size = F.sqrt(reduce(add, [F.col(f"g{d}") * F.col(f"g{d}") for d in range(dim)]))
    return drawn.select("id", *[(float((low[d] + high[d]) / 2) + 0.45 * float(high[d] - low[d]) * F.col(f"g{d}") / size).alias(a) for d, a in enumerate(axes(dim))])


def skew_lines(spark, n: int, bounds: Bounds, seed: int = 1986, skew: float = 0.1) -> DataFrame:
    """Two lines; points 2k-1 and 2k have one parameter."""
    low, high = map(np.array, bounds)
    dim, r = len(low), _hash01(seed, F.floor((F.col("id") + 1) / 2))
    first = F.col("id") % 2 == 1
    value = []
    for d, a in enumerate(axes(dim)):
        lo, span = float(low[d]), float(high[d] - low[d])
        one = lo + span * (r if d == 0 else F.lit(skew if d == 1 else 0.25))
        two = lo + span * ((skew + (1 - 2 * skew) * r) if d == 0 else ((1 - skew - skew * r) if d == 1 else F.lit(0.75)))
        value.append(F.when(first, one).otherwise(two).alias(a))
    return _table(spark, n).select("id", *value)


def _in_bubbles(spark, n: int, bounds: Bounds, seed: int, centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray, kind: str) -> DataFrame:
    """Points around a small list of centres, dealt by runs of ids."""
    dim = centres.shape[1]
    ends = np.cumsum(sizes)
    at = F.least(F.size(F.filter(F.lit([int(e) for e in ends]), lambda e: e < F.col("id"))), F.lit(len(ends) - 1))
    drawn = _table(spark, n).select("id", at.alias("b"))
    pick = lambda values: F.element_at(F.lit([float(v) for v in values]), F.col("b") + 1)
    r = pick(radii)

    def value(t):
        if kind == "uniform":
            return [pick(centres[:, d]) + r * (2 * _hash01(seed + d, "id", t) - 1) for d in range(dim)]
        return [pick(centres[:, d]) + 0.5 * r * _normal(seed + d, "id", t) for d in range(dim)]

    low = [F.greatest(pick(centres[:, d]) - r, F.lit(bounds[0][d])) for d in range(dim)]
    high = [F.least(pick(centres[:, d]) + r, F.lit(bounds[1][d])) for d in range(dim)]
    return _unpack(drawn.select("id", _within(value, low, high).alias("p")), dim)


def _gaps(centres: np.ndarray, bounds: Bounds) -> np.ndarray:
    """The least distance of each centre to another one or to the bounds."""
    low, high = map(np.array, bounds)
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    return np.minimum(apart.min(1), np.minimum(centres - low, high - centres).min(1))


def patch_bubble(spark, n: int, bounds: Bounds, seed: int = 1986, num_bubbles: int | None = None) -> DataFrame:
    low, high = map(np.array, bounds)
    k, rng = num_bubbles or 4 ** len(low), np.random.default_rng(seed)
    centres, left, sizes = rng.uniform(low, high, (k, len(low))), n, []
    for b in range(k):
        own = left if b == k - 1 else min(left, max(0, round(left / (k - b) * rng.normal(1, 0.1))))
        sizes.append(own)
        left -= own
    return _in_bubbles(spark, n, bounds, seed, centres, _gaps(centres, bounds) / 2, np.array(sizes), "normal")


def malicious_bubble(spark, n: int, bounds: Bounds, seed: int = 1986, num_bubbles: int | None = None) -> DataFrame:
    """Small bubbles on a lattice that begins at the lower corner."""
    low, high = map(np.array, bounds)
    dim = len(low)
    side = max(1, round((num_bubbles or 4**dim) ** (1 / dim)))
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dim, indexing="ij"), -1).reshape(-1, dim)
    centres, step = low + grid * (high - low) / side, (high - low).min() / side
    sizes = np.full(len(centres), n // len(centres))
    sizes[-1] += n - sizes.sum()
    return _in_bubbles(spark, n, bounds, seed, centres, np.full(len(centres), step / 4), sizes, "normal")


def unbound_bubble(spark, n: int, bounds: Bounds, seed: int = 1986, num_bubbles: int | None = None, radius: float = 10.0) -> DataFrame:
    """Uniform cubes around random centres; they may overlap."""
    low, high = map(np.array, bounds)
    k, rng = num_bubbles or 4 ** len(low), np.random.default_rng(seed)
    radius = min(radius, float((high - low).min()) / 2)
    centres = rng.uniform(low + radius, high - radius, (k, len(low)))
    sizes = np.full(k, n // k)
    sizes[-1] += n - sizes.sum()
    return _in_bubbles(spark, n, bounds, seed, centres, np.full(k, radius), sizes, "uniform")


#: By short and by long name.
GENERATORS: dict[str, Callable[..., DataFrame]] = {
    "u": uniform, "n": normal, "b": bubble, "e": ellipsoid, "l": skew_lines,
    "uniform": uniform, "normal": normal, "bubble": bubble, "ellipsoid": ellipsoid, "skew-line": skew_lines,
    "patch-bubble": patch_bubble, "malicious-bubble": malicious_bubble, "unbound-bubble": unbound_bubble,
}


def generate(spark: SparkSession, kind: str, n: int, bounds: Bounds, seed: int = 1986, spatial_ids: bool = False, **options) -> DataFrame:
    """points(id, x, y[, z]) with ids 1 to n; with spatial_ids they rise along a space-filling curve."""
    if kind not in GENERATORS:
        raise ValueError(f"unknown generator {kind!r}")
    points = GENERATORS[kind](spark, n, bounds, seed, **options)
    if not spatial_ids:
        return points
    from tessella.operators.order import renumber_along_curve

    return renumber_along_curve(points, len(bounds[0]), bounds)
