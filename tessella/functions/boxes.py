"""Closed axis-aligned boxes: a box is a pair of vectors, its lower and its upper corner."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import Vector, square_length

Box = tuple[Vector, Vector]


def box_columns(axes: list[str], prefix: str = "") -> Box:
    return [F.col(f"{prefix}lo_{a}") for a in axes], [F.col(f"{prefix}hi_{a}") for a in axes]


def contains_point(box: Box, p: Vector) -> Column:
    return reduce(and_, [x.between(lo, hi) for lo, hi, x in zip(*box, p)])


def contains_box(outer: Box, inner: Box) -> Column:
    return reduce(and_, [(a <= c) & (d <= b) for a, b, c, d in zip(*outer, *inner)])


def contains_sphere(box: Box, centre: Vector, square_radius: Column) -> Column:
    """The centre is inside and no face is nearer than the radius."""
    faces = [F.least((c - lo) * (c - lo), (hi - c) * (hi - c)) >= square_radius for lo, hi, c in zip(*box, centre)]
    return contains_point(box, centre) & reduce(and_, faces)


def square_gap(box: Box, p: Vector) -> Column:
    """Squared distance to the nearest point of the box; 0 inside."""
    zero = F.lit(0.0)
    gaps = [F.greatest(lo - x, zero) + F.greatest(x - hi, zero) for lo, hi, x in zip(*box, p)]
    return reduce(add, [g * g for g in gaps])


def intersects_sphere(box: Box, centre: Vector, square_radius: Column) -> Column:
    """Touching counts. A sphere whose numbers aren't finite (of a flat simplex) reaches everywhere."""
    odd = reduce(lambda a, b: a | b, [F.isnan(v) | (F.abs(v) == float("inf")) for v in [*centre, square_radius]])
    return odd | (square_gap(box, centre) <= square_radius)


def gap_vector(box: Box, p: Vector) -> Vector:
    """From the point to the nearest point of the box; zero inside."""
    return [F.when(x < lo, lo - x).when(x > hi, hi - x).otherwise(F.lit(0.0)) for lo, hi, x in zip(*box, p)]


def boundary_distance(box: Box, p: Vector) -> Column:
    """To the nearest face for a point inside, to the box for one outside."""
    inside = F.least(*[F.least(x - lo, hi - x) for lo, hi, x in zip(*box, p)])
    return F.when(contains_point(box, p), inside).otherwise(F.sqrt(square_length(gap_vector(box, p))))


def subtract(a: Box, b: Box) -> Box:
    """What is left of a without b, which must differ from it in one face and lie inside; an error otherwise."""
    changed = reduce(add, [(lo != lo2).cast("int") + (hi != hi2).cast("int") for lo, hi, lo2, hi2 in zip(*a, *b)])
    fine = (changed == 1) & contains_box(a, b)
    checked = lambda value: F.when(fine, value).otherwise(F.raise_error(F.lit("the boxes must differ in one face")).cast("double"))
    low = [checked(F.when((lo == lo2) & (hi != hi2), hi2).otherwise(lo)) for lo, hi, lo2, hi2 in zip(*a, *b)]
    high = [checked(F.when((lo != lo2) & (hi == hi2), lo2).otherwise(hi)) for lo, hi, lo2, hi2 in zip(*a, *b)]
    return low, high


def split(box: Box, dim: int, at) -> tuple[Box, Box]:
    low, high = box
    return (low, [at if d == dim else h for d, h in enumerate(high)]), ([at if d == dim else v for d, v in enumerate(low)], high)


def enlarge(box: Box, p: Vector) -> Box:
    return [F.least(lo, x) for lo, x in zip(box[0], p)], [F.greatest(hi, x) for hi, x in zip(box[1], p)]


def bounding_boxes(points: DataFrame, axes: list[str], *by: str) -> DataFrame:
    """lo_ and hi_ columns per group; no row for no points."""
    ends = [f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return points.groupBy(*by).agg(*ends)
