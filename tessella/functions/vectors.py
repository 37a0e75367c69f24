"""Vector algebra on lists of columns, one column per coordinate."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]


def columns(names: str | list[str], prefix: str = "") -> Vector:
    return [F.col(prefix + n) for n in (names.split() if isinstance(names, str) else names)]


def axes(dim: int) -> list[str]:
    if dim not in (2, 3):
        raise ValueError("points have two or three coordinates")
    return ["x", "y", "z"][:dim]


def plus(a: Vector, b: Vector) -> Vector:
    return [p + q for p, q in zip(a, b)]


def minus(a: Vector, b: Vector) -> Vector:
    return [p - q for p, q in zip(a, b)]


def scale(a: Vector, s) -> Vector:
    return [p * s for p in a]


def negate(a: Vector) -> Vector:
    return [-p for p in a]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(add, [p * q for p, q in zip(a, b)])


def square_length(a: Vector) -> Column:
    return dot(a, a)


def length(a: Vector) -> Column:
    return F.sqrt(square_length(a))


def square_distance(a: Vector, b: Vector) -> Column:
    return square_length(minus(a, b))


def plane_distance(p: Vector, normal: Vector, offset) -> Column:
    """Signed: above zero on the side to which the normal points."""
    return dot(normal, p) - offset


def above_plane(p: Vector, normal: Vector, offset) -> Column:
    return plane_distance(p, normal, offset) > 0


def array_dot(a: Column, b: Column) -> Column:
    """The dot product of two array columns of any length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
