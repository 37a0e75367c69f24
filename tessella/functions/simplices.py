"""Predicates and measures of simplices as columns. Vertices are vectors; a simplex has one more than dimensions.

These are double-precision expressions; `tessella.operators.predicates` has exact signs.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.vectors import Vector, dot, minus, square_distance, square_length

#: Ids below zero are far points: -2^D to -1, in the order of their bit patterns.
MASK32 = 0xFFFFFFFF


def is_finite(id_: Column) -> Column:
    return id_ >= 0


def far_index(id_: Column, dim: int) -> Column:
    return id_.bitwiseAND(F.lit((1 << dim) - 1))


def _det2(a: Vector, b: Vector) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _det3(a: Vector, b: Vector, c: Vector) -> Column:
    return dot(a, cross(b, c))


def orientation(vertices: list[Vector]) -> Column:
    """Twice the signed area (above 0: counter-clockwise), or six times the volume (above 0: the last is below the others)."""
    last = vertices[-1]
    rows = [minus(v, last) for v in vertices[:-1]]
    return _det2(*rows) if len(rows) == 2 else _det3(*rows)


def in_sphere_value(vertices: list[Vector], p: Vector) -> Column:
    """The lifted determinant; its sign times the orientation's tells the side."""
    rows = [minus(v, p) for v in vertices]
    lifts = [square_length(r) for r in rows]
    if len(rows) == 3:
        a, b, c = rows
        return lifts[0] * _det2(b, c) + lifts[1] * _det2(c, a) + lifts[2] * _det2(a, b)
    a, b, c, d = rows
    return lifts[3] * _det3(a, b, c) - lifts[2] * _det3(a, b, d) + lifts[1] * _det3(a, c, d) - lifts[0] * _det3(b, c, d)


def in_sphere(vertices: list[Vector], p: Vector) -> Column:
    """Whatever the orientation; points on the sphere count as inside, and a flat simplex holds every point."""
    return F.signum(orientation(vertices)) * F.signum(in_sphere_value(vertices, p)) >= 0


def barycentric(vertices: list[Vector], p: Vector) -> list[Column]:
    """The shares of all vertices but the last, whose own is what is left to 1."""
    last = vertices[-1]
    rows, r = [minus(v, last) for v in vertices[:-1]], minus(p, last)
    det = _det2 if len(rows) == 2 else _det3
    whole = det(*rows)
    return [F.try_divide(det(*[r if k == j else row for k, row in enumerate(rows)]), whole) for j in range(len(rows))]


def in_simplex(vertices: list[Vector], p: Vector) -> Column:
    """The boundary counts as inside; a flat simplex holds nothing."""
    shares = barycentric(vertices, p)
    return F.coalesce(reduce(and_, [s >= 0 for s in shares]) & (reduce(add, shares) <= 1), F.lit(False))


def face_distance(face: list[Vector], p: Vector) -> Column:
    """The distance to the face's line or plane divided by the length of its normal; it only ranks faces."""
    if len(face) == 2:
        edge = minus(face[1], face[0])
        normal = [-edge[1], edge[0]]
    else:
        normal = cross(minus(face[1], face[0]), minus(face[2], face[0]))
    return F.try_divide(F.abs(dot(normal, minus(p, face[0]))), square_length(normal))


def circumsphere(vertices: list[Vector]) -> tuple[Vector, Column]:
    """Centre and squared radius, relative to the first vertex; a flat simplex has infinities or NaN."""
    first = vertices[0]
    rows = [minus(v, first) for v in vertices[1:]]
    half = [square_length(r) / 2 for r in rows]
    if len(rows) == 2:
        (a, b), whole = rows, _det2(*rows)
        centre = [F.try_divide(half[0] * b[1] - half[1] * a[1], whole), F.try_divide(half[1] * a[0] - half[0] * b[0], whole)]
    else:
        a, b, c = rows
        whole = _det3(a, b, c)
        sides = [cross(b, c), cross(c, a), cross(a, b)]
        centre = [F.try_divide(half[0] * sides[0][k] + half[1] * sides[1][k] + half[2] * sides[2][k], whole) for k in range(3)]
    centre = [F.coalesce(c, F.lit(float("nan"))) for c in centre]
    return [f + c for f, c in zip(first, centre)], square_length(centre)


def nearest_vertex(vertices: list[Vector], p: Vector) -> Column:
    """The place of the nearest vertex; the first of equals."""
    pairs = F.array(*[F.struct(square_distance(v, p).alias("d"), F.lit(k).alias("k")) for k, v in enumerate(vertices)])
    return F.array_min(pairs)["k"]


# --- sets of vertex ids, as sorted arrays ---


def sort_ids(v: Column) -> Column:
    """Finite ids rising, then far ids."""
    return F.transform(F.array_sort(F.transform(v, lambda i: F.struct((i < 0).alias("far"), i.alias("id")))), lambda s: s["id"])


def contains_id(v: Column, id_: Column) -> Column:
    return F.array_contains(v, id_)


def contains_all(v: Column, ids: Column) -> Column:
    return F.size(F.array_except(ids, v)) == 0


def contains_any(v: Column, ids: Column) -> Column:
    return F.arrays_overlap(v, ids)


def shared_vertices(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def is_neighbour(a: Column, b: Column, dim: int) -> Column:
    return shared_vertices(a, b) == dim


def rotated(id_: Column) -> Column:
    """An id's low 32 bits, rotated left by its low 5 bits."""
    low, by = id_.bitwiseAND(F.lit(MASK32)), id_.bitwiseAND(F.lit(31)).cast("int")
    left = F.call_function("shiftleft", low, by).bitwiseAND(F.lit(MASK32))
    return left.bitwiseOR(F.call_function("shiftrightunsigned", low, F.lit(32) - by))


def fingerprint(v: Column) -> Column:
    """A 32-bit mark of a vertex set in any order: a filter, never a proof of equality."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(rotated(i)))


def face_fingerprint(fp: Column, opposite: Column) -> Column:
    """The mark of the face opposite to a vertex; never 0."""
    return fp.bitwiseXOR(rotated(opposite)).bitwiseOR(F.lit(1).cast("long"))


def is_infinite(v: Column) -> Column:
    return F.exists(v, lambda i: i < 0)
