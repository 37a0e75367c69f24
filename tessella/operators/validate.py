"""Mesh checks as queries: each returns what is wrong, no row if nothing is."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from operator import add, and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.simplices import in_sphere_value, orientation
from tessella.functions.vectors import axes, minus, square_length
from tessella.operators.mesh import faces, with_coordinates
from tessella.operators.predicates import exact_in_sphere, exact_orient
from tessella.sources.scratch import settle

#: A value's rounding error is below this share of the sum of its absolute terms (an upper bound in all dimensions), and a little for underflow.
ROUNDING, TINY = 1e-14, 1e-280


def duplicates(simplices: DataFrame) -> DataFrame:
    twice = simplices.groupBy("v").agg(F.min("id").alias("simplex_id"), F.max("id").alias("other_id"), F.count("*").alias("n")).where("n > 1")
    return twice.select(F.lit("duplicate").alias("kind"), "simplex_id", "other_id")


def wrong_neighbours(simplices: DataFrame) -> DataFrame:
    """Simplices with a common face that don't name each other, and neighbours that share no face."""
    shared = faces(simplices).groupBy("face").agg(F.sort_array(F.collect_list("id")).alias("ids")).where("size(ids) > 1")
    pairs = shared.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a <> b").distinct()
    named = simplices.select(F.col("id").alias("a"), F.explode("nb").alias("b")).where("b is not null").distinct()
    wrong = pairs.join(named, ["a", "b"], "left_anti").unionByName(named.join(pairs, ["a", "b"], "left_anti"))
    return wrong.select(F.lit("neighbour").alias("kind"), F.col("a").alias("simplex_id"), F.col("b").alias("other_id"))


def _size(rows: list[list[Column]]) -> Column:
    """The sum of the absolute terms of a determinant, from the absolute entries of its rows."""
    if len(rows) == 1:
        return rows[0][0]
    return reduce(add, [rows[0][k] * _size([[c for j, c in enumerate(r) if j != k] for r in rows[1:]]) for k in range(len(rows))])


#: A name of a sign, its value, the sum of its absolute terms, and its exact sign from the places.
Sign = tuple[str, Column, Column, Callable[[list[tuple[float, ...]]], int]]


def _faulty(rows: DataFrame, signs: list[Sign], fault: Column) -> DataFrame:
    """The rows(..., places) for which `fault`, an expression over the signs, holds.

    Values tell where their error bounds allow. Rows that are surely sound go at once; what is left is written, and its
    doubtful rows alone leave the JVM for exact signs.
    """
    for name, value, size, _ in signs:
        rows = rows.withColumns({"value": value, "size": size})
        sure = (F.abs("value") > F.col("size") * ROUNDING + TINY) & (F.abs("value") < float("inf"))
        rows = rows.withColumn(name, F.when(sure, F.signum("value").cast("int"))).drop("value", "size")
    names = [name for name, *_ in signs]
    left = settle(rows.where(F.coalesce(fault, F.lit(True))), "doubtful")
    known = reduce(and_, [F.col(n).isNotNull() for n in names])
    exacts, n = [exact for *_, exact in signs], len(names)

    def run(batches):
        for batch in batches:
            places = [[tuple(p) for p in own] for own in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-n], *[pa.array([exact(p) for p in places], pa.int32()) for exact in exacts]], batch.schema.names)

    return left.where(known).unionByName(left.where(~known).mapInArrow(run, left.schema)).where(fault)


def _place(column: str, dim: int) -> Column:
    return F.array(*[F.col(column)[a] for a in axes(dim)])


def _vectors(dim: int, n: int) -> list[list[Column]]:
    return [[F.col("places")[k][d] for d in range(dim)] for k in range(n)]


def _orientation(name: str, dim: int, chosen: list[int]) -> Sign:
    """The sign of the orientation of the chosen places."""
    own = [_vectors(dim, dim + 2)[k] for k in chosen]
    return name, orientation(own), _size([[F.abs(c) for c in minus(v, own[-1])] for v in own[:-1]]), lambda p: exact_orient([p[k] for k in chosen])


def filled_spheres(simplices: DataFrame, points: DataFrame, dim: int, strict: bool = False) -> DataFrame:
    """Simplices whose sphere holds the opposite vertex of a neighbour; with strict, also on the sphere. Signs are exact."""
    own = with_coordinates(simplices, points, dim).select("id", "v", "nb", "at")
    pairs = own.select("id", "v", "at", F.explode("nb").alias("nb")).where("nb is not null")
    other = simplices.select(F.col("id").alias("nb"), F.col("v").alias("w"))
    ends = pairs.join(other, "nb").select("id", "nb", "at", F.element_at(F.array_except("w", "v"), 1).alias("p"))
    placed = ends.join(points.select(F.col("id").alias("p"), F.struct(*axes(dim)).alias("q")), "p")
    at = F.transform("at", lambda c: F.array(*[c[a] for a in axes(dim)]))
    rows = placed.select("id", "nb", F.concat(at, F.array(_place("q", dim))).alias("places"))
    *vertices, q = _vectors(dim, dim + 2)
    lifted = [[*[F.abs(c) for c in minus(v, q)], square_length(minus(v, q))] for v in vertices]
    sphere = "side", in_sphere_value(vertices, q), _size(lifted), lambda p: exact_in_sphere(p[:-1], p[-1])
    side = F.col("turn") * F.col("side")
    found = _faulty(rows, [_orientation("turn", dim, list(range(dim + 1))), sphere], side >= 0 if strict else side > 0)
    return found.select(F.lit("sphere").alias("kind"), F.col("id").alias("simplex_id"), F.col("nb").alias("other_id"))


def _hull(simplices: DataFrame) -> DataFrame:
    """(face, id, opposite) of faces that one simplex has alone."""
    own = faces(simplices.select("id", "v")).groupBy("face").agg(F.min("id").alias("id"), F.min("opposite").alias("opposite"), F.count("*").alias("n"))
    return own.where("n = 1").drop("n")


def open_ridges(simplices: DataFrame) -> DataFrame:
    """Ridges of the hull (its vertices in 2-D, its edges in 3-D) that aren't shared by two faces of it: it isn't a closed surface."""
    own = _hull(simplices).select("id", "face", F.explode("face").alias("p")).select("id", F.array_except("face", F.array("p")).alias("ridge"))
    found = own.groupBy("ridge").agg(F.min("id").alias("simplex_id"), F.max("id").alias("other_id"), F.count("*").alias("n"))
    return found.where("n <> 2").select(F.lit("ridge").alias("kind"), "simplex_id", "other_id")


def dented_hull(simplices: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    """Faces of the hull with a vertex of a face beside them on their outer side. Signs are exact.

    A closed surface whose faces are all convex to those beside them is convex, so no face is compared with all points: faces
    meet on their ridges.
    """
    own = _hull(simplices).select("id", "face", "opposite", F.explode("face").alias("p"))
    own = own.select("id", "face", "opposite", "p", F.array_except("face", F.array("p")).alias("ridge"))
    other = own.select("ridge", F.col("id").alias("other_id"), F.col("face").alias("beside"), F.col("p").alias("q"))
    pairs = own.join(other, "ridge").where("face <> beside").select("id", "other_id", F.concat("face", F.array("opposite", "q")).alias("v"))
    numbered = pairs.withColumn("row", F.struct("id", "other_id", "v"))
    each = numbered.select("row", F.posexplode("v").alias("d", "p")).join(points.select(F.col("id").alias("p"), F.array(*axes(dim)).alias("c")), "p")
    placed = each.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("places")).where(F.size("places") == dim + 2)
    signs = [_orientation("inner", dim, list(range(dim + 1))), _orientation("outer", dim, [*range(dim), dim + 1])]
    found = _faulty(placed.select("row.id", "row.other_id", "places"), signs, F.col("inner") * F.col("outer") < 0)
    return found.select(F.lit("hull").alias("kind"), F.col("id").alias("simplex_id"), "other_id")


def euler_number(simplices: DataFrame, dim: int) -> DataFrame:
    """(n): vertices - edges + faces - ... of the mesh, each counted once: 1 if it is in one piece without holes."""
    kinds = F.array(*[F.array(*[F.col("v")[k] for k in some]) for n in range(1, dim + 2) for some in combinations(range(dim + 1), n)])
    cells = simplices.select(F.explode(kinds).alias("cell")).distinct()
    return cells.agg(F.sum(F.when(F.size("cell") % 2 == 1, 1).otherwise(-1)).alias("n"))


def wrong_euler_number(simplices: DataFrame, dim: int) -> DataFrame:
    """A row with the number as other_id, if it isn't 1."""
    return euler_number(simplices, dim).where("n <> 1").select(F.lit("euler").alias("kind"), F.lit(None).cast("long").alias("simplex_id"), F.col("n").alias("other_id"))


def unused_points(simplices: DataFrame, points: DataFrame) -> DataFrame:
    used = simplices.select(F.explode("v").alias("id")).distinct()
    return points.select("id").join(used, "id", "left_anti").select(F.lit("unused").alias("kind"), F.col("id").alias("simplex_id"), F.lit(None).cast("long").alias("other_id"))


def foreign_points(simplices: DataFrame, points: DataFrame) -> DataFrame:
    used = simplices.select("id", F.explode("v").alias("p"))
    return used.join(points.select(F.col("id").alias("p")), "p", "left_anti").select(F.lit("foreign").alias("kind"), F.col("id").alias("simplex_id"), F.col("p").alias("other_id"))


def verify(simplices: DataFrame, points: DataFrame, dim: int, strict: bool = False) -> DataFrame:
    """violations(kind, simplex_id, other_id) of simplices(id, v, nb) over the points that they should use."""
    hull = [open_ridges(simplices), dented_hull(simplices, points, dim), wrong_euler_number(simplices, dim)]
    used = [unused_points(simplices, points), foreign_points(simplices, points)]
    checks = [duplicates(simplices), wrong_neighbours(simplices), filled_spheres(simplices, points, dim, strict), *hull, *used]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def cross_check(mine: DataFrame, real: DataFrame) -> DataFrame:
    """(kind, v): simplices that are missing or invalid, and those whose neighbours differ."""
    missing = real.select("v").join(mine.select("v"), "v", "left_anti").select(F.lit("missing").alias("kind"), "v")
    invalid = mine.select("v").join(real.select("v"), "v", "left_anti").select(F.lit("invalid").alias("kind"), "v")

    def around(s: DataFrame) -> DataFrame:
        pairs = s.select("v", F.explode("nb").alias("nb")).join(s.select(F.col("id").alias("nb"), F.col("v").alias("w")), "nb", "left")
        return pairs.groupBy("v").agg(F.sort_array(F.collect_list("w")).alias("around"))

    both = around(mine).join(around(real).withColumnRenamed("around", "others"), "v")
    return missing.unionByName(invalid).unionByName(both.where(~F.col("around").eqNullSafe(F.col("others"))).select(F.lit("neighbour").alias("kind"), "v"))
