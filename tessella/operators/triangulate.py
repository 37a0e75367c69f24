"""Distributed meshes by divide and conquer: mesh each part, mesh again what lies at the borders, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import axes
from tessella.operators.checkers import edge_simplices
from tessella.operators.mesh import distinct_points, identified, local_meshes, with_neighbours
from tessella.operators.partition import assign, depth_within, flatten
from tessella.operators.tree import SKEW_LEVELS, merged, with_far
from tessella.sources.points import far_points
from tessella.sources.scratch import settle

#: Points that one task meshes; more at the borders are parted again.
TASK_POINTS = 50_000
MOST_LEVELS = 8


def spanning(simplices: DataFrame, assigned: DataFrame) -> DataFrame:
    """(v) of the simplices whose vertices lie in more than one part; a far vertex lies in every part."""
    ends = simplices.select("v", F.explode("v").alias("id"))
    homes = ends.join(assigned.select("id", "part"), "id").groupBy("v").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    return homes.where("a <> b").select("v")


def merge(pieces: DataFrame, edge: DataFrame, edge_mesh: DataFrame, assigned: DataFrame) -> DataFrame:
    """simplices(v): those of the parts that no other part can change, and those of the border mesh that span parts
    or that a part had already."""
    dropped = edge.select("v")
    inner = pieces.where("kind = 's'").select("v").join(dropped, "v", "left_anti")
    again = edge_mesh.join(dropped, "v", "left_semi")
    return inner.unionByName(spanning(edge_mesh, assigned)).unionByName(again).distinct()


def mesh_parts(assigned: DataFrame, dim: int, checker: str = "bounds", width: float | None = None, task_points: int = TASK_POINTS, level: int = 0) -> DataFrame:
    """simplices(v) of points(id, x, ..., part), the same as of all points in one task.

    With the checker `bounds` parts are merged bottom-up by a tree. With a grid's checkers all borders are merged at once:
    A part's simplex is final if no point of another part can be in its circumsphere. The vertices of the others,
    and those of the part's hull, make up the border set; a simplex of the whole mesh is either final in its part
    or has all its vertices there. The border set is meshed in one task if it is small, else in parts again.
    """
    if checker == "bounds":
        return merged(assigned, dim, task_points).where("kind = 's'").select("v")
    pieces = settle(local_meshes(assigned, dim), "pieces")
    edge = settle(edge_simplices(pieces, assigned, dim, checker, width), "edge")
    ends = edge.select(F.explode("v").alias("id")).unionByName(pieces.where("kind <> 's'").select(F.explode("v").alias("id"))).distinct()
    far = assigned.where("id < 0").select("id").distinct()
    border = settle(assigned.dropDuplicates(["id"]).select("id", *axes(dim)).join(ends.unionByName(far).distinct(), "id", "left_semi"), "border")
    n = border.count()
    if n <= task_points or level >= MOST_LEVELS:
        edge_mesh = local_meshes(border.withColumn("part", F.lit("e")), dim).where("kind = 's'").select("v")
    else:
        wanted, depth = -(-n // task_points), 1
        while 1 << depth < wanted:
            depth += 1
        again = flatten(assign(border.where("id >= 0"), dim, "c" if level % 2 else "e", depth))
        again = with_far(again, border.where("id < 0"), dim)
        edge_mesh = mesh_parts(again, dim, checker, width, task_points, level + 1)
    return merge(pieces, edge, settle(edge_mesh, "edge-mesh"), assigned.where("id >= 0"))


def triangulate(points: DataFrame, dim: int, kind: str = "d", depth: int | None = None, checker: str = "bounds", width: float | None = None, far: str | None = None, assigned: DataFrame | None = None, task_points: int = TASK_POINTS) -> DataFrame:
    """simplices(id, v, fp, nb) of points(id, x, y[, z]): the Delaunay mesh, whatever the partitioner.

    Of points in one place the smallest id is meshed. `assigned` may give parts of its own (id, x, ..., part).
    Without a depth, parts are split until they have at most `task_points` points, however the points are spread.
    With far="mid" or "origin" the 2^dim far points are vertices too and each hull simplex has some.
    """
    if assigned is None:
        own, cutoff = distinct_points(points.where("id >= 1"), dim), 0
        if depth is None:
            own, cutoff = settle(own, "distinct"), task_points
            depth = depth_within(kind, dim, own.count(), task_points) + SKEW_LEVELS
        assigned = flatten(assign(own, dim, kind, depth, cutoff))
    assigned = settle(assigned.select("id", *axes(dim), "part"), "assigned")
    if far:
        assigned = settle(with_far(assigned, far_points(assigned, dim, far), dim), "assigned")
    return with_neighbours(identified(settle(mesh_parts(assigned, dim, checker, width, task_points), "mesh")))
