"""Meshes as tables: the kernel per part, faces, neighbours, fingerprints, hulls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.simplices import fingerprint
from tessella.functions.vectors import axes
from tessella.operators.kernel import Mesh, circumspheres, distinct_places
from tessella.operators.order import dense_ids

PIECE = "part string, kind string, v array<long>, centre array<double>, square_radius double"
FAR_LAST = (1 << 63) - 1


def distinct_points(points: DataFrame, dim: int) -> DataFrame:
    """One point of each location: the one with the smallest id."""
    return points.groupBy(*axes(dim)).agg(F.min("id").alias("id")).select("id", *axes(dim))


def dropped_points(points: DataFrame, dim: int) -> DataFrame:
    """(id, kept): points that share the location of a smaller id."""
    kept = points.groupBy(*axes(dim)).agg(F.min("id").alias("kept"))
    return points.join(kept, axes(dim)).where("id <> kept").select("id", "kept")


def local_meshes(points: DataFrame, dim: int) -> DataFrame:
    """PIECE rows of each part of points(id, x, y[, z], part).

    kind `s`: a simplex with its circumsphere; `h`: a face of the part's hull; `p`: a point of a part too flat for
    simplices. Vertices are ids, finite ones rising, far ones last. A part is one task's; its size is what the
    partitioner makes it.
    """
    names = axes(dim)

    def run(found: pa.Table) -> pa.Table:
        at = np.stack([np.asarray(found.column(a).combine_chunks(), np.float64) for a in names], 1)
        ids = np.asarray(found.column("id").combine_chunks(), np.int64)
        order = np.argsort(ids, kind="stable")
        at, ids = at[order], ids[order]
        keep = distinct_places(at)
        at, ids = at[keep], ids[keep]
        mesh, part = Mesh(at), found.column("part")[0].as_py()

        def rows(places: np.ndarray) -> list[list[int]]:
            v = ids[places]
            key = np.where(v < 0, FAR_LAST + v, v)
            return np.take_along_axis(v, np.argsort(key, 1), 1).tolist()

        simplices = mesh.simplices()
        centre, square = circumspheres(at, simplices) if len(simplices) else (np.zeros((0, dim)), np.zeros(0))
        v = rows(simplices) + rows(mesh.hull())
        kinds = ["s"] * len(simplices) + ["h"] * (len(v) - len(simplices))
        if mesh.flat:
            v, kinds = [[i] for i in ids.tolist()], ["p"] * len(ids)
        rest = len(v) - len(simplices)
        return pa.table({
            "part": pa.array([part] * len(v), pa.string()),
            "kind": pa.array(kinds, pa.string()),
            "v": pa.array(v, pa.list_(pa.int64())),
            "centre": pa.array(centre.tolist() + [None] * rest, pa.list_(pa.float64())),
            "square_radius": pa.array(square.tolist() + [None] * rest, pa.float64()),
        })

    return points.select("id", *names, F.col("part").cast("string").alias("part")).groupBy("part").applyInArrow(run, PIECE)


def mesh_of(points: DataFrame, dim: int) -> DataFrame:
    """simplices(v) of all points in one task."""
    return local_meshes(points.withColumn("part", F.lit("0")), dim).where("kind = 's'").select("v")


def identified(simplices: DataFrame) -> DataFrame:
    """simplices(id, v, fp): ids are the places in the order of the vertices, from 0.

    No two simplices share one, and they are the same in every run and partitioning. One range shuffle; a row for each of its
    partitions is counted.
    """
    parts = int(simplices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = simplices.select("v").repartitionByRange(parts, "v").sortWithinPartitions("v")
    return dense_ids(ordered, "id", 0).select("id", "v", fingerprint(F.col("v")).alias("fp"))


def faces(simplices: DataFrame) -> DataFrame:
    """(face, id, d, opposite): the face opposite to each vertex of simplices(id, v)."""
    placed = simplices.select("id", "v", F.posexplode("v").alias("d", "opposite"))
    return placed.select(F.array_except("v", F.array("opposite")).alias("face"), "id", "d", "opposite")


def with_neighbours(simplices: DataFrame) -> DataFrame:
    """simplices(id, v, fp, nb): nb[d] is the simplex across the face opposite to v[d], null at the hull.

    One shuffle on the faces, of which at most two simplices share one, and one back on ids.
    """
    pairs = faces(simplices).groupBy("face").agg(F.collect_list(F.struct("id", "d")).alias("own"))
    each = pairs.select(F.explode("own").alias("me"), "own").select("me.id", "me.d", F.get(F.filter("own", lambda o: o["id"] != F.col("me.id")), F.lit(0))["id"].alias("nb"))
    nb = each.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "nb"))), lambda s: s["nb"]).alias("nb"))
    return simplices.join(nb, "id")


def neighbour_pairs(simplices: DataFrame) -> DataFrame:
    """(id, nb), a row for each direction."""
    own = simplices if "nb" in simplices.columns else with_neighbours(simplices)
    return own.select("id", F.explode("nb").alias("nb")).where("nb is not null")


def hull_faces(simplices: DataFrame) -> DataFrame:
    """Faces that one simplex has alone."""
    return faces(simplices).groupBy("face").agg(F.count("*").alias("n")).where("n = 1").select("face")


def mesh_edges(simplices: DataFrame) -> DataFrame:
    """(src, dst): every ordered pair of finite vertices of a simplex, once."""
    ends = simplices.select(F.explode("v").alias("src"), "v").select("src", F.explode("v").alias("dst"))
    return ends.where("src <> dst and src >= 0 and dst >= 0").distinct()


def dual_edges(simplices: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    """Edges of the Voronoi diagram: the circumcentres of neighbours, each pair once."""
    centres = with_coordinates(simplices, points, dim)
    from tessella.functions.simplices import circumsphere

    middle, _ = circumsphere([[F.col("at")[k][a] for a in axes(dim)] for k in range(dim + 1)])
    centres = centres.select("id", *[m.alias(a) for m, a in zip(middle, axes(dim))])
    pairs = neighbour_pairs(simplices).where("id < nb")
    other = centres.select(F.col("id").alias("nb"), *[F.col(a).alias(f"{a}2") for a in axes(dim)])
    return pairs.join(centres, "id").join(other, "nb")


def with_coordinates(simplices: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    """simplices with `at`, the coordinate structs of the vertices in order; those with an unknown vertex are left out."""
    names = axes(dim)
    placed = simplices.select("id", F.posexplode("v").alias("d", "p"))
    found = placed.join(points.select(F.col("id").alias("p"), F.struct(*names).alias("c")), "p")
    at = found.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("at"))
    return simplices.join(at, "id").where(F.size("at") == F.size("v"))
