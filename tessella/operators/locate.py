"""Joins by nearness: points to samples, centres and boxes; points to the simplex that holds them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.boxes import square_gap
from tessella.functions.simplices import in_simplex
from tessella.functions.vectors import axes, columns, dot, minus, plus, scale, square_distance, square_length
from tessella.operators.mesh import with_coordinates
from tessella.operators.nearest_tree import by_broadcast, by_cells
from tessella.sources.scratch import settle

#: Centres and boxes up to so many go into the expression itself; a sample, or centres and boxes, up to so many rows are broadcast as a tree.
MOST_CENTRES, MOST_SAMPLE = 64, 4_000_000


def _part_rows(table: DataFrame, names: list[str]) -> pa.Table:
    """The rows of parts in their order; a row per part, checked."""
    rows = table.select("part", *names).orderBy("part").limit(MOST_SAMPLE + 1).toArrow()
    if rows.num_rows > MOST_SAMPLE:
        raise ValueError(f"more than {MOST_SAMPLE} parts")
    return rows


def _nearest_part(points: DataFrame, rows: pa.Table, dim: int, low: list[str], high: list[str], kind: str) -> DataFrame:
    ends = [np.stack([rows[n].to_numpy().astype(np.float64) for n in names], 1) for names in (low, high)]
    return by_broadcast(points, axes(dim), *ends, rows.select(["part"]), f"part {kind}")


def nearest_centre(points: DataFrame, centres: DataFrame, dim: int, most: int = MOST_CENTRES) -> DataFrame:
    """(id, part) of the nearest of centres(part, x, ...); the smallest part of equals. No join; over `most` parts a tree of them."""
    names, rows = axes(dim), _part_rows(centres, axes(dim))
    if rows.num_rows > most:
        return _nearest_part(points, rows, dim, names, names, centres.schema["part"].dataType.simpleString())
    p = columns(names)
    tries = [F.struct(square_distance(p, [F.lit(float(r[a])) for a in names]).alias("d"), F.lit(r["part"]).alias("part")) for r in rows.to_pylist()]
    return points.select("id", F.array_min(F.array(*tries))["part"].alias("part"))


def nearest_box(points: DataFrame, boxes: DataFrame, dim: int, most: int = MOST_CENTRES) -> DataFrame:
    """(id, part) of the nearest of boxes(part, lo_x, hi_x, ...); distance 0 inside; the smallest part of equals."""
    names, p = axes(dim), columns(axes(dim))
    low, high = ([f"{e}_{a}" for a in names] for e in ("lo", "hi"))
    rows = _part_rows(boxes, low + high)
    if rows.num_rows > most:
        return _nearest_part(points, rows, dim, low, high, boxes.schema["part"].dataType.simpleString())
    tries = []
    for r in rows.to_pylist():
        box = [F.lit(float(r[n])) for n in low], [F.lit(float(r[n])) for n in high]
        tries.append(F.struct(square_gap(box, p).alias("d"), F.lit(r["part"]).alias("part")))
    return points.select("id", F.array_min(F.array(*tries))["part"].alias("part"))


def nearest_sample(points: DataFrame, sample: DataFrame, dim: int, most: int = MOST_SAMPLE) -> DataFrame:
    """(id, idx, part) of the nearest of sample(idx, x, ..., part); the smallest idx of equals.

    A sample of at most `most` rows is broadcast as a k-d tree, so a point is compared with a few of its rows only. A larger
    one is dealt to cells together with the points. A point with a coordinate that is null or not finite has the smallest
    idx; with an empty sample idx and part are null.
    """
    names = axes(dim)
    rows = sample.select("idx", *names, "part").orderBy("idx").limit(most + 1).toArrow()
    if rows.num_rows > most:
        return by_cells(points, sample, dim)
    at = np.stack([rows[a].to_numpy().astype(np.float64) for a in names], 1)
    return by_broadcast(points, names, at, at, rows.select(["idx", "part"]), f"idx long, part {sample.schema['part'].dataType.simpleString()}")


def _fitted(placed: DataFrame, names: list[str], width: float) -> float:
    """A cell width of at most `width` at which the box around all simplices has no more cells than there are simplices.

    With a fixed width the rows that meet in a cell grow with the square of the density.
    """
    ends = [f(g(F.col("at")[a])) for a in names for f, g in ((F.min, F.array_min), (F.max, F.array_max))]
    n, *box = placed.agg(F.count("*"), *ends).first()
    spans = [high - low for low, high in zip(box[::2], box[1::2])] if n else [0.0]
    return min(width, (prod(spans) / n) ** (1 / len(names))) if min(spans) > 0 else width


def _cells(placed: DataFrame, names: list[str], width: float) -> DataFrame:
    """A row of placed(id, at) for each grid cell that the simplex's bounding box meets."""
    out = placed
    for a in names:
        values = F.col("at")[a]
        out = out.withColumn(f"c_{a}", F.explode(F.sequence(F.floor(F.array_min(values) / width).cast("long"), F.floor(F.array_max(values) / width).cast("long"))))
    return out


def simplex_gap(vertices: list[list], p: list) -> Column:
    """The square distance of an outer point to a simplex: to the nearest of its corners, edges and (in 3-D) faces."""
    tries = [square_distance(v, p) for v in vertices]
    for i, j in combinations(range(len(vertices)), 2):
        edge, own = minus(vertices[j], vertices[i]), minus(p, vertices[i])
        t = F.try_divide(dot(own, edge), dot(edge, edge))
        tries.append(F.when((t > 0) & (t < 1), square_length(minus(own, scale(edge, t)))))
    for face in combinations(vertices, 3) if len(p) == 3 else []:
        e, f, own = minus(face[1], face[0]), minus(face[2], face[0]), minus(p, face[0])
        ee, ef, ff, oe, of = dot(e, e), dot(e, f), dot(f, f), dot(own, e), dot(own, f)
        s, t = (F.try_divide(x, ee * ff - ef * ef) for x in (ff * oe - ef * of, ee * of - ef * oe))
        tries.append(F.when((s > 0) & (t > 0) & (s + t < 1), square_length(minus(own, plus(scale(e, s), scale(f, t))))))
    return F.least(*tries)


def _nearest(open_: DataFrame, placed: DataFrame, names: list[str], width: float) -> DataFrame:
    """(qid, close): the nearest simplex of each query that none holds, the smallest id of equals.

    A query meets the simplices of its cell and the cells around it, which are all within a cell's width. What is
    found within that distance is the nearest; the other queries go on with cells four times as wide or, if the box
    around all simplices is farther away, as wide as that distance at least.
    """
    ends = [f(F.col("at")[a]).alias(f"{e}_{a}") for a in names for e, f in (("lo", F.array_min), ("hi", F.array_max))]
    box = placed.select(*ends).agg(*[f(f"{e}_{a}").alias(f"{e}_{a}") for a in names for e, f in (("lo", F.min), ("hi", F.max))]).first()
    low, high = ([F.lit(box[f"{e}_{a}"]) for a in names] for e in ("lo", "hi"))
    placed, done = placed.select("id", F.array_sort("at").alias("at")), None
    vertices = [[F.col("at")[k][a] for a in names] for k in range(len(names) + 1)]
    open_ = open_.withColumn("far", F.sqrt(square_gap((low, high), columns(names))))
    while (least := open_.agg(F.min("far")).first()[0]) is not None and box[f"lo_{names[0]}"] is not None:
        width = max(width, least)
        around = open_
        for a in names:
            cell = F.floor(F.col(a) / width).cast("long")
            around = around.withColumn(f"c_{a}", F.explode(F.sequence(cell - 1, cell + 1)))
        met = around.join(_cells(placed, names, width), [f"c_{a}" for a in names])
        best = met.groupBy("qid").agg(F.min(F.struct(simplex_gap(vertices, columns(names)).alias("d"), "id")).alias("best"))
        found = settle(best.where(F.col("best.d") <= width * width).select("qid", F.col("best.id").alias("close")), "nearest")
        done = found if done is None else done.unionByName(found)
        open_ = settle(open_.join(found, "qid", "left_anti"), "open")
        width *= 4
    return open_.select("qid", F.lit(None).cast("long").alias("close")).limit(0) if done is None else done


def locate(queries: DataFrame, simplices: DataFrame, points: DataFrame, dim: int, width: float) -> DataFrame:
    """(qid, simplex_id) of the simplex that holds each of queries(qid, x, ...), the smallest id of several.

    Both sides are dealt to grid cells of `width` at most, less if simplices are dense, and joined on them, so a query meets only the simplices near it. A query
    that no simplex holds has the nearest simplex, the smallest id of equals, however far it is. It has null only
    if there are no simplices, or a coordinate is null or not finite.
    """
    names = axes(dim)
    placed = settle(with_coordinates(simplices, points, dim).select("id", "at"), "placed")
    finite = reduce(and_, [F.abs(F.col(a)) < float("inf") for a in names])
    asked = queries.select("qid", *names).where(finite)
    fitted = _fitted(placed, names, width)
    celled = asked.select("*", *[F.floor(F.col(a) / fitted).cast("long").alias(f"c_{a}") for a in names])
    vertices = [[F.col("at")[k][a] for a in names] for k in range(dim + 1)]
    met = celled.join(_cells(placed, names, fitted), [f"c_{a}" for a in names])
    held = settle(met.where(in_simplex(vertices, columns(names))).groupBy("qid").agg(F.min("id").alias("held")), "held")
    close = _nearest(settle(asked.join(held, "qid", "left_anti"), "open"), placed, names, width)
    return queries.select("qid").join(held, "qid", "left").join(close, "qid", "left").select("qid", F.coalesce("held", "close").alias("simplex_id"))


def partition_of(simplices: DataFrame, assigned: DataFrame) -> DataFrame:
    """(v, part, inside): the part of the first vertex, and whether all finite vertices lie in it."""
    first = simplices.select("v", F.element_at("v", 1).alias("id"), F.explode("v").alias("p"))
    part = assigned.select("id", "part")
    other = part.withColumnRenamed("id", "p").withColumnRenamed("part", "q")
    return first.join(part, "id").join(other, "p").groupBy("v").agg(F.first("part").alias("part"), F.min(F.col("part") == F.col("q")).alias("inside"))
