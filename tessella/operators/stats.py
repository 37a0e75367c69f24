"""Aggregates: point statistics, grouped boxes, cells, centres, hashes, degrees and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.boxes import bounding_boxes
from tessella.functions.grid import cell_of
from tessella.functions.vectors import axes, columns

__all__ = ["bounding_boxes"]


def point_stats(points: DataFrame, dim: int, *by: str, far: bool = False) -> DataFrame:
    """min_, mid_ and max_ of each coordinate; far points are left out unless asked for."""
    rows = points if far else points.where("id >= 0")
    value = []
    for a in axes(dim):
        value += [F.min(a).alias(f"min_{a}"), ((F.min(a) + F.max(a)) / 2).alias(f"mid_{a}"), F.max(a).alias(f"max_{a}")]
    return rows.groupBy(*by).agg(*value)


def part_cells(points: DataFrame, dim: int, width: float) -> DataFrame:
    """The distinct grid cells of each part of points(id, x, y[, z], part)."""
    names = axes(dim)
    cells = [c.alias(f"cell_{a}") for a, c in zip(names, cell_of(columns(names), width))]
    return points.select("part", *cells).distinct()


def cell_points(points: DataFrame, dim: int, width: float) -> DataFrame:
    """(cell_x, ..., id), a row per point: the cell's list in normal form."""
    names = axes(dim)
    return points.select(*[c.alias(f"cell_{a}") for a, c in zip(names, cell_of(columns(names), width))], "id")


def centres(points: DataFrame, dim: int, shrunk: bool = False) -> DataFrame:
    """The mean of each part; `shrunk` divides by one more than the count, as a running mean with early weights does."""
    n = F.count("*") + 1 if shrunk else F.count("*")
    return points.groupBy("part").agg(*[(F.sum(a) / n).alias(a) for a in axes(dim)])


def triangulation_hash(simplices: DataFrame) -> DataFrame:
    """(bucket, h): fingerprints in 256 buckets by their low byte, combined by exclusive or."""
    return simplices.groupBy(F.col("fp").bitwiseAND(F.lit(255)).alias("bucket")).agg(F.bit_xor("fp").alias("h"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def csr_offsets(edges: DataFrame) -> DataFrame:
    """(src, degree, offset): where each node's neighbours end in the sorted edge list.

    The running sum is for a sample's graph, whose size is the square root of the data's.
    """
    return degrees(edges).withColumn("offset", F.sum("degree").over(Window.orderBy("src")))


def average_measurement(runs: DataFrame, name: str) -> DataFrame:
    """The whole-number mean of a measurement per run."""
    values = F.col("measurements")[name]
    return runs.withColumn(f"avg_{name}", F.floor(F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v) / F.size(values)))


def median_at(column: str) -> Column:
    """The element at half the count of the sorted values."""
    rows = F.sort_array(F.collect_list(column))
    return F.element_at(rows, (F.floor(F.size(rows) / 2) + 1).cast("int"))


def storage_counts(simplices: DataFrame, points: DataFrame) -> DataFrame:
    """Live rows and their bytes at eight an id and coordinate."""
    s = simplices.agg(F.count("*").alias("simplices"), F.count_if(F.exists("v", lambda i: i < 0)).alias("hull"), F.coalesce(F.sum(F.size("v") * 16 + 16), F.lit(0)).alias("simplex_bytes"))
    return s.crossJoin(points.agg(F.count("*").alias("points")))  # one row each


def part_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("part").agg(F.count("*").alias("n"))
