"""A uniform grid through the origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.boxes import Box, intersects_sphere
from tessella.functions.vectors import Vector


def cell_of(p: Vector, width) -> list[Column]:
    return [F.floor(x / width).cast("long") for x in p]


def cell_bounds(cell: list[Column], width) -> Box:
    return [c * width for c in cell], [(c + 1) * width for c in cell]


def cell_centre(cell: list[Column], width) -> Vector:
    return [(c + 0.5) * width for c in cell]


def diagonal(dim: int, width: float) -> float:
    return dim**0.5 * width


def cell_hash(cell: list[Column]) -> Column:
    """31 * h + k over the coordinates."""
    out = F.lit(0).cast("long")
    for c in cell:
        out = out * 31 + c
    return out


def cell_meets_sphere(cell: list[Column], width, centre: Vector, square_radius: Column) -> Column:
    return intersects_sphere(cell_bounds(cell, width), centre, square_radius)
