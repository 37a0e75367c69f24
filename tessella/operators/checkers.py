"""Which simplices of a part may be changed by other parts: their circumspheres meet what the checker keeps of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.boxes import bounding_boxes, box_columns, intersects_sphere
from tessella.functions.grid import cell_bounds
from tessella.functions.vectors import axes, dot
from tessella.operators.levels import meeting
from tessella.operators.stats import part_cells
from tessella.sources.scratch import settle

#: Radii are enlarged by this share, for the rounding of spheres: an edge set may be too large, never too small.
SLACK = 1e-9
#: Boxes that each simplex is compared with; more are found by levels of grid cells.
MOST_PARTS = 64


def _centre(dim: int):
    return [F.col("centre")[k] for k in range(dim)]


def _radius():
    return F.col("square_radius") * (1 + SLACK)


def _odd():
    return F.isnan("square_radius") | (F.col("square_radius") == float("inf"))


def _pairs(pieces: DataFrame, points: DataFrame, dim: int, most_parts: int) -> DataFrame:
    """Simplices with each other part whose box their sphere meets.

    So many parts as a task compares at once are broadcast; more are joined with the spheres by levels of grid cells. Spheres
    that aren't finite (of flat simplices) meet every part; one other part of each is enough to know.
    """
    names = axes(dim)
    boxes = settle(bounding_boxes(points.where("id >= 0"), names, "part").withColumnRenamed("part", "other"), "boxes")
    meets = (F.col("part") != F.col("other")) & intersects_sphere(box_columns(names), _centre(dim), _radius())
    if boxes.count() <= max(most_parts, 1):
        return pieces.join(F.broadcast(boxes), meets).select(*pieces.columns, "other")
    reach = F.sqrt(_radius()) * (1 + SLACK)
    spheres = pieces.where(~_odd()).withColumns({f"a{e}_{k}": c + reach * sign for k, c in enumerate(_centre(dim)) for e, sign in (("lo", -1), ("hi", 1))})
    placed = boxes.withColumns({f"b{e}_{k}": F.col(f"{e}_{a}") for k, a in enumerate(names) for e in ("lo", "hi")})
    found = meeting(spheres, placed, dim).where(meets).select(*pieces.columns, "other")
    first, second = (F.lit(r["other"]) for r in boxes.select("other").orderBy("other").limit(2).collect())  # one of them is another part
    return found.unionByName(pieces.where(_odd()).withColumn("other", F.when(F.col("part") == first, second).otherwise(first)))


def edge_by_bounds(pieces: DataFrame, points: DataFrame, dim: int, most_parts: int = MOST_PARTS) -> DataFrame:
    return _pairs(pieces, points, dim, most_parts).select("part", "v").distinct()


def edge_by_grid(pieces: DataFrame, points: DataFrame, dim: int, width: float, most_parts: int = MOST_PARTS) -> DataFrame:
    """The sphere meets a cell that holds a point of another part."""
    cells = part_cells(points.where("id >= 0"), dim, width).withColumnRenamed("part", "other")
    pairs = _pairs(pieces, points, dim, most_parts).select("part", "v", "centre", "square_radius", "other")
    box = cell_bounds([F.col(f"cell_{a}") for a in axes(dim)], width)
    return pairs.join(cells, "other").where(intersects_sphere(box, _centre(dim), _radius())).select("part", "v").distinct()


def edge_by_points(pieces: DataFrame, points: DataFrame, dim: int, width: float, most_parts: int = MOST_PARTS) -> DataFrame:
    """The sphere meets a cell of another part and holds a point of that cell, of any part; own vertices count."""
    names = axes(dim)
    placed = points.where("id >= 0").select(F.col("part").alias("owner"), *names, *[F.floor(F.col(a) / width).cast("long").alias(f"cell_{a}") for a in names])
    cells = part_cells(points.where("id >= 0"), dim, width).withColumnRenamed("part", "other")
    pairs = _pairs(pieces, points, dim, most_parts).select("part", "v", "centre", "square_radius", "other")
    box = cell_bounds([F.col(f"cell_{a}") for a in names], width)
    met = pairs.join(cells, "other").where(intersects_sphere(box, _centre(dim), _radius())).select("part", "v", "centre", "square_radius", *[f"cell_{a}" for a in names]).distinct()
    inside = sum([(F.col(a) - c) * (F.col(a) - c) for a, c in zip(names, _centre(dim))], F.lit(0.0)) <= _radius()
    return met.join(placed, [f"cell_{a}" for a in names]).where(_odd() | inside).select("part", "v").distinct()


def edge_by_plane(pieces: DataFrame, dim: int, normal: list[float], offset: float) -> DataFrame:
    """Two parts `0` (not above) and `1` (above) of a plane: the sphere reaches the other half-space."""
    side = dot([F.lit(float(n)) for n in normal], _centre(dim)) - offset
    reach = F.sqrt(_radius()) * sum(n * n for n in normal) ** 0.5 + 1e-6
    return pieces.where(_odd() | F.when(F.col("part").endswith("0"), side + reach > 0).otherwise(side - reach <= 0)).select("part", "v").distinct()


def edge_simplices(pieces: DataFrame, points: DataFrame, dim: int, checker: str = "bounds", width: float | None = None) -> DataFrame:
    """(part, v) of kind `s` rows of pieces by the checker `bounds`, `grid` or `accurate-grid`."""
    own = pieces.where("kind = 's'")
    if checker == "bounds":
        return edge_by_bounds(own, points, dim)
    if checker not in ("grid", "accurate-grid"):
        raise ValueError(f"unknown checker {checker!r}")
    if not width:
        raise ValueError("a grid checker takes a cell width")
    return (edge_by_grid if checker == "grid" else edge_by_points)(own, points, dim, width)
