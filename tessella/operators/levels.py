"""Joins of extended objects by a hierarchy of grids: every pair that may meet shares a cell of a known level."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.boxes import Box

#: Cells of level k have the width 2^k. A level is at most so far below that of the coordinates themselves, which have 53 bits.
BITS = 52
LEAST_LEVEL, MOST_LEVEL = -1000, 1020


def level_of(box: Box) -> Column:
    """The level whose cells are as wide as the box or wider, up to twice: so the box meets at most two or three along each axis."""
    power = lambda x: F.when(x > 0, F.ceil(F.log2(x))).otherwise(LEAST_LEVEL)
    wide = F.array_max(F.array(*[hi - lo for lo, hi in zip(*box)]))
    far = F.array_max(F.array(*[F.abs(x) for x in [*box[0], *box[1]]]))
    return F.greatest(F.least(F.greatest(power(wide), power(far) - BITS), F.lit(MOST_LEVEL)), F.lit(LEAST_LEVEL)).cast("int")


def _cells(of: DataFrame, box: list[str], level: Column) -> DataFrame:
    """A row for each cell of the level that the box (columns lo, hi, lo, hi, ...) meets, as columns cell_0, ... and grid_level."""
    out = of.withColumn("grid_level", level)
    for k in range(len(box) // 2):
        low, high = (F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("grid_level"))).cast("long") for c in box[2 * k : 2 * k + 2])
        out = out.withColumn(f"cell_{k}", F.explode(F.sequence(low, high)))
    return out


def meeting(a: DataFrame, b: DataFrame, dim: int) -> DataFrame:
    """a x b as far as their boxes meet (touching counts): a has columns alo_0, ahi_0, ..., b has blo_0, bhi_0, ...; other names differ.

    Each object belongs to the level of its size. A pair is found at the larger of its two levels, where the other object is
    listed too: it is listed at its own level and at each coarser one that objects of the other side belong to. At all of
    these it meets at most two or three cells along an axis, so the theta join is an equi-join on level and cell. A pair
    is reported by one cell only: the one with the lower ends of what the boxes share. Rows with a null or infinite end meet nothing.
    """
    ends = {s: [f"{s}{e}_{k}" for k in range(dim) for e in ("lo", "hi")] for s in "ab"}
    sides, levels = {}, {}
    for s, of in (("a", a), ("b", b)):
        fine = reduce(and_, [F.abs(F.col(c)) < float("inf") for c in ends[s]])
        box = [F.col(c) for c in ends[s][::2]], [F.col(c) for c in ends[s][1::2]]
        sides[s] = of.where(fine).withColumn(f"{s}_level", level_of(box))
        levels[s] = sorted(r[0] for r in sides[s].select(f"{s}_level").distinct().collect())  # a few dozen numbers
    listed = {}
    for s, other in (("a", "b"), ("b", "a")):
        own = F.col(f"{s}_level")
        coarser = F.array_compact(F.array(F.lit(None).cast("int"), *[F.when(own < x, F.lit(x)) for x in levels[other]]))
        listed[s] = _cells(sides[s].withColumn("at", F.explode(F.concat(F.array(own), coarser))), ends[s], F.col("at")).drop("at")
    keys = ["grid_level", *[f"cell_{k}" for k in range(dim)]]
    both = listed["a"].join(listed["b"], keys).where(F.col("grid_level") == F.greatest("a_level", "b_level"))
    width = F.pow(F.lit(2.0), F.col("grid_level"))
    for k in range(dim):
        low, high = F.greatest(f"alo_{k}", f"blo_{k}"), F.least(f"ahi_{k}", f"bhi_{k}")
        both = both.where((low <= high) & (F.floor(low / width).cast("long") == F.col(f"cell_{k}")))
    return both.drop("a_level", "b_level", *keys)
