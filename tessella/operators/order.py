"""Order: along a space-filling curve, dense ids in an order, sorted adjacency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import axes
from tessella.sources.scratch import settle


def _places(cells: list[np.ndarray], bits: int) -> np.ndarray:
    n, at = len(cells), [c.copy() for c in cells]
    for b in range(bits - 1, 0, -1):
        step = 1 << b
        for axis in range(n):
            yes = at[axis] & step != 0
            swap = np.where(yes, 0, (at[0] ^ at[axis]) & (step - 1))
            at[0] ^= np.where(yes, step - 1, swap)
            if axis:
                at[axis] ^= swap
    for d in range(1, n):
        at[d] ^= at[d - 1]
    flips = np.zeros_like(at[0])
    for b in range(bits - 1, 0, -1):
        flips ^= np.where(at[-1] & (1 << b) != 0, (1 << b) - 1, 0)
    out = np.zeros_like(flips)
    for d in range(n):
        for b in range(bits):
            out |= ((at[d] ^ flips) >> b & 1) << (b * n + n - 1 - d)
    return out


def curve_key(names: list[str], low: list[float], high: list[float], bits: int = 16) -> Column:
    """The place of a point's cell on a Hilbert curve over the bounds.

    A state machine over the bits, from the highest: each turns or mirrors the axes of the lower ones; what is left is the
    Gray code of the place. It runs over whole Arrow batches: higher-order functions are interpreted for each row, axis and bit.
    """
    share = [F.least(F.greatest((F.col(a) - lo) / ((hi - lo) or 1.0), F.lit(0.0)), F.lit(1.0)) for a, lo, hi in zip(names, low, high)]

    @F.pandas_udf("long")
    def place(*cells: pd.Series) -> pd.Series:
        return pd.Series(_places([c.to_numpy(np.int64) for c in cells], bits))

    return place(*[(c * ((1 << bits) - 1)).cast("long") for c in share])


def spatial_sort(points: DataFrame, dim: int, bounds: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Rows in the order of the curve: a range shuffle by the key, then a sort in each partition."""
    names = axes(dim)
    if bounds is None:
        ends = points.where("id >= 0").agg(*[f(a) for f in (F.min, F.max) for a in names]).first()
        bounds = (list(ends[:dim]), list(ends[dim:])) if ends[0] is not None else ([0.0] * dim, [1.0] * dim)
    keyed = points.withColumn("curve", curve_key(names, *bounds))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, "curve", "id").sortWithinPartitions("curve", "id")


def spatial_places(points: DataFrame, dim: int, bounds: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """(id, place): each row's place in the order of the curve, from 0; the smaller id first in a cell."""
    return dense_ids(spatial_sort(points, dim, bounds), "place", 0).select("id", "place")


def dense_ids(ordered: DataFrame, name: str = "id", first: int = 1) -> DataFrame:
    """Numbers rows from `first` in their order over partitions, by partition counts; no row moves."""
    placed = settle(ordered.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "ordered")
    counts = placed.groupBy("__part").count().collect()  # a row per partition
    start, starts = first, {}
    for r in sorted(counts, key=lambda r: r["__part"]):
        starts[r["__part"]], start = start, start + r["count"]
    base = F.create_map(*[F.lit(int(v)) for kv in (starts or {0: first}).items() for v in kv])
    number = (F.element_at(base, F.col("__part")) + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return placed.withColumn(name, number).drop("__part", "__row")


def renumber_along_curve(points: DataFrame, dim: int, bounds) -> DataFrame:
    return dense_ids(spatial_sort(points, dim, bounds).drop("curve", "id")).select("id", *axes(dim))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, nbrs) with neighbours sorted, each once."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))
