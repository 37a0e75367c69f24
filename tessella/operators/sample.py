"""Sample-based partitioners: sample, mesh the sample, cut its graph, assign every point by the sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.boxes import bounding_boxes
from tessella.functions.scalars import EDGE_WEIGHTS, rescale, sample_size, weight_range
from tessella.functions.vectors import axes
from tessella.operators.graph import cut_graph
from tessella.operators.locate import nearest_box, nearest_centre, nearest_sample
from tessella.operators.mesh import distinct_points, mesh_edges, mesh_of
from tessella.operators.stats import centres
from tessella.sources.scratch import settle

#: Weights of the sample's graph are whole numbers in this range.
WEIGHTS = (1, 99)


def random_sample(points: DataFrame, n: int, seed: int = 1986) -> DataFrame:
    """n points of a fixed order by hash; fewer if there are fewer."""
    return points.where("id >= 1").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def renumbered(sample: DataFrame) -> DataFrame:
    """sample(idx, point_id, x, ...): idx from 0 in the order of ids. The sample is small, so one task numbers it."""
    return sample.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("idx"), F.col("id").alias("point_id"), *[c for c in sample.columns if c != "id"])


def sample_graph(sample: DataFrame, dim: int, weight: str = "uniform") -> DataFrame:
    """edges(src, dst, w) of the sample's mesh, both directions, sorted."""
    names = axes(dim)
    edges = mesh_edges(mesh_of(sample.select(F.col("idx").alias("id"), *names), dim))
    box = sample.agg(*[(F.max(a) - F.min(a)).alias(a) for a in names]).first()
    most = sum((box[a] or 0.0) ** 2 for a in names) or 1.0
    ends = lambda k: sample.select(F.col("idx").alias(k), *[F.col(a).alias(f"{k}_{a}") for a in names])
    placed = edges.join(ends("src"), "src").join(ends("dst"), "dst")
    gap = sum([(F.col(f"src_{a}") - F.col(f"dst_{a}")) * (F.col(f"src_{a}") - F.col(f"dst_{a}")) for a in names], F.lit(0.0)) / most
    low, high = weight_range(weight)
    return placed.select("src", "dst", rescale(EDGE_WEIGHTS[weight](gap), low, high, *WEIGHTS).alias("w")).orderBy("src", "dst")


def build_sampling(points: DataFrame, dim: int, k: int, seed: int = 1986, size: str | int = "sqrt", weight: str = "uniform", imbalance: float = 0.05, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sample(idx, point_id, x, ..., part), edges): a sample of f(total) points, its graph and a k-way cut of it."""
    n = max(sample_size(size, points.where("id >= 1").count() if total is None else total), k, dim + 2)
    sample = settle(renumbered(random_sample(distinct_points(points, dim), n, seed)), "sample")
    edges = settle(sample_graph(sample, dim, weight), "sample-graph")
    rows = edges.select("src", "dst", "w").toPandas()  # of the sample, which is small
    labels = cut_graph(sample.count(), rows.src.to_numpy(), rows.dst.to_numpy(), rows.w.to_numpy(), k, imbalance, seed)
    table = points.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(labels)], "idx long, part int")
    return settle(sample.join(table, "idx"), "sampling"), edges


def cut_edges(edges: DataFrame, sample: DataFrame) -> DataFrame:
    """edges whose ends have different parts."""
    part = lambda k: sample.select(F.col("idx").alias(k), F.col("part").alias(f"{k}_part"))
    return edges.join(part("src"), "src").join(part("dst"), "dst").where("src_part <> dst_part")


def _with_parts(points: DataFrame, parts: DataFrame, dim: int) -> DataFrame:
    return points.select("id", *axes(dim)).join(parts.select("id", F.col("part").cast("string").alias("part")), "id")


def by_centres(points: DataFrame, dim: int, k: int, shrunk: bool = False, **options) -> DataFrame:
    sample, _ = build_sampling(points, dim, k, **options)
    return _with_parts(points, nearest_centre(points, centres(sample, dim, shrunk), dim), dim)


def by_bounds(points: DataFrame, dim: int, k: int, **options) -> DataFrame:
    sample, _ = build_sampling(points, dim, k, **options)
    return _with_parts(points, nearest_box(points, bounding_boxes(sample, axes(dim), "part"), dim), dim)


def by_nearest(points: DataFrame, dim: int, k: int, **options) -> DataFrame:
    sample, _ = build_sampling(points, dim, k, **options)
    return _with_parts(points, nearest_sample(points, sample, dim), dim)


def _recursive(points: DataFrame, dim: int, parts: int, cutoff: int, halve: Callable[[DataFrame, int], DataFrame], path: str = "0") -> DataFrame:
    """Halves again and again while parts are wanted and there are more points than the cutoff."""
    if parts <= 1 or points.count() <= max(cutoff, 2 * (dim + 2)):
        return points.select("id", *axes(dim), F.lit(path).alias("part"))
    halves = settle(halve(points, len(path)), "halves")
    out = None
    for side in ("0", "1"):
        own = _recursive(halves.where(F.col("part") == side).drop("part"), dim, parts // 2 if side == "0" else parts - parts // 2, cutoff, halve, path + side)
        out = own if out is None else out.unionByName(own)
    return out


def by_nearest_halves(points: DataFrame, dim: int, k: int, cutoff: int = 5000, seed: int = 1986, **options) -> DataFrame:
    total = points.where("id >= 1").count()
    return _recursive(points, dim, k, cutoff, lambda p, level: by_nearest(p, dim, 2, seed=seed + level, total=total, **options))


def separating_plane(midpoints: np.ndarray) -> tuple[np.ndarray, float]:
    """The plane through the middle of the points along their two widest directions (one, in 2-D)."""
    middle = midpoints.mean(0)
    normal = np.linalg.svd(midpoints - middle)[2][-1]
    return normal, float(normal @ middle)


def _midpoints(points: DataFrame, dim: int, **options) -> np.ndarray:
    sample, edges = build_sampling(points, dim, 2, **options)
    ends = lambda k: sample.select(F.col("idx").alias(k), *[F.col(a).alias(f"{k}_{a}") for a in axes(dim)])
    cut = cut_edges(edges, sample).where("src < dst").join(ends("src"), "src").join(ends("dst"), "dst")
    return cut.select(*[((F.col(f"src_{a}") + F.col(f"dst_{a}")) / 2).alias(a) for a in axes(dim)]).toPandas().to_numpy()


def by_planes(points: DataFrame, dim: int, k: int, cutoff: int = 5000, seed: int = 1986, **options) -> DataFrame:
    total = points.where("id >= 1").count()

    def halve(p: DataFrame, level: int) -> DataFrame:
        normal, offset = separating_plane(_midpoints(p, dim, seed=seed + level, total=total, **options))
        side = sum([F.col(a) * float(n) for a, n in zip(axes(dim), normal)], F.lit(0.0)) > offset
        return p.select("id", *axes(dim), F.when(side, "1").otherwise("0").alias("part"))

    return _recursive(points, dim, k, cutoff, halve)


def by_border_medians(points: DataFrame, dim: int, k: int, cutoff: int = 5000, seed: int = 1986, **options) -> DataFrame:
    """Splits the box at the median of the cut edges' midpoints, in the dimension in which the border is shortest."""
    total = points.where("id >= 1").count()

    def halve(p: DataFrame, level: int) -> DataFrame:
        mid = _midpoints(p, dim, seed=seed + level, total=total, **options)
        d = int(np.ptp(mid, axis=0).argmin())
        at = float(np.sort(mid[:, d])[len(mid) // 2])
        return p.select("id", *axes(dim), F.when(F.col(axes(dim)[d]) > at, "1").otherwise("0").alias("part"))

    return _recursive(points, dim, k, cutoff, halve)


#: By name; each takes (points, dim, parts, **options) and returns points with a part.
PARTITIONERS: dict[str, Callable[..., DataFrame]] = {
    "binary-besp": by_border_medians,
    "center-distance-pasp": by_centres,
    "bounds-distance-pasp": by_bounds,
    "nearest-sample-pasp": by_nearest,
    "nearest-sample-pasb": by_nearest_halves,
    "hyperplane-sample-pasb": by_planes,
}


def partition(points: DataFrame, dim: int, name: str, k: int, **options) -> DataFrame:
    """points(id, x, ..., part) by the name of a partitioner: a sample's, or `d-way`, `one-dim`, `cycle`, `extend`, `kway`."""
    from tessella.operators.partition import assign, assign_slabs, depth_for, flatten

    if name == "kway":
        return flatten(assign_slabs(points, dim, k))
    simple = {"d-way": "d", "one-dim": "0", "cycle": "c", "extend": "e"}
    if name in simple:
        return flatten(assign(points, dim, simple[name], max(1, depth_for(simple[name], dim, k))))
    if name not in PARTITIONERS:
        raise ValueError(f"unknown partitioner {name!r}")
    return PARTITIONERS[name](points, dim, k, **options)
