"""Spatial partitioners: each row of points gets a path, one digit a level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import log_floor, log2_floor
from tessella.functions.vectors import axes
from tessella.operators.stats import point_stats
from tessella.sources.scratch import settle

#: Node tables up to this size are broadcast; a node is a row of a few numbers.
BROADCAST_NODES = 4096
TOP = "0"


def _with_stats(points: DataFrame, dim: int, nodes: int, cutoff: int) -> DataFrame:
    stats = point_stats(points, dim, "path", far=False)
    if cutoff:
        stats = stats.join(points.where("id >= 0").groupBy("path").agg(F.count("*").alias("node_points")), "path")
    return points.join(F.broadcast(stats) if nodes <= BROADCAST_NODES else stats, "path")


def _above(a: str) -> Column:
    return F.col(a) > F.col(f"mid_{a}")


def _widest(names: list[str]) -> Column:
    spans = F.array(*[F.struct((F.col(f"max_{a}") - F.col(f"min_{a}")).alias("s"), F.lit(-k).alias("k")) for k, a in enumerate(names)])
    return -F.array_max(spans)["k"]


def _orthant(names, level):
    return sum([F.when(_above(a), 1 << d).otherwise(0) for d, a in enumerate(names)], F.lit(0))


def _one(d: int):
    return lambda names, level: F.when(_above(names[d]), 1).otherwise(0)


def _cycle(names, level):
    return _one(level % len(names))(names, level)


def _extend(names, level):
    wide = _widest(names)
    return F.coalesce(*[F.when(wide == k, F.when(_above(a), 1).otherwise(0)) for k, a in enumerate(names)], F.lit(0))


#: Digits of a level, from the statistics of the node.
SPLITTERS: dict[str, Callable[[list[str], int], Column]] = {"d": _orthant, "c": _cycle, "e": _extend, "0": _one(0), "1": _one(1), "2": _one(2)}


def fanout(kind: str, dim: int) -> int:
    return 1 << dim if kind == "d" else 2


def depth_for(kind: str, dim: int, parts: int) -> int:
    """Levels that give `parts` parts."""
    return log_floor(parts, fanout(kind, dim))


def split(points: DataFrame, dim: int, kind: str, level: int = 0, cutoff: int = 0) -> DataFrame:
    """points(id, x, ..., path) with a digit more, but for nodes of at most `cutoff` points: ties at the midpoint go low."""
    if kind not in SPLITTERS:
        raise ValueError(f"unknown partitioner {kind!r}")
    names = axes(dim)
    if kind in "012" and int(kind) >= dim:
        raise ValueError("no such dimension")
    own = _with_stats(points, dim, fanout(kind, dim) ** level, cutoff)
    longer = F.concat("path", SPLITTERS[kind](names, level).cast("string"))
    return own.select("id", *names, (F.when(F.col("node_points") > cutoff, longer).otherwise(F.col("path")) if cutoff else longer).alias("path"))


def assign(points: DataFrame, dim: int, kind: str, depth: int = 1, cutoff: int = 0) -> DataFrame:
    """points with a path of `depth` levels; after the first level, nodes of at most `cutoff` points stay whole.

    A level reads its nodes' statistics and its points from a written table, so the plan doesn't double with each
    level; with a cutoff the levels end once no node is over it.
    """
    out = points.select("id", *axes(dim), F.lit(TOP).alias("path"))
    for level in range(depth):
        if level:
            out = settle(out, "level")
            if cutoff and out.groupBy("path").count().where(F.col("count") > cutoff).isEmpty():
                break
        out = split(out, dim, kind, level, cutoff if level else 0)
    return out


def depth_within(kind: str, dim: int, points: int, part_points: int) -> int:
    """Levels after which evenly spread points lie in parts of `part_points`, one at least."""
    depth = 1
    while fanout(kind, dim) ** depth * part_points < points:
        depth += 1
    return depth


def slab_counts(k: int, dim: int) -> list[int]:
    """Powers of two for each dimension whose product is k, doubled in turn."""
    if k < 1 or k & (k - 1):
        raise ValueError("the number of parts must be a power of two")
    out = [1] * dim
    for i in range(log2_floor(k)):
        out[i % dim] *= 2
    return out


def assign_slabs(points: DataFrame, dim: int, k: int, float32: bool = False) -> DataFrame:
    """Equal slabs of each dimension in turn, over the bounds of what the dimensions before have made."""
    names = axes(dim)
    out = points.select("id", *names, F.lit(TOP).alias("path"))
    nodes = 1
    for a, n in zip(names, slab_counts(k, dim)):
        if n == 1:
            continue
        own = _with_stats(out, dim, nodes, 0)
        kind = "float" if float32 else "double"
        low, high, x = (F.col(c).cast(kind) for c in (f"min_{a}", f"max_{a}", a))
        place = F.when(high > low, F.floor((x - low) / (high - low) * F.lit(n).cast(kind))).otherwise(F.lit(0))
        digit = F.least(F.greatest(place, F.lit(0)), F.lit(n - 1)).cast("int")
        out = own.select("id", *names, F.concat("path", F.lit("."), digit.cast("string")).alias("path"))
        nodes *= n
    return out


def flatten(assigned: DataFrame) -> DataFrame:
    """Leaves as parts of one level: the path is the part."""
    return assigned.withColumnRenamed("path", "part")


def prefix_counts(assigned: DataFrame) -> DataFrame:
    """(path, n) of every node: each leaf counts for all prefixes of its path."""
    leaves = assigned.groupBy("path").agg(F.count("*").alias("n"))
    nodes = leaves.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))).alias("path"))
    return nodes.groupBy("path").agg(F.sum("n").alias("n"))


def tree_dump(assigned: DataFrame) -> DataFrame:
    """A line per node, indented by its depth, with its size."""
    line = F.concat(F.repeat(F.lit("-"), F.length("path") - 1), F.lit(" "), F.col("path"), F.lit(" "), F.col("n").cast("string"))
    return prefix_counts(assigned).select("path", line.alias("line"))
