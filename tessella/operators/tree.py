"""Meshes merged bottom-up: parts are leaves of a tree of adjacent parts, siblings are merged level by level."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.boxes import bounding_boxes, intersects_sphere
from tessella.functions.vectors import axes
from tessella.operators.checkers import SLACK
from tessella.operators.mesh import local_meshes
from tessella.operators.partition import assign, depth_within, flatten
from tessella.sources.scratch import settle

#: Siblings that are merged at once.
FAN = 8
#: Levels that skewed points may need besides those that evenly spread ones do.
SKEW_LEVELS = 8
#: A border of more than this share of a group's points isn't parted again: it wouldn't get smaller.
LEAST_GAIN = 0.9
#: Nodes and ids that a broadcast may hold.
BROADCAST_NODES, BROADCAST_IDS = 16_384, 4_000_000


class PartTree:
    """A tree over parts by the centres of their boxes: each node's children are up to FAN groups of adjacent parts.

    A node is the string of its digits, the root the empty one. It is built on the driver from a row for each part.
    """

    def __init__(self, rows: list, dim: int, fan: int = FAN):
        names = axes(dim)
        self.dim, self.fan = dim, fan
        self.low = np.array([[r[f"lo_{a}"] for a in names] for r in rows]).reshape(-1, dim)
        self.high = np.array([[r[f"hi_{a}"] for a in names] for r in rows]).reshape(-1, dim)
        self.leaf: dict[int, str] = {}
        self.near: dict[str, list] = {}
        self.points: dict[str, int] = {}
        size = np.array([r["n"] for r in rows], np.int64)
        todo = [("", np.arange(len(rows)))] if rows else []
        while todo:
            node, own = todo.pop()
            self.points[node] = int(size[own].sum())
            if len(own) == 1:
                self.leaf[int(own[0])] = node
                continue
            groups = [own]
            while len(groups) < fan and max(map(len, groups)) > 1:
                groups.sort(key=len)
                groups += self._halves(groups.pop())
            boxes = [[*map(float, self.low[g].min(0)), *map(float, self.high[g].max(0))] for g in groups]
            for k, g in enumerate(groups):
                self.near[f"{node}{k}"] = boxes[:k] + boxes[k + 1 :]
                todo.append((f"{node}{k}", g))
        self.depth = max(map(len, self.near), default=0)

    def _halves(self, own: np.ndarray) -> list[np.ndarray]:
        middle = (self.low[own] + self.high[own]) / 2
        wide = int(np.argmax(middle.max(0) - middle.min(0)))
        order = own[np.argsort(middle[:, wide], kind="stable")]
        return [order[: len(order) // 2], order[len(order) // 2 :]]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(node, near, outside): the siblings' boxes, and all boxes that together hold every point outside the node."""
        rows = [(node, near, [b for k in range(1, len(node) + 1) for b in self.near[node[:k]]]) for node, near in self.near.items()]
        return spark.createDataFrame(rows, "node string, near array<array<double>>, outside array<array<double>>")


def _reached(boxes: str, dim: int) -> Column:
    """Whether the row's sphere meets one of the boxes; no boxes, no."""
    centre = [F.col("centre")[k] for k in range(dim)]
    meets = lambda b: intersects_sphere(([b[k] for k in range(dim)], [b[dim + k] for k in range(dim)]), centre, F.col("square_radius") * (1 + SLACK))
    return F.coalesce((F.col("kind") == "s") & F.exists(boxes, meets), F.lit(False))


def merged(assigned: DataFrame, dim: int, task_points: int, level: int = 0) -> DataFrame:
    """(kind, v, centre, square_radius) of points(id, x, ..., part): the simplices and hull faces of the whole mesh.

    Each part is meshed. A simplex is done when no box outside its node meets its sphere; the others are open. From the deepest
    level up, siblings are merged: the vertices of their open simplices that a sibling's box reaches, and of their hulls,
    are the border of the group, which is meshed by itself; of it those simplices stay that span siblings or that were
    there before. So a level handles open simplices only, and each group's border by its own. A border of over
    `task_points` points is parted and merged by a tree of its own, unless that leaves nearly all its points at borders.
    """
    spark, names = assigned.sparkSession, axes(dim)
    finite = assigned.where("id >= 0")
    far = assigned.where("id < 0").select("id", *names).dropDuplicates(["id"])
    points = finite.select("id", *names).unionByName(far)
    far_ids = [r["id"] for r in far.select("id").collect()]  # 2^dim at most
    sizes = finite.groupBy("part").agg(F.count("*").alias("n"))
    parts = bounding_boxes(finite, names, "part").join(sizes, "part").orderBy("part").collect()
    tree = PartTree(parts, dim)
    nodes = tree.frame(spark)
    nodes = F.broadcast(nodes) if len(tree.near) <= BROADCAST_NODES else nodes
    leaves = spark.createDataFrame([(str(parts[k]["part"]), node) for k, node in tree.leaf.items()], "part string, node string")
    leaves = F.broadcast(leaves) if len(parts) <= BROADCAST_NODES else leaves
    columns = ["node", "kind", "v", "centre", "square_radius"]

    def classed(rows: DataFrame) -> DataFrame:
        return rows.select(*columns).join(nodes.select("node", "outside"), "node", "left").withColumn("open", _reached("outside", dim)).drop("outside")

    state = settle(classed(local_meshes(assigned, dim).join(leaves, "part")), "pieces")
    done = []
    for k in range(tree.depth, 0, -1):
        done.append(state.where("kind = 's' and not open"))
        live = state.where("kind <> 's' or open")
        kids = live.where(F.length("node") == k).join(nodes.select("node", "near"), "node")
        kids = settle(kids.select(*columns, _reached("near", dim).alias("flagged"), F.substring("node", 1, k - 1).alias("group")), "siblings")
        ends = kids.where("flagged or kind <> 's'").select("group", "node", F.explode("v").alias("id")).where("id >= 0").distinct()
        if far_ids:
            ends = ends.unionByName(kids.select("group", F.lit("").alias("node"), F.explode(F.array(*[F.lit(i).cast("long") for i in far_ids])).alias("id")).distinct())
        ends = settle(ends, "ends")
        border = settle(points.join(F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends, "id"), "border")
        large = border.groupBy("group").count().where(F.col("count") > task_points).collect()  # no more than tasks of this level
        apart = [r for r in large if r["count"] < LEAST_GAIN * tree.points[r["group"]]]
        rest = border.where(~F.col("group").isin([r["group"] for r in apart])) if apart else border
        meshes = [local_meshes(rest.withColumn("part", F.col("group")), dim)]
        for r in apart:
            own = border.where(F.col("group") == r["group"])
            cut = flatten(assign(own.where("id >= 0"), dim, "c" if level % 2 else "e", depth_within("e", dim, r["count"], task_points) + SKEW_LEVELS, task_points))
            meshes.append(merged(settle(with_far(cut, own.where("id < 0"), dim), "parted"), dim, task_points, level + 1).withColumn("part", F.lit(r["group"])))
        made = settle(reduce(DataFrame.unionByName, meshes).withColumnRenamed("part", "group"), "group-meshes")
        simplices = made.where("kind = 's'")
        homes = simplices.select("group", "v", F.explode("v").alias("id")).where("id >= 0").join(border.select("group", "id", "node"), ["group", "id"])
        spans = homes.groupBy("group", "v").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("group", "v")
        before = kids.where("flagged").select("group", "v")
        kept = simplices.join(spans.unionByName(before), ["group", "v"], "left_semi").unionByName(made.where("kind <> 's'").select("group", "v", "kind", "centre", "square_radius"))
        stayed = kids.where("kind = 's' and not flagged").select("group", "v", "kind", "centre", "square_radius")
        state = settle(classed(kept.unionByName(stayed).withColumnRenamed("group", "node")).unionByName(live.where(F.length("node") < k)), "merged")
    return reduce(DataFrame.unionByName, [*done, state]).select("kind", "v", "centre", "square_radius")


def with_far(assigned: DataFrame, far: DataFrame, dim: int) -> DataFrame:
    """Each far point in each part: 2^dim rows a part."""
    parts = assigned.select("part").distinct().withColumn("one", F.lit(1))
    copies = far.withColumn("one", F.lit(1)).join(parts, "one").select("id", *axes(dim), "part")
    return assigned.select("id", *axes(dim), "part").unionByName(copies)
