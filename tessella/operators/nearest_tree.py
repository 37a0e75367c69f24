"""Nearest neighbours of points among samples or boxes: a k-d tree in flat arrays, searched for batches of points."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import axes
from tessella.sources.scratch import settle

#: Items of a leaf; points searched for at once; pairs of points and nodes, or points and items, held at once.
LEAF, BATCH, PAIRS = 32, 4096, 1 << 20
#: Rows of the sample that a task holds; rows of it that the cells of a larger one are made from; points of a group.
CELL_ROWS, CELL_SAMPLE, GROUP_POINTS = 100_000, 200_000, 1 << 19
#: Cells at most, as their boxes are broadcast; beyond it cells hold more rows.
MOST_CELLS = 16_384


class KdTree:
    """Items are boxes low..high (points, if they are equal); of equal items the first counts.

    Nodes are halved at the median of the item centres in their widest direction until they have `leaf` items. `low` and
    `high` of a node enclose its items, so what lies farther away than the best item found is left out as a whole.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, leaf: int = LEAF):
        keys = np.concatenate([low, high], 1)
        _, first = np.unique(keys, axis=0, return_index=True) if len(keys) else (None, np.zeros(0, np.int64))
        self.items = np.sort(first)
        self.item_low, self.item_high = low[self.items], high[self.items]
        middle, order = self.item_low / 2 + self.item_high / 2, np.arange(len(self.items))
        bounds, left, axis, split = [(0, len(order))], [], [], []
        for start, stop in bounds:  # grows while it is read
            own = middle[order[start:stop]]
            d = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
            at = np.sort(own[:, d])[(len(own) - 1) // 2] if len(own) > leaf else 0.0
            right = own[:, d] > at if len(own) > leaf else np.zeros(0, bool)
            if len(own) > leaf and not right.any():  # the upper half is one value
                at = own[:, d][own[:, d] < at].max(initial=-np.inf)
                right = own[:, d] > at
            if not right.any() or right.all():
                left.append(-1)
            else:
                order[start:stop] = np.concatenate([order[start:stop][~right], order[start:stop][right]])
                left.append(len(bounds))
                bounds += [(start, stop - int(right.sum())), (stop - int(right.sum()), stop)]
            axis.append(d)
            split.append(at)
        self.start, self.stop = np.array(bounds).T
        self.left, self.axis, self.split = np.array(left), np.array(axis), np.array(split)
        self.item_low, self.item_high, self.items = self.item_low[order], self.item_high[order], self.items[order]
        if len(order):  # leaves lie in the order of their starts; a node's box is that of its range
            self.low = np.array([self.item_low[a:b].min(0) for a, b in bounds])
            self.high = np.array([self.item_high[a:b].max(0) for a, b in bounds])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf on whose side of all splits each point lies."""
        node = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(self.left[node] >= 0)):
            n = node[open_]
            node[open_] = self.left[n] + (x[open_, self.axis[n]] > self.split[n])
        return node

    @staticmethod
    def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for d in range(x.shape[1]):
            out += (np.maximum(low[:, d] - x[:, d], 0) + np.maximum(x[:, d] - high[:, d], 0)) ** 2
        return out

    def within(self, x: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, leaf) of leaves no farther from a point than its square distance; None if there are too many at once."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, leaves = [], []
        while len(row):
            near = self._gap(x[row], self.low[node], self.high[node]) <= square[row]
            row, node = row[near], node[near]
            done = self.left[node] < 0
            rows.append(row[done])
            leaves.append(node[done])
            row, node = np.repeat(row[~done], 2), np.repeat(self.left[node[~done]], 2)
            node[1::2] += 1
            if len(x) > 1 and len(row) + sum(map(len, rows)) * LEAF > PAIRS:
                return None
        return np.concatenate(rows), np.concatenate(leaves)

    def _best(self, x: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each point the square distance and the item of the nearest in its leaves; the smallest item of equals."""
        order = np.argsort(row, kind="stable")
        row, leaf = row[order], leaf[order]
        size = self.stop[leaf] - self.start[leaf]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.start[leaf], size)
        row = np.repeat(row, size)
        square, item = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)
        gap = self._gap(x[row], self.item_low[at], self.item_high[at])
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.fmin.reduceat(gap, first)
            square[row[first]] = least
            same = gap == square[row]
            item[row[first]] = np.minimum.reduceat(np.where(same, self.items[at], np.iinfo(np.int64).max), first)
        return square, item, len(row)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(square, item, compared): the nearest item of each point, and how many items points were compared with.

        A point with a coordinate that isn't finite is equally far from all: it has item 0.
        """
        square, item, compared = np.full(len(x), np.inf), np.zeros(len(x), np.int64), 0
        todo = [np.flatnonzero(np.isfinite(x).all(1))[k : k + BATCH] for k in range(0, len(x), BATCH)] if len(self.items) else []
        while todo:
            rows = todo.pop()
            own = x[rows]
            bound, _, n = self._best(own, np.arange(len(own)), self.home(own))
            compared += n
            found = self.within(own, bound)
            if found is None:
                todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
                continue
            square[rows], item[rows], n = self._best(own, *found)
            compared += n
        return square, item, compared


def _coordinates(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(a).to_numpy(zero_copy_only=False).astype(np.float64) for a in names], 1) if batch.num_rows else np.zeros((0, len(names)))


def by_broadcast(points: DataFrame, names: list[str], low: np.ndarray, high: np.ndarray, values: pa.Table, schema: str) -> DataFrame:
    """points' id and the values of the nearest of items low..high, that are in the order of preference."""
    shared = points.sparkSession.sparkContext.broadcast((KdTree(low, high), values))

    def run(batches):
        tree, values = shared.value
        for batch in batches:
            _, item, _ = tree.nearest(_coordinates(batch, names))
            own = values.take(pa.array(item)) if values.num_rows else pa.table({n: pa.nulls(batch.num_rows, values[n].type) for n in values.column_names})
            yield pa.RecordBatch.from_arrays([batch.column(0), *[c.combine_chunks() for c in own.columns]], ["id", *values.column_names])

    return points.select("id", *names).mapInArrow(run, f"id long, {schema}")


def by_cells(points: DataFrame, sample: DataFrame, dim: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, idx, part) of the nearest of sample(idx, x, ..., part), the smallest idx of equals, for a sample of any size.

    A tree of a bounded part of the sample makes cells. Points and sample rows are shuffled to their cells and searched
    for there; what is found bounds the distance, and a second round sends a point to those other cells whose box is
    no farther away. Cells with many points are dealt to several tasks.
    """
    names = axes(dim)
    finite = reduce(and_, [F.col(a).isNotNull() & ~F.isnan(F.col(a)) & (F.abs(F.col(a)) < float("inf")) for a in names])
    whole = settle(sample.where(finite).groupBy(*[F.col(a).cast("double").alias(a) for a in names]).agg(F.min(F.struct("idx", "part")).alias("best")).select(*names, "best.*"), "places")
    n = whole.count()
    some = whole.orderBy(F.xxhash64("idx"), "idx").limit(CELL_SAMPLE).select(*names).toArrow()
    at = np.stack([some.column(a).to_numpy() for a in names], 1)
    top = KdTree(at, at, max(1, -(-len(at) * max(cell_rows, -(-2 * n // MOST_CELLS)) // max(n, 1))))
    session = points.sparkSession
    tree = session.sparkContext.broadcast(top)

    def deal(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.home(_coordinates(batch, names)))], [*batch.schema.names, "cell"])

    place = ", ".join(f"{a} double" for a in names)
    kind = sample.schema["part"].dataType.simpleString()
    kept = settle(whole.mapInArrow(deal, f"{place}, idx long, part {kind}, cell long"), "cells")
    ends = kept.groupBy("cell").agg(*[f(a).alias(f"{e}_{a}") for a in names for e, f in (("lo", F.min), ("hi", F.max))]).toPandas()  # a row for each cell
    top.low, top.high = np.full((len(top.left), dim), np.inf), np.full((len(top.left), dim), -np.inf)
    top.low[ends.cell], top.high[ends.cell] = ends[[f"lo_{a}" for a in names]].to_numpy(), ends[[f"hi_{a}" for a in names]].to_numpy()
    for node in range(len(top.left) - 1, -1, -1):  # children come after their parents
        if top.left[node] >= 0:
            both = slice(top.left[node], top.left[node] + 2)
            top.low[node], top.high[node] = top.low[both].min(0), top.high[both].max(0)
    boxes = session.sparkContext.broadcast(top)
    own = points.select("id", *[F.col(a).cast("double").alias(a) for a in names])

    def search(asked: DataFrame, name: str) -> DataFrame:
        """(id, x, ..., cell, square, idx, part) of the nearest in each point's cell."""
        counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_POINTS).cast("int").alias("shares"))
        counts = F.broadcast(settle(counts, "shares"))  # a row for each cell
        dealt = asked.join(counts, "cell").withColumn("share", F.pmod(F.xxhash64("id", *names), F.col("shares").cast("long")).cast("int")).drop("shares")
        copies = kept.join(counts, "cell").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.combine_chunks(), right.sort_by("idx").combine_chunks()
            y = _coordinates(right, names)
            square, item, _ = KdTree(y, y).nearest(_coordinates(left, names))
            found = right.select(["idx", "part"]).take(pa.array(item)) if right.num_rows else pa.table({c: pa.nulls(left.num_rows, right.schema.field(c).type) for c in ("idx", "part")})
            out = {c: left[c] for c in ("id", *names, "cell")} | {"square": pa.array(square), "idx": found["idx"], "part": found["part"]}
            return pa.table(out)

        both = dealt.groupBy("cell", "share").cogroup(copies.groupBy("cell", "share"))
        return settle(both.applyInArrow(run, f"id long, {place}, cell long, square double, idx long, part {kind}"), name)

    first = search(own.where(finite).mapInArrow(deal, f"id long, {place}, cell long"), "first-cells")

    def others(batches):
        for batch in batches:
            x, square, home = _coordinates(batch, names), batch.column("square").to_numpy(), batch.column("cell").to_numpy()
            todo = [np.arange(k, min(k + BATCH, len(x))) for k in range(0, len(x), BATCH)]
            while todo:
                rows = todo.pop()
                found = boxes.value.within(x[rows], square[rows])
                if found is None:
                    todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
                    continue
                row, cell = rows[found[0]], found[1]
                row, cell = row[cell != home[row]], cell[cell != home[row]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in ("id", *names)], pa.array(cell)], ["id", *names, "cell"])

    again = first.select("id", *names, "cell", "square").mapInArrow(others, f"id long, {place}, cell long")
    second = search(settle(again, "other-cells"), "second-cells")
    found = first.unionByName(second).groupBy("id", *names).agg(F.min(F.struct("square", "idx", "part")).alias("best"))
    out = found.select("id", "best.idx", "best.part")
    least = sample.agg(F.min(F.struct("idx", "part")).alias("best")).select("best.*").first()
    types = sample.schema
    rest = own.where(~finite).select("id", *[F.lit(least[c]).cast(types[c].dataType).alias(c) for c in ("idx", "part")])
    return out.unionByName(rest)
