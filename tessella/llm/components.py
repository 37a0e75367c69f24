"""Connected components of a link table, in Spark, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import settle


#: Edges that one task handles by itself; more are dealt out.
FEW_EDGES = 16_384


def _forest(batches):
    """(u, m): each vertex but the roots with the smallest vertex that it reaches, of at most FEW_EDGES edges."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for u, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, m = top(u), top(m)
            up[max(u, m)] = min(u, m)
    ends = [x for x in up if top(x) != x]
    if ends:
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(ends, kind), pa.array([top(x) for x in ends], kind)], ["u", "m"])


def connected_components(links: DataFrame) -> DataFrame:
    """(v, root) for each vertex of links(a, b); root is the smallest vertex that can be reached.

    Vertices are of any type with an order. Self links and repeated links are allowed; a link with a null end
    is dropped. An empty table gives an empty result. Only minima are grouped, with a partial aggregate per
    task, and neighbours are never gathered into lists, so a hub with very many links doesn't overload a task.
    At most FEW_EDGES edges are one task's work instead, as each round has a fixed cost.
    """
    ends = links.where("a is not null and b is not null")
    vertices = settle(ends.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "vertices")
    edges = ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).distinct()
    edges = settle(edges, "edges")
    before, few = None, edges.count() <= FEW_EDGES
    if few:
        edges = settle(edges.coalesce(1).mapInArrow(_forest, edges.schema), "edges")
    while not few:
        both = edges.select("u", F.col("m").alias("w")).union(edges.select(F.col("m").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("low"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("low").alias("m")).distinct()
        large = settle(large, "large")
        low = large.groupBy("u").agg(F.min("m").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("low").alias("m")), F.struct(F.col("u"), F.col("low").alias("m")))).alias("e"))
        edges = settle(small.select("e.u", "e.m").where("u <> m").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "m").cast("long")), F.sum(F.xxhash64("m", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return vertices.join(edges, vertices.v == edges.u, "left").select("v", F.coalesce("m", "v").alias("root"))
