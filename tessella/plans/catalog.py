"""The queries of the mesh library over the driver's tables, and the SQL that gives the same rows.

Every query runs over whole tables. Meshes in 2-D have SQL of cubic cost, which the embeddings' size allows; those
in 3-D have none and are tested against brute force on small fixtures.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import boxes, grid, scalars, simplices
from tessella.functions.vectors import above_plane, axes, columns, square_distance
from tessella.operators import checkers, locate, mesh, order, partition, sample, sets, stats, triangulate, validate
from tessella.sources import generators, points, reports
from tessella.sources.scratch import settle, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "mesh_embeddings_2d"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- point views ---


def emb(spark: SparkSession, d: str, dim: int) -> DataFrame:
    return points.view(_table(spark, d, "embeddings"), F.col("vec_id") + 1, *[F.col("embedding")[k] for k in range(dim)])


def li2(spark: SparkSession, d: str) -> DataFrame:
    return points.view(_table(spark, d, "lineitem"), F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice"))


def cust2(spark: SparkSession, d: str) -> DataFrame:
    return points.view(_table(spark, d, "customer"), F.col("c_custkey") + 1, F.col("c_custkey"), F.col("c_acctbal"))


def part2(spark: SparkSession, d: str) -> DataFrame:
    return points.view(_table(spark, d, "part"), F.col("p_partkey") + 1, F.col("p_size"), F.col("p_retailprice"))


EMB2 = "p AS (SELECT vec_id + 1 AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
LI2 = "p AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem)"
CUST2 = "p AS (SELECT c_custkey + 1 AS id, c_custkey::DOUBLE AS x, c_acctbal::DOUBLE AS y FROM customer)"
PART2 = "p AS (SELECT p_partkey + 1 AS id, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part)"
MID = "m AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM p)"

# --- statistics and partitioners ---


@query("point_stats", f"WITH {LI2} SELECT min(x) AS min_x, (min(x) + max(x)) / 2 AS mid_x, max(x) AS max_x, min(y) AS min_y, (min(y) + max(y)) / 2 AS mid_y, max(y) AS max_y FROM p")
def _(spark, d):
    return stats.point_stats(li2(spark, d), 2)


@query("point_stats_3d", "WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) SELECT min(x) AS min_x, (min(x) + max(x)) / 2 AS mid_x, max(x) AS max_x, min(y) AS min_y, (min(y) + max(y)) / 2 AS mid_y, max(y) AS max_y, min(z) AS min_z, (min(z) + max(z)) / 2 AS mid_z, max(z) AS max_z FROM p")
def _(spark, d):
    return stats.point_stats(emb(spark, d, 3), 3)


def _sizes(kind: str, depth: int = 1) -> Query:
    return lambda spark, d: stats.part_sizes(partition.flatten(partition.assign(li2(spark, d), 2, kind, depth)))


query("part_sizes_orthants", f"WITH {LI2}, {MID} SELECT '0' || (CASE WHEN x > mx THEN 1 ELSE 0 END + CASE WHEN y > my THEN 2 ELSE 0 END)::VARCHAR AS part, count(*) AS n FROM p, m GROUP BY 1")(_sizes("d"))
query("part_sizes_one_dim", f"WITH {LI2}, {MID} SELECT CASE WHEN y > my THEN '01' ELSE '00' END AS part, count(*) AS n FROM p, m GROUP BY 1")(_sizes("1"))
_LEVEL = "a AS (SELECT id, x, y, CASE WHEN x > mx THEN '01' ELSE '00' END AS path FROM p, m), s AS (SELECT path, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM a GROUP BY path)"
query("part_sizes_cycle", f"WITH {LI2}, {MID}, {_LEVEL} SELECT a.path || CASE WHEN y > (ay + by_) / 2 THEN '1' ELSE '0' END AS part, count(*) AS n FROM a JOIN s ON a.path = s.path GROUP BY 1")(_sizes("c", 2))
query(
    "part_sizes_extend",
    f"WITH {LI2}, {MID}, w AS (SELECT max(x) - min(x) >= max(y) - min(y) AS wide FROM p), a AS (SELECT id, x, y, CASE WHEN CASE WHEN wide THEN x > mx ELSE y > my END THEN '01' ELSE '00' END AS path FROM p, m, w), s AS (SELECT path, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM a GROUP BY path) SELECT a.path || CASE WHEN CASE WHEN bx - ax >= by_ - ay THEN x > (ax + bx) / 2 ELSE y > (ay + by_) / 2 END THEN '1' ELSE '0' END AS part, count(*) AS n FROM a JOIN s ON a.path = s.path GROUP BY 1",
)(_sizes("e", 2))


@query("part_sizes_slabs", f"WITH {CUST2}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM p), a AS (SELECT id, y, '0.' || least(greatest(floor((x - lo) / (hi - lo) * 4), 0), 3)::INT::VARCHAR AS path FROM p, b), s AS (SELECT path, min(y) AS lo, max(y) AS hi FROM a GROUP BY path) SELECT a.path || '.' || least(greatest(floor((y - lo) / (hi - lo) * 2), 0), 1)::INT::VARCHAR AS part, count(*) AS n FROM a JOIN s ON a.path = s.path GROUP BY 1")
def _(spark, d):
    return stats.part_sizes(partition.flatten(partition.assign_slabs(cust2(spark, d), 2, 8)))


@query("tree_rollup", f"WITH {LI2}, {MID}, {_LEVEL}, l AS (SELECT a.path || CASE WHEN y > (ay + by_) / 2 THEN '1' ELSE '0' END AS path FROM a JOIN s ON a.path = s.path), n AS (SELECT substr(path, 1, k) AS path FROM l, (SELECT unnest([1, 2, 3]) AS k)) SELECT path, count(*) AS n FROM n GROUP BY path")
def _(spark, d):
    return partition.prefix_counts(partition.assign(li2(spark, d), 2, "c", 2))


@query("tree_dump", f"WITH {LI2}, {MID}, {_LEVEL}, l AS (SELECT path FROM a UNION ALL SELECT '0' FROM a), n AS (SELECT path, count(*) AS n FROM l GROUP BY path) SELECT path, repeat('-', length(path) - 1) || ' ' || path || ' ' || n::VARCHAR AS line FROM n")
def _(spark, d):
    return partition.tree_dump(partition.assign(li2(spark, d), 2, "c", 1))


@query("part_boxes", "SELECT l_returnflag AS part, min(l_quantity) AS lo_x, max(l_quantity) AS hi_x, min(l_extendedprice) AS lo_y, max(l_extendedprice) AS hi_y FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return stats.bounding_boxes(rows, ["x", "y"], "part")


@query("part_centres", "SELECT l_returnflag AS part, sum(l_quantity) / count(*) AS x, sum(l_linenumber)::DOUBLE / count(*) AS y FROM lineitem GROUP BY 1")
def _(spark, d):
    return stats.centres(_flagged(spark, d), 2)


@query("part_centres_shrunk", "SELECT l_returnflag AS part, sum(l_quantity) / (count(*) + 1) AS x, sum(l_linenumber)::DOUBLE / (count(*) + 1) AS y FROM lineitem GROUP BY 1")
def _(spark, d):
    return stats.centres(_flagged(spark, d), 2, shrunk=True)


def _flagged(spark, d):
    return _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"))


# --- grid ---


@query("grid_cells", f"WITH {LI2} SELECT floor(x / 5.0)::BIGINT AS cell_x, floor(y / 1000.0)::BIGINT AS cell_y, count(*) AS n FROM p GROUP BY 1, 2")
def _(spark, d):
    rows = li2(spark, d)
    return rows.groupBy(grid.cell_of([F.col("x")], 5.0)[0].alias("cell_x"), grid.cell_of([F.col("y")], 1000.0)[0].alias("cell_y")).agg(F.count("*").alias("n"))


@query("grid_bounds", f"WITH {CUST2}, c AS (SELECT id, floor(x / 64.0)::BIGINT AS cx, floor(y / 64.0)::BIGINT AS cy FROM p) SELECT id, cx * 64.0::DOUBLE AS lo_x, (cx + 1) * 64.0::DOUBLE AS hi_x, (cy + 0.5::DOUBLE) * 64.0::DOUBLE AS mid_y, (0 * 31 + cx) * 31 + cy AS h FROM c")
def _(spark, d):
    cell = grid.cell_of(columns("x y"), 64.0)
    low, high = grid.cell_bounds(cell, 64.0)
    return cust2(spark, d).select("id", low[0].alias("lo_x"), high[0].alias("hi_x"), grid.cell_centre(cell, 64.0)[1].alias("mid_y"), grid.cell_hash(cell).alias("h"))


@query("part_cells", "SELECT DISTINCT l_returnflag AS part, floor(l_quantity / 10.0)::BIGINT AS cell_x, floor(l_linenumber::DOUBLE / 10.0)::BIGINT AS cell_y FROM lineitem")
def _(spark, d):
    return stats.part_cells(_flagged(spark, d), 2, 10.0)


@query("cell_points", f"WITH {PART2} SELECT floor(x / 16.0)::BIGINT AS cell_x, floor(y / 16.0)::BIGINT AS cell_y, id FROM p")
def _(spark, d):
    return stats.cell_points(part2(spark, d), 2, 16.0)


@query("grid_meets_sphere", f"WITH {PART2}, c AS (SELECT id, floor(x / 16.0)::BIGINT * 16.0::DOUBLE AS lx, floor(y / 16.0)::BIGINT * 16.0::DOUBLE AS ly, (floor(x / 16.0)::BIGINT + 1) * 16.0::DOUBLE AS hx, (floor(y / 16.0)::BIGINT + 1) * 16.0::DOUBLE AS hy FROM p) SELECT id, power(greatest(lx - 25, 0) + greatest(25 - hx, 0), 2) + power(greatest(ly - 1000, 0) + greatest(1000 - hy, 0), 2) <= 10000 AS meets FROM c")
def _(spark, d):
    cell = grid.cell_of(columns("x y"), 16.0)
    return part2(spark, d).select("id", grid.cell_meets_sphere(cell, 16.0, [F.lit(25.0), F.lit(1000.0)], F.lit(10000.0)).alias("meets"))


# --- boxes, vectors, scalars ---

_E = [f"embedding[{k + 1}]::DOUBLE" for k in range(15)]


def _vec(first: int, n: int) -> list[Column]:
    return [F.col("embedding")[k].cast("double") for k in range(first, first + n)]


_BOX = "e AS (SELECT vec_id, " + ", ".join(f"{c} AS e{k}" for k, c in enumerate(_E)) + " FROM embeddings), b AS (SELECT *, least(e0, e2) AS lx, greatest(e0, e2) AS hx, least(e1, e3) AS ly, greatest(e1, e3) AS hy FROM e)"


def _emb_box():
    a, b = _vec(0, 2), _vec(2, 2)
    return [F.least(p, q) for p, q in zip(a, b)], [F.greatest(p, q) for p, q in zip(a, b)]


@query(
    "box_predicates",
    f"WITH {_BOX} SELECT vec_id, e4 BETWEEN lx AND hx AND e5 BETWEEN ly AND hy AS has_point, lx <= least(e4, e6) AND greatest(e4, e6) <= hx AND ly <= least(e5, e7) AND greatest(e5, e7) <= hy AS has_box, (greatest(lx - e4, 0) + greatest(e4 - hx, 0)) * (greatest(lx - e4, 0) + greatest(e4 - hx, 0)) + (greatest(ly - e5, 0) + greatest(e5 - hy, 0)) * (greatest(ly - e5, 0) + greatest(e5 - hy, 0)) <= e6 * e6 AS meets_sphere, e4 BETWEEN lx AND hx AND e5 BETWEEN ly AND hy AND least((e4 - lx) * (e4 - lx), (hx - e4) * (hx - e4)) >= e6 * e6 AND least((e5 - ly) * (e5 - ly), (hy - e5) * (hy - e5)) >= e6 * e6 AS has_sphere FROM b",
)
def _(spark, d):
    box, p, q, r = _emb_box(), _vec(4, 2), _vec(6, 2), _vec(6, 1)[0]
    other = [F.least(a, b) for a, b in zip(p, q)], [F.greatest(a, b) for a, b in zip(p, q)]
    return _table(spark, d, "embeddings").select(
        "vec_id", boxes.contains_point(box, p).alias("has_point"), boxes.contains_box(box, other).alias("has_box"),
        boxes.intersects_sphere(box, p, r * r).alias("meets_sphere"), boxes.contains_sphere(box, p, r * r).alias("has_sphere"),
    )


@query(
    "box_utilities",
    f"WITH {_BOX} SELECT vec_id, CASE WHEN e4 < lx THEN lx - e4 WHEN e4 > hx THEN hx - e4 ELSE 0 END AS gap_x, CASE WHEN e5 < ly THEN ly - e5 WHEN e5 > hy THEN hy - e5 ELSE 0 END AS gap_y, least(lx, e4) AS grown_lo_x, greatest(hy, e5) AS grown_hi_y, CASE WHEN e4 BETWEEN lx AND hx AND e5 BETWEEN ly AND hy THEN least(least(e4 - lx, hx - e4), least(e5 - ly, hy - e5)) ELSE sqrt(CASE WHEN e4 < lx THEN lx - e4 WHEN e4 > hx THEN hx - e4 ELSE 0 END * CASE WHEN e4 < lx THEN lx - e4 WHEN e4 > hx THEN hx - e4 ELSE 0 END + CASE WHEN e5 < ly THEN ly - e5 WHEN e5 > hy THEN hy - e5 ELSE 0 END * CASE WHEN e5 < ly THEN ly - e5 WHEN e5 > hy THEN hy - e5 ELSE 0 END) END AS border FROM b",
)
def _(spark, d):
    box, p = _emb_box(), _vec(4, 2)
    gap, grown = boxes.gap_vector(box, p), boxes.enlarge(box, p)
    return _table(spark, d, "embeddings").select("vec_id", gap[0].alias("gap_x"), gap[1].alias("gap_y"), grown[0][0].alias("grown_lo_x"), grown[1][1].alias("grown_hi_y"), boxes.boundary_distance(box, p).alias("border"))


@query("box_subtract", f"WITH {_BOX} SELECT vec_id, (lx + hx) / 2 AS lo_x, hx AS hi_x, ly AS lo_y, hy AS hi_y FROM b")
def _(spark, d):
    low, high = _emb_box()
    half, _ = boxes.split((low, high), 0, (low[0] + high[0]) / 2)
    rest = boxes.subtract((low, high), half)
    return _table(spark, d, "embeddings").select("vec_id", rest[0][0].alias("lo_x"), rest[1][0].alias("hi_x"), rest[0][1].alias("lo_y"), rest[1][1].alias("hi_y"))


@query("vector_algebra", f"WITH {_BOX} SELECT vec_id, (e0 - e3) * (e0 - e3) + (e1 - e4) * (e1 - e4) + (e2 - e5) * (e2 - e5) AS gap, sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS len, (e3 * e0 + e4 * e1 + e5 * e2) - 0.01::DOUBLE > 0 AS above FROM b")
def _(spark, d):
    from tessella.functions.vectors import length

    a, b = _vec(0, 3), _vec(3, 3)
    return _table(spark, d, "embeddings").select("vec_id", square_distance(a, b).alias("gap"), length(a).alias("len"), above_plane(a, b, 0.01).alias("above"))


@query("scalar_functions", "SELECT p_partkey, is_i, is_f, bits, scaled, weight FROM (SELECT p_partkey, regexp_matches(p_brand, '^[+\\-±]?[0-9]+$') AS is_i, regexp_matches(p_retailprice::VARCHAR, '^[+\\-±]?([0-9]+(\\.[0-9x]*)?|\\.[0-9]+)([eE][+\\-]?[0-9]+)?$') AS is_f, bit_count(p_partkey)::INT AS bits, trunc((least(greatest(p_retailprice, 900), 2000) - 900) / 1100 * 98 + 1)::INT AS scaled, 1 - p_size / 100.0::DOUBLE AS weight FROM part)")
def _(spark, d):
    return _table(spark, d, "part").select(
        "p_partkey", scalars.is_int(F.col("p_brand")).alias("is_i"), scalars.is_float(F.col("p_retailprice").cast("string")).alias("is_f"), scalars.popcount(F.col("p_partkey")).alias("bits"),
        scalars.rescale(F.col("p_retailprice"), 900.0, 2000.0, 1, 99).alias("scaled"), scalars.EDGE_WEIGHTS["linear"](F.col("p_size") / 100.0).alias("weight"),
    )


# --- simplex predicates: each embedding is a simplex and a point ---

_O2 = "((e0 - e4) * (e3 - e5) - (e1 - e5) * (e2 - e4))"


@query(
    "simplex_predicates_2d",
    f"WITH {_BOX}, r AS (SELECT *, {_O2} AS o, e0 - e6 AS ax, e1 - e7 AS ay, e2 - e6 AS bx, e3 - e7 AS by_, e4 - e6 AS cx, e5 - e7 AS cy FROM b), v AS (SELECT *, (ax * ax + ay * ay) * (bx * cy - by_ * cx) + (bx * bx + by_ * by_) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by_ - ay * bx) AS i, ((e6 - e4) * (e3 - e5) - (e7 - e5) * (e2 - e4)) / o AS s, ((e0 - e4) * (e7 - e5) - (e1 - e5) * (e6 - e4)) / o AS t FROM r) SELECT vec_id, o AS orientation, sign(o) * sign(i) >= 0 AS in_sphere, s >= 0 AND t >= 0 AND s + t <= 1 AS in_simplex, abs(-(e3 - e1) * (e6 - e0) + (e2 - e0) * (e7 - e1)) / (-(e3 - e1) * -(e3 - e1) + (e2 - e0) * (e2 - e0)) AS face_distance FROM v",
)
def _(spark, d):
    t, p = [_vec(0, 2), _vec(2, 2), _vec(4, 2)], _vec(6, 2)
    return _table(spark, d, "embeddings").select(
        "vec_id", simplices.orientation(t).alias("orientation"), simplices.in_sphere(t, p).alias("in_sphere"), simplices.in_simplex(t, p).alias("in_simplex"), simplices.face_distance(t[:2], p).alias("face_distance")
    )


@query("circumsphere_2d", f"WITH {_BOX}, r AS (SELECT *, e2 - e0 AS ax, e3 - e1 AS ay, e4 - e0 AS bx, e5 - e1 AS by_ FROM b), h AS (SELECT *, (ax * ax + ay * ay) / 2 AS ha, (bx * bx + by_ * by_) / 2 AS hb, ax * by_ - ay * bx AS w FROM r), c AS (SELECT *, (ha * by_ - hb * ay) / w AS cx, (hb * ax - ha * bx) / w AS cy FROM h) SELECT vec_id, e0 + cx AS cx, e1 + cy AS cy, cx * cx + cy * cy AS rr FROM c")
def _(spark, d):
    centre, rr = simplices.circumsphere([_vec(0, 2), _vec(2, 2), _vec(4, 2)])
    return _table(spark, d, "embeddings").select("vec_id", centre[0].alias("cx"), centre[1].alias("cy"), rr.alias("rr"))


@query("circumsphere_3d", f"WITH {_BOX}, r AS (SELECT *, e3 - e0 AS ax, e4 - e1 AS ay, e5 - e2 AS az, e6 - e0 AS bx, e7 - e1 AS by_, e8 - e2 AS bz, e9 - e0 AS cx, e10 - e1 AS cy, e11 - e2 AS cz FROM b), h AS (SELECT *, (ax * ax + ay * ay + az * az) / 2 AS ha, (bx * bx + by_ * by_ + bz * bz) / 2 AS hb, (cx * cx + cy * cy + cz * cz) / 2 AS hc, ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx) AS w FROM r), c AS (SELECT *, (ha * (by_ * cz - bz * cy) + hb * (cy * az - cz * ay) + hc * (ay * bz - az * by_)) / w AS ox, (ha * (bz * cx - bx * cz) + hb * (cz * ax - cx * az) + hc * (az * bx - ax * bz)) / w AS oy, (ha * (bx * cy - by_ * cx) + hb * (cx * ay - cy * ax) + hc * (ax * by_ - ay * bx)) / w AS oz FROM h) SELECT vec_id, e0 + ox AS cx, e1 + oy AS cy, e2 + oz AS cz, ox * ox + oy * oy + oz * oz AS rr FROM c")
def _(spark, d):
    centre, rr = simplices.circumsphere([_vec(0, 3), _vec(3, 3), _vec(6, 3), _vec(9, 3)])
    return _table(spark, d, "embeddings").select("vec_id", *[c.alias(n) for c, n in zip(centre, ("cx", "cy", "cz"))], rr.alias("rr"))


_D3 = "{0}x * ({1}y * {2}z - {1}z * {2}y) + {0}y * ({1}z * {2}x - {1}x * {2}z) + {0}z * ({1}x * {2}y - {1}y * {2}x)"


def _rows3(last: int, names: str, first: int = 0) -> str:
    return ", ".join(f"e{first + 3 * k + c} - e{last + c} AS {n}{a}" for k, n in enumerate(names) for c, a in enumerate("xyz"))


@query(
    "simplex_predicates_3d",
    f"WITH {_BOX}, r AS (SELECT *, {_rows3(9, 'pqr')}, {_rows3(12, 'aghd')}, e12 - e9 AS sx, e13 - e10 AS sy, e14 - e11 AS sz FROM e), v AS (SELECT *, {_D3.format('p', 'q', 'r')} AS o, (dx * dx + dy * dy + dz * dz) * ({_D3.format('a', 'g', 'h')}) - (hx * hx + hy * hy + hz * hz) * ({_D3.format('a', 'g', 'd')}) + (gx * gx + gy * gy + gz * gz) * ({_D3.format('a', 'h', 'd')}) - (ax * ax + ay * ay + az * az) * ({_D3.format('g', 'h', 'd')}) AS i FROM r), w AS (SELECT *, ({_D3.format('s', 'q', 'r')}) / o AS s, ({_D3.format('p', 's', 'r')}) / o AS t, ({_D3.format('p', 'q', 's')}) / o AS u FROM v) SELECT vec_id, o AS orientation, sign(o) * sign(i) >= 0 AS in_sphere, s >= 0 AND t >= 0 AND u >= 0 AND s + t + u <= 1 AS in_simplex FROM w",
)
def _(spark, d):
    t, p = [_vec(0, 3), _vec(3, 3), _vec(6, 3), _vec(9, 3)], _vec(12, 3)
    return _table(spark, d, "embeddings").select("vec_id", simplices.orientation(t).alias("orientation"), simplices.in_sphere(t, p).alias("in_sphere"), simplices.in_simplex(t, p).alias("in_simplex"))


@query("nearest_vertex", f"WITH {_BOX}, r AS (SELECT vec_id, (e0 - e6) * (e0 - e6) + (e1 - e7) * (e1 - e7) AS a, (e2 - e6) * (e2 - e6) + (e3 - e7) * (e3 - e7) AS b, (e4 - e6) * (e4 - e6) + (e5 - e7) * (e5 - e7) AS c FROM b) SELECT vec_id, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS k FROM r")
def _(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", simplices.nearest_vertex([_vec(0, 2), _vec(2, 2), _vec(4, 2)], _vec(6, 2)).alias("k"))


@query("vertex_sets", "SELECT l_orderkey, l_linenumber, list_has_any([l_orderkey, l_partkey, l_suppkey], [l_suppkey + 1, l_orderkey]) AS any_, list_has_all([l_orderkey, l_partkey, l_suppkey], [l_suppkey, l_orderkey]) AS all_, list_sort([l_orderkey, l_partkey, l_suppkey])[1] AS first FROM lineitem")
def _(spark, d):
    v = F.array("l_orderkey", "l_partkey", "l_suppkey")
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", simplices.contains_any(v, F.array(F.col("l_suppkey") + 1, "l_orderkey")).alias("any_"), simplices.contains_all(v, F.array("l_suppkey", "l_orderkey")).alias("all_"), simplices.sort_ids(v)[0].alias("first"))


# --- meshes ---

TRIANGLES = f"""WITH {EMB2},
t AS (SELECT a.id AS a, b.id AS b, c.id AS c, (a.x - c.x) * (b.y - c.y) - (a.y - c.y) * (b.x - c.x) AS s, (a.x - c.x) * (b.x - c.x) + (a.y - c.y) * (b.y - c.y) AS d
  FROM p a JOIN p b ON a.id < b.id JOIN p c ON c.id <> a.id AND c.id <> b.id),
e AS (SELECT a, b, min(d / s) FILTER (WHERE s > 0) AS l, max(d / s) FILTER (WHERE s < 0) AS r, arg_min(c, d / s) FILTER (WHERE s > 0) AS cl, arg_max(c, d / s) FILTER (WHERE s < 0) AS cr FROM t GROUP BY a, b),
k AS (SELECT * FROM e WHERE l IS NULL OR r IS NULL OR r <= l),
tri AS MATERIALIZED (SELECT DISTINCT v[1] AS v0, v[2] AS v1, v[3] AS v2 FROM (SELECT list_sort([a, b, cl]) AS v FROM k WHERE cl IS NOT NULL UNION ALL SELECT list_sort([a, b, cr]) FROM k WHERE cr IS NOT NULL)),
f AS MATERIALIZED (SELECT v0, v1, v2, v1 AS fa, v2 AS fb, 0 AS d FROM tri UNION ALL SELECT v0, v1, v2, v0, v2, 1 FROM tri UNION ALL SELECT v0, v1, v2, v0, v1, 2 FROM tri)
"""
_TRI = TRIANGLES + "SELECT v0, v1, v2 FROM tri"


def _flat(s: DataFrame, dim: int = 2) -> DataFrame:
    return s.select(*[F.col("v")[k].alias(f"v{k}") for k in range(dim + 1)])


def _mesh(dim: int = 2, kind: str = "c", depth: int = 2, **options) -> Query:
    return lambda spark, d: triangulate.triangulate(emb(spark, d, dim), dim, kind, depth, **options)


def _by(name: str, k: int = 4, **options) -> Query:
    def run(spark, d):
        own = mesh.distinct_points(emb(spark, d, 2), 2)
        return _flat(triangulate.triangulate(own, 2, assigned=sample.partition(own, 2, name, k, **options)))

    return run


@query("mesh_embeddings_2d", _TRI)
def _(spark, d):
    return _flat(_mesh(kind="d", depth=1)(spark, d))


query("mesh_cycle_grid_2d", _TRI)(lambda spark, d: _flat(_mesh(checker="grid", width=0.1)(spark, d)))
query("mesh_extend_accurate_grid_2d", _TRI)(lambda spark, d: _flat(_mesh(kind="e", checker="accurate-grid", width=0.1)(spark, d)))
query("mesh_slabs_2d", _TRI)(_by("kway"))
query("mesh_centre_distance_2d", _TRI)(_by("center-distance-pasp"))
query("mesh_bounds_distance_2d", _TRI)(_by("bounds-distance-pasp"))
query("mesh_nearest_sample_2d", _TRI)(_by("nearest-sample-pasp", weight="log"))
query("mesh_nearest_sample_halves_2d", _TRI)(_by("nearest-sample-pasb", cutoff=50))
query("mesh_hyperplane_2d", _TRI)(_by("hyperplane-sample-pasb", cutoff=50))
query("mesh_border_median_2d", _TRI)(_by("binary-besp", cutoff=50))


@query("mesh_one_task_2d", _TRI)
def _(spark, d):
    return _flat(mesh.mesh_of(emb(spark, d, 2), 2))


@query("mesh_embeddings_3d")
def _(spark, d):
    return _flat(_mesh(3, "e", 2)(spark, d), 3)


@query("mesh_far_points_2d")
def _(spark, d):
    return _flat(_mesh(far="mid")(spark, d))


@query("mesh_neighbours", TRIANGLES + "SELECT a.v0, a.v1, a.v2, a.d, b.v0 AS w0, b.v1 AS w1, b.v2 AS w2 FROM f a JOIN f b ON a.fa = b.fa AND a.fb = b.fb AND (a.v0, a.v1, a.v2) <> (b.v0, b.v1, b.v2)")
def _(spark, d):
    s = settle(_mesh()(spark, d), "mesh")
    pairs = s.select("v", F.posexplode("nb").alias("d", "nb")).where("nb is not null")
    other = s.select(F.col("id").alias("nb"), F.col("v").alias("w"))
    return pairs.join(other, "nb").select(*[F.col("v")[k].alias(f"v{k}") for k in range(3)], "d", *[F.col("w")[k].alias(f"w{k}") for k in range(3)])


@query("mesh_hull", TRIANGLES + "SELECT fa AS a, fb AS b FROM f GROUP BY 1, 2 HAVING count(*) = 1")
def _(spark, d):
    return mesh.hull_faces(_mesh()(spark, d)).select(F.col("face")[0].alias("a"), F.col("face")[1].alias("b"))


_ROL = "(((({0} & 4294967295) << ({0} & 31)) & 4294967295) | (({0} & 4294967295) >> (32 - ({0} & 31))))"
_FP = f"xor(xor({_ROL.format('v0')}, {_ROL.format('v1')}), {_ROL.format('v2')})"


@query("mesh_fingerprints", TRIANGLES + f"SELECT v0, v1, v2, {_FP} AS fp, xor({_FP}, {_ROL.format('v1')}) | 1 AS face_fp FROM tri")
def _(spark, d):
    s = _mesh()(spark, d)
    return s.select(*[F.col("v")[k].alias(f"v{k}") for k in range(3)], "fp", simplices.face_fingerprint(F.col("fp"), F.col("v")[1]).alias("face_fp"))


@query("mesh_hash", TRIANGLES + f"SELECT {_FP} & 255 AS bucket, bit_xor({_FP}) AS h FROM tri GROUP BY 1")
def _(spark, d):
    return stats.triangulation_hash(_mesh()(spark, d))


_EDGES = TRIANGLES + ", g AS (SELECT DISTINCT fa AS src, fb AS dst FROM f UNION SELECT DISTINCT fb, fa FROM f)"


@query("mesh_edges", _EDGES + " SELECT src, dst FROM g")
def _(spark, d):
    return mesh.mesh_edges(_mesh()(spark, d))


@query("mesh_degrees", _EDGES + " SELECT src, count(*) AS degree FROM g GROUP BY src")
def _(spark, d):
    return stats.degrees(mesh.mesh_edges(_mesh()(spark, d)))


@query("mesh_csr", _EDGES + ", n AS (SELECT src, count(*) AS degree FROM g GROUP BY src) SELECT src, degree, (sum(degree) OVER (ORDER BY src))::BIGINT AS offset FROM n")
def _(spark, d):
    return stats.csr_offsets(mesh.mesh_edges(_mesh()(spark, d)))


@query("mesh_adjacency", _EDGES + " SELECT src, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS nbrs FROM g GROUP BY src")
def _(spark, d):
    return order.adjacency(mesh.mesh_edges(_mesh()(spark, d))).select("src", F.array_join("nbrs", " ").alias("nbrs"))


@query("mesh_violations", "SELECT 'none' AS kind, 0::BIGINT AS simplex_id, 0::BIGINT AS other_id WHERE false")
def _(spark, d):
    own = emb(spark, d, 2)
    return validate.verify(settle(_mesh()(spark, d), "mesh"), mesh.distinct_points(own, 2), 2)


@query("mesh_cross_check", "SELECT 'none' AS kind, 0::BIGINT AS n WHERE false")
def _(spark, d):
    one = mesh.with_neighbours(mesh.identified(settle(mesh.mesh_of(emb(spark, d, 2), 2), "one")))
    return validate.cross_check(settle(_mesh()(spark, d), "mesh"), settle(one, "one")).groupBy("kind").agg(F.count("*").alias("n"))


@query("mesh_violations_3d", "SELECT 'none' AS kind, 0::BIGINT AS simplex_id, 0::BIGINT AS other_id WHERE false")
def _(spark, d):
    own = emb(spark, d, 3)
    return validate.verify(settle(_mesh(3, "e", 2)(spark, d), "mesh"), mesh.distinct_points(own, 3), 3)


def _gap_to_edge(a: str, b: str) -> str:
    """The square distance of (x, y) to the inner points of an edge, null beside it."""
    ex, ey, ox, oy = f"({b}x - {a}x)", f"({b}y - {a}y)", f"(x - {a}x)", f"(y - {a}y)"
    t = f"(({ox} * {ex} + {oy} * {ey}) / ({ex} * {ex} + {ey} * {ey}))"
    return f"CASE WHEN {t} > 0 AND {t} < 1 THEN ({ox} - {ex} * {t}) * ({ox} - {ex} * {t}) + ({oy} - {ey} * {t}) * ({oy} - {ey} * {t}) END"


_GAP = ", ".join([*[f"({c}x - x) * ({c}x - x) + ({c}y - y) * ({c}y - y)" for c in "ijk"], *[_gap_to_edge(*e) for e in ("ij", "ik", "jk")]])
_GEO = TRIANGLES + f""", q AS (SELECT p.id AS qid, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y FROM embeddings JOIN p ON p.id = vec_id + 1),
tv AS (SELECT v0, v1, v2, a.x AS ix, a.y AS iy, b.x AS jx, b.y AS jy, c.x AS kx, c.y AS ky FROM tri JOIN p a ON a.id = v0 JOIN p b ON b.id = v1 JOIN p c ON c.id = v2),
w AS (SELECT qid, x, y, v0, v1, v2, ix, iy, jx, jy, kx, ky, ((x - kx) * (jy - ky) - (y - ky) * (jx - kx)) / ((ix - kx) * (jy - ky) - (iy - ky) * (jx - kx)) AS s, ((ix - kx) * (y - ky) - (iy - ky) * (x - kx)) / ((ix - kx) * (jy - ky) - (iy - ky) * (jx - kx)) AS t FROM q, tv),
d AS (SELECT qid, v0, v1, v2, s >= 0 AND t >= 0 AND s + t <= 1 AS inside, least({_GAP}) AS gap FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY NOT inside, CASE WHEN inside THEN 0 ELSE gap END, v0, v1, v2) AS k FROM d)"""


@query("point_location", _GEO + " SELECT qid, inside, v0, v1, v2 FROM r WHERE k = 1")
def _(spark, d):
    s, own = settle(_mesh()(spark, d), "mesh"), emb(spark, d, 2)
    asked = _table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("qid"), F.col("embedding")[2].cast("double").alias("x"), F.col("embedding")[3].cast("double").alias("y"))
    found = settle(locate.locate(asked, s, own, 2, 0.05), "located")
    placed = mesh.with_coordinates(s, own, 2).select(F.col("id").alias("simplex_id"), "v", "at")
    both = found.join(placed, "simplex_id").join(asked, "qid")
    inside = simplices.in_simplex([[F.col("at")[k][a] for a in axes(2)] for k in range(3)], columns("x y"))
    return both.select("qid", inside.alias("inside"), *[F.col("v")[k].alias(f"v{k}") for k in range(3)])


# --- nearness joins ---


@query("nearest_centre", f"WITH {PART2}, c AS (SELECT l_returnflag AS part, sum(l_quantity) / count(*) AS x, sum(l_linenumber)::DOUBLE / count(*) AS y FROM lineitem GROUP BY 1), j AS (SELECT p.id, c.part, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.part) AS k FROM p, c) SELECT id, part FROM j WHERE k = 1")
def _(spark, d):
    return locate.nearest_centre(part2(spark, d), stats.centres(_flagged(spark, d), 2), 2)


@query("nearest_box", f"WITH {CUST2}, b AS (SELECT s_nationkey AS part, min(s_suppkey)::DOUBLE AS lx, max(s_suppkey)::DOUBLE AS hx, min(s_acctbal) AS ly, max(s_acctbal) AS hy FROM supplier GROUP BY 1), j AS (SELECT p.id, part, row_number() OVER (PARTITION BY p.id ORDER BY (greatest(lx - x, 0) + greatest(x - hx, 0)) * (greatest(lx - x, 0) + greatest(x - hx, 0)) + (greatest(ly - y, 0) + greatest(y - hy, 0)) * (greatest(ly - y, 0) + greatest(y - hy, 0)), part) AS k FROM p, b) SELECT id, part FROM j WHERE k = 1")
def _(spark, d):
    rows = _table(spark, d, "supplier").select(F.col("s_nationkey").alias("part"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return locate.nearest_box(cust2(spark, d), stats.bounding_boxes(rows, ["x", "y"], "part"), 2)


@query("nearest_sample", f"WITH {CUST2}, s AS (SELECT s_suppkey AS idx, s_suppkey::DOUBLE AS x, s_acctbal AS y, s_nationkey AS part FROM supplier), j AS (SELECT p.id, s.idx, part, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.idx) AS k FROM p, s) SELECT id, idx, part FROM j WHERE k = 1")
def _(spark, d):
    own = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"), F.col("s_nationkey").alias("part"))
    return locate.nearest_sample(cust2(spark, d), own, 2)


# --- sets ---


@query("set_merge", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def _(spark, d):
    return sets.merge(*_keys(spark, d))


def _keys(spark, d):
    return _table(spark, d, "orders").select(F.col("o_custkey").alias("k")), _table(spark, d, "customer").select(F.col("c_custkey").alias("k"))


@query("set_merge_without", "(SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) EXCEPT SELECT s_suppkey FROM supplier")
def _(spark, d):
    return sets.merge(*_keys(spark, d), without=_table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("set_merge_only", "(SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer) INTERSECT SELECT s_suppkey FROM supplier")
def _(spark, d):
    return sets.merge(*_keys(spark, d), only=_table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("multimap_get", "SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    pairs = _table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return sets.multimap_get(pairs, _table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("set_difference", "SELECT 'left' AS side, k FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'right', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    a, b = _keys(spark, d)
    return sets.difference(a.distinct(), b, "k")


@query("duplicate_points", f"WITH {PART2}, m AS (SELECT x, y, min(id) AS kept FROM p GROUP BY x, y) SELECT id, kept FROM p JOIN m ON p.x = m.x AND p.y = m.y WHERE id <> kept")
def _(spark, d):
    return mesh.dropped_points(part2(spark, d), 2)


@query("all_ids", f"WITH {CUST2} SELECT id FROM p UNION ALL SELECT unnest([-4, -3, -2, -1])::BIGINT")
def _(spark, d):
    return points.all_ids(cust2(spark, d), 2)


@query("far_points", f"WITH {CUST2}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p) SELECT (i - 4)::BIGINT AS id, CASE WHEN i & 1 > 0 THEN (lx + hx) / 2 + 200 * (hx - lx) ELSE (lx + hx) / 2 - 200 * (hx - lx) END AS x, CASE WHEN i & 2 > 0 THEN (ly + hy) / 2 + 200 * (hy - ly) ELSE (ly + hy) / 2 - 200 * (hy - ly) END AS y FROM b, (SELECT unnest([0, 1, 2, 3]) AS i)".replace("i & 1 > 0", "(i & 1) > 0").replace("i & 2 > 0", "(i & 2) > 0"))
def _(spark, d):
    return points.far_points(cust2(spark, d), 2)


@query("set_insert", "SELECT s_suppkey AS k FROM supplier UNION SELECT c_nationkey::BIGINT FROM customer")
def _(spark, d):
    return sets.insert(_table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), _table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")))


@query("set_contains", "SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders) AS present FROM customer")
def _(spark, d):
    a, b = _keys(spark, d)
    return sets.contains(b, a)


@query("map_merge", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    return sets.map_merge(*_accounts(spark, d))


def _accounts(spark, d):
    return _table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), _table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


@query("multimap_merge", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def _(spark, d):
    return sets.multimap_merge(*_accounts(spark, d))


@query("set_restrict", f"WITH {CUST2} SELECT id, x, y FROM p WHERE id IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    return sets.restrict(cust2(spark, d), _table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))).select("id", "x", "y")


@query("set_drop", f"WITH {CUST2} SELECT id, x, y FROM p WHERE id NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    return sets.drop(cust2(spark, d), _table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))).select("id", "x", "y")


# --- ids, measurements, storage, files ---


@query("finite_ids", f"WITH {CUST2}, a AS (SELECT id FROM p UNION ALL SELECT unnest([-4, -3, -2, -1])::BIGINT) SELECT id, id >= 0 AS finite, (id & 3)::BIGINT AS corner FROM a")
def _(spark, d):
    return points.all_ids(cust2(spark, d), 2).select("id", simplices.is_finite(F.col("id")).alias("finite"), simplices.far_index(F.col("id"), 2).alias("corner"))


@query("shared_vertices", "WITH s AS (SELECT l_orderkey, l_linenumber, list_distinct([l_partkey, l_suppkey, l_orderkey]) AS a, list_distinct([l_suppkey, l_orderkey, l_linenumber::BIGINT]) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, len(list_intersect(a, b))::INT AS n, len(list_intersect(a, b)) = 2 AS neighbours FROM s")
def _(spark, d):
    a, b = F.array("l_partkey", "l_suppkey", "l_orderkey"), F.array("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long"))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", simplices.shared_vertices(a, b).alias("n"), simplices.is_neighbour(a, b, 2).alias("neighbours"))


@query("average_measurement", "SELECT o_custkey AS run, floor(sum(floor(o_totalprice)::BIGINT) / count(*))::BIGINT AS avg_price FROM orders GROUP BY 1")
def _(spark, d):
    runs = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.create_map(F.lit("price"), F.collect_list(F.floor("o_totalprice"))).alias("measurements"))
    return stats.average_measurement(runs, "price").select("run", "avg_price")


@query("median_balance", "SELECT c_nationkey, list_sort(list(c_acctbal))[(count(*) // 2 + 1)::INT] AS median FROM customer GROUP BY 1")
def _(spark, d):
    return _table(spark, d, "customer").groupBy("c_nationkey").agg(stats.median_at("c_acctbal").alias("median"))


@query("storage_counts", TRIANGLES + "SELECT (SELECT count(*) FROM tri) AS simplices, 0::BIGINT AS hull, (SELECT count(*) * 64 FROM tri)::BIGINT AS simplex_bytes, (SELECT count(*) FROM p) AS points")
def _(spark, d):
    return stats.storage_counts(settle(_mesh()(spark, d), "mesh"), emb(spark, d, 2))


@query("stored_points", f"WITH {CUST2} SELECT id, x, y FROM p")
def _(spark, d):
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    points.store(cust2(spark, d).select("id", "x", "y"), path)
    return points.load(spark, path)


@query("text_points", f"WITH {CUST2} SELECT x, y FROM p")
def _(spark, d):
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    points.write_points(cust2(spark, d), path, 2)
    return points.read_points(spark, path, 2).select("x", "y")


# --- sample graph, edge sets, reports, generators ---


#: The circumcentres (mx, my) and square radii of tri(v0, v1, v2): {0} are further columns, {1} holds the points.
_CENTRES = """ce AS (SELECT {0}v0, v1, v2, a.x AS ox, a.y AS oy, b.x - a.x AS px, b.y - a.y AS py, c.x - a.x AS qx, c.y - a.y AS qy FROM tri JOIN (SELECT id, x, y FROM {1}) a ON a.id = v0 JOIN (SELECT id, x, y FROM {1}) b ON b.id = v1 JOIN (SELECT id, x, y FROM {1}) c ON c.id = v2),
ch AS (SELECT *, (px * px + py * py) / 2 AS ha, (qx * qx + qy * qy) / 2 AS hb, px * qy - py * qx AS w FROM ce),
ci AS (SELECT *, (ha * qy - hb * py) / w AS cx, (hb * px - ha * qx) / w AS cy FROM ch),
cc AS (SELECT {0}v0, v1, v2, ox + cx AS mx, oy + cy AS my, cx * cx + cy * cy AS rr FROM ci)"""


@query("sample_graph")
def _(spark, d):
    return sample.build_sampling(cust2(spark, d), 2, 4, weight="linear")[1]


@query("cut_edges")
def _(spark, d):
    own, edges = sample.build_sampling(cust2(spark, d), 2, 4)
    return sample.cut_edges(edges, own)


_CYCLE = f"""WITH {EMB2}, {MID}, {_LEVEL}, g AS (SELECT id, x, y, a.path || CASE WHEN y > (ay + by_) / 2 THEN '1' ELSE '0' END AS part FROM a JOIN s ON a.path = s.path),
t AS (SELECT a.part, a.id AS a, b.id AS b, c.id AS c, (a.x - c.x) * (b.y - c.y) - (a.y - c.y) * (b.x - c.x) AS s, (a.x - c.x) * (b.x - c.x) + (a.y - c.y) * (b.y - c.y) AS d
  FROM g a JOIN g b ON a.part = b.part AND a.id < b.id JOIN g c ON c.part = a.part AND c.id <> a.id AND c.id <> b.id),
e AS (SELECT part, a, b, min(d / s) FILTER (WHERE s > 0) AS l, max(d / s) FILTER (WHERE s < 0) AS r, arg_min(c, d / s) FILTER (WHERE s > 0) AS cl, arg_max(c, d / s) FILTER (WHERE s < 0) AS cr FROM t GROUP BY part, a, b),
k AS (SELECT * FROM e WHERE l IS NULL OR r IS NULL OR r <= l),
tri AS MATERIALIZED (SELECT DISTINCT part, v[1] AS v0, v[2] AS v1, v[3] AS v2 FROM (SELECT part, list_sort([a, b, cl]) AS v FROM k WHERE cl IS NOT NULL UNION ALL SELECT part, list_sort([a, b, cr]) FROM k WHERE cr IS NOT NULL)),
{_CENTRES.format('part, ', 'g')},
box AS (SELECT part AS other, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM g GROUP BY 1)
SELECT DISTINCT part, v0, v1, v2 FROM cc JOIN box ON part <> other WHERE pow(greatest(lx - mx, 0) + greatest(mx - hx, 0), 2) + pow(greatest(ly - my, 0) + greatest(my - hy, 0), 2) <= rr * (1 + 1e-9)"""


@query("edge_simplices", _CYCLE)
def _(spark, d):
    own = partition.flatten(partition.assign(mesh.distinct_points(emb(spark, d, 2), 2), 2, "c", 2))
    return checkers.edge_simplices(settle(mesh.local_meshes(own, 2), "pieces"), own, 2).select("part", *[F.col("v")[k].alias(f"v{k}") for k in range(3)])


_DUAL = TRIANGLES + f""", {_CENTRES.format('', 'p')}, n AS (SELECT *, row_number() OVER (ORDER BY v0, v1, v2) - 1 AS id FROM cc),
g AS (SELECT f.fa, f.fb, n.id, mx, my FROM f JOIN n ON f.v0 = n.v0 AND f.v1 = n.v1 AND f.v2 = n.v2)
SELECT a.id, b.id AS nb, a.mx AS x, a.my AS y, b.mx AS x2, b.my AS y2 FROM g a JOIN g b ON a.fa = b.fa AND a.fb = b.fb AND a.id < b.id"""


@query("dual_edges", _DUAL)
def _(spark, d):
    return mesh.dual_edges(settle(_mesh()(spark, d), "mesh"), emb(spark, d, 2), 2)


_HILBERT = f"""WITH RECURSIVE {CUST2}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p),
h AS (SELECT id, floor((x - lx) / (hx - lx) * 65535)::BIGINT AS c, floor((y - ly) / (hy - ly) * 65535)::BIGINT AS d, 32768::BIGINT AS q FROM p, b
  UNION ALL SELECT id, CASE WHEN (d & q) > 0 THEN xor(a, q - 1) ELSE xor(a, xor(a, d) & (q - 1)) END, CASE WHEN (d & q) > 0 THEN d ELSE xor(d, xor(a, d) & (q - 1)) END, q // 2
  FROM (SELECT id, CASE WHEN (c & q) > 0 THEN xor(c, q - 1) ELSE c END AS a, d, q FROM h WHERE q > 1)),
g AS (SELECT id, c, xor(c, d) AS e FROM h WHERE q = 1),
u AS (SELECT id, c, e, bit_xor(CASE WHEN (e & (1 << k)) > 0 THEN (1 << k) - 1 ELSE 0 END) AS t FROM g, (SELECT unnest(range(1, 16))::BIGINT AS k) GROUP BY id, c, e),
v AS (SELECT id, sum((((xor(c, t) >> k) & 1) << (2 * k + 1)) + (((xor(e, t) >> k) & 1) << (2 * k)))::BIGINT AS curve FROM u, (SELECT unnest(range(0, 16))::BIGINT AS k) GROUP BY id)
SELECT id, row_number() OVER (ORDER BY curve, id) - 1 AS place FROM v"""


@query("spatial_order", _HILBERT)
def _(spark, d):
    return order.spatial_places(cust2(spark, d), 2)


@query("metis_lines", _EDGES + ", l AS (SELECT src, string_agg(dst::VARCHAR || ' 1', ' ' ORDER BY dst) AS line FROM (SELECT src - 1 AS src, dst FROM g) GROUP BY src) SELECT i AS idx, coalesce(line, '') AS line FROM (SELECT unnest(range((SELECT count(*) FROM p))) AS i) LEFT JOIN l ON src = i UNION ALL SELECT -1, (SELECT count(*) FROM p)::VARCHAR || ' ' || (count(*) // 2)::VARCHAR || ' 1' FROM g")
def _(spark, d):
    edges = mesh.mesh_edges(_mesh()(spark, d)).select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"), F.lit(1).alias("w"))
    return reports.metis_lines(settle(edges, "graph"), emb(spark, d, 2).count())


@query("run_metrics")
def _(spark, d):
    own = settle(partition.flatten(partition.assign(mesh.distinct_points(emb(spark, d, 2), 2), 2, "d")), "assigned")
    return reports.experiment_json(reports.run_metrics(own, triangulate.triangulate(emb(spark, d, 2), 2, assigned=own), 0, 0, 0))


def _generated(kind: str, dim: int) -> Query:
    """As many points as the table has customers, in the bounds [0, 100]."""
    return lambda spark, d: generators.generate(spark, kind, _table(spark, d, "customer").count(), ([0.0] * dim, [100.0] * dim))


for _kind in ("uniform", "normal", "bubble", "ellipsoid", "skew-line", "patch-bubble", "malicious-bubble", "unbound-bubble"):
    query(f"generate_{_kind.replace('-', '_')}")(_generated(_kind, 3))
