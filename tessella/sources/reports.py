"""Run records and text outputs: traits and measurements, JSON and CSV lines, graph files, drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "traits map<string,string>, measurements map<string,array<bigint>>"
#: Traits that say where and when a run was, not what it did.
IGNORED_TRAITS = ("host", "git", "start", "end", "run-number")


def run_record(spark: SparkSession, traits: dict[str, str], measurements: dict[str, list[int]]) -> DataFrame:
    return spark.createDataFrame([(traits, measurements)], RUN)


def result_line(runs: DataFrame) -> DataFrame:
    """`RESULT k=v ...`: traits in order, then the whole-number mean of each measurement."""
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    traits = F.transform(F.array_sort(F.map_entries("traits")), pair)
    mean = lambda v: F.floor(F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x) / F.greatest(F.size(v), F.lit(1))).cast("string")
    measured = F.transform(F.array_sort(F.transform(F.map_entries("measurements"), lambda e: F.struct(e["key"].alias("key"), mean(e["value"]).alias("value")))), pair)
    return runs.select(F.concat(F.lit("RESULT "), F.array_join(F.concat(traits, measured), " ")).alias("line"))


def parse_traits(line: Column) -> Column:
    """The k=v pairs of a line as a map."""
    return F.str_to_map(F.regexp_replace(line, "^RESULT ", ""), F.lit(" "), F.lit("="))


def same_run(a: Column, b: Column) -> Column:
    """Equal traits, but for those that say where and when."""
    own = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: ~k.isin(*IGNORED_TRAITS))))
    return own(a) == own(b)


def experiment_json(metrics: DataFrame) -> DataFrame:
    """A JSON document per row of run metrics."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))


def run_metrics(assigned: DataFrame, simplices: DataFrame, sample_size: int, partition_ms: int, mesh_ms: int, valid: bool | None = None) -> DataFrame:
    """One row: times, counts, part sizes, base cases and, if checked, validity."""
    sizes = assigned.groupBy("part").agg(F.count("*").alias("points"))
    parts = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col("part").alias("provenance"), "points"))).alias("basetriangulations"), F.coalesce(F.sum("points"), F.lit(0)).alias("triangulatedPoints"))
    own = parts.crossJoin(simplices.agg(F.count("*").alias("simplices")))  # one row each
    return own.select(
        F.lit(partition_ms).cast("long").alias("partitiontime"),
        F.lit(mesh_ms).cast("long").alias("triangulationtime"),
        "triangulatedPoints",
        "simplices",
        F.lit(sample_size).cast("long").alias("sampleSize"),
        F.lit(valid).cast("boolean").alias("valid"),
        F.transform("basetriangulations", lambda b: F.struct(b["points"].alias("size"))).alias("partitions"),
        "basetriangulations",
    )


def write_csv(df: DataFrame, path: str, sep: str = " ") -> None:
    df.write.option("sep", sep).option("header", True).csv(path)


def append_run(runs: DataFrame, path: str) -> None:
    """The run store: Parquet files that grow; `next_run_number` reads it."""
    runs.write.mode("append").parquet(path)


def next_run_number(spark: SparkSession, path: str) -> int:
    last = spark.read.parquet(path).agg(F.max(F.col("traits")["run-number"].cast("long"))).first()[0]
    return 0 if last is None else last + 1


def metis_lines(edges: DataFrame, nodes: int) -> DataFrame:
    """(idx, line) of a METIS file: the header at -1, then a line of 1-based neighbours and weights per node."""
    rows = edges.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dst", "w"))), lambda e: F.concat((e["dst"] + 1).cast("string"), F.lit(" "), e["w"].cast("string"))), " ").alias("line"))
    all_ = edges.sparkSession.range(nodes).withColumnRenamed("id", "src").join(rows, "src", "left")
    lines = all_.select(F.col("src").cast("long").alias("idx"), F.coalesce("line", F.lit("")).alias("line"))
    head = edges.agg(F.concat(F.lit(f"{nodes} "), F.floor(F.count("*") / 2).cast("string"), F.lit(" 1")).alias("line"))
    return head.select(F.lit(-1).cast("long").alias("idx"), "line").unionByName(lines)


def svg(simplices: DataFrame, points: DataFrame, width: int = 800, most: int = 20_000) -> str:
    """A drawing of a small 2-D mesh; an error beyond `most` edges."""
    from tessella.operators.mesh import mesh_edges

    ends = lambda k: points.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    rows = mesh_edges(simplices).where("src < dst").join(ends("src"), "src").join(ends("dst"), "dst").orderBy("src", "dst").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges; restrict the mesh first")
    xs = [v for r in rows for v in (r.srcx, r.dstx)] or [0.0, 1.0]
    ys = [v for r in rows for v in (r.srcy, r.dsty)] or [0.0, 1.0]
    scale = width / (max(max(xs) - min(xs), max(ys) - min(ys)) or 1)
    at = lambda x, y: ((x - min(xs)) * scale, (max(ys) - y) * scale)
    lines = ["<line x1='%.2f' y1='%.2f' x2='%.2f' y2='%.2f' stroke='black'/>" % (*at(r.srcx, r.srcy), *at(r.dstx, r.dsty)) for r in rows]
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{width}'>" + "".join(lines) + "</svg>"
