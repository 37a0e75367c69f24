"""Point tables: text and Parquet readers and writers, far points, views of other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.vectors import axes

#: Far points lie at twice this many extents from the middle.
SAFETY = 100


def read_points(spark: SparkSession, path: str, dim: int, sep: str = " ") -> DataFrame:
    """points(id, x, y[, z]) of a text file with a point a line; ids are 1 to n in the order of the lines.

    A line without exactly `dim` numbers is an error; a missing file is one too. Ids take one pass to count lines
    per partition and one to number them, and no sort.
    """
    fields = F.split("value", sep if sep != "." else r"\.", -1)
    lines = spark.read.text(path)
    fine = F.size(fields) == dim
    for k in range(dim):
        fine = fine & F.get(fields, F.lit(k)).try_cast("double").isNotNull()
    values = [F.when(fine, F.get(fields, F.lit(k)).try_cast("double")).otherwise(F.raise_error(F.lit(f"a line without {dim} numbers")).cast("double")).alias(a) for k, a in enumerate(axes(dim))]
    parsed = lines.select(*values, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    counts = {r.part: r["count"] for r in lines.groupBy(F.spark_partition_id().alias("part")).count().collect()}  # a row per partition
    first, starts = 1, {}
    for part in sorted(counts):
        starts[part], first = first, first + counts[part]
    start = F.create_map(*[F.lit(int(v)) for kv in (starts or {0: 1}).items() for v in kv])
    return parsed.select((F.element_at(start, F.col("part")) + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("id"), *axes(dim))


def write_points(points: DataFrame, path: str, dim: int) -> None:
    """A line per finite point, six decimals."""
    line = F.concat_ws(" ", *[F.format_string("%f", F.col(a)) for a in axes(dim)])
    points.where("id >= 1").select(line.alias("value")).write.text(path)


def store(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def view(df: DataFrame, id_: Column, *coordinates: Column) -> DataFrame:
    """A point table from columns of another table; ids must be 1 or more."""
    return df.select(id_.cast("long").alias("id"), *[c.cast("double").alias(a) for c, a in zip(coordinates, axes(len(coordinates)))])


def far_points(points: DataFrame, dim: int, centre: str = "mid") -> DataFrame:
    """The 2^dim points far beyond the data, with ids -2^dim to -1: coordinate d is above the centre if bit d is set.

    centre: `mid` of the data, or `origin`, which doesn't enclose data far from the origin.
    """
    names, n = axes(dim), 1 << dim
    ends = [f(a).alias(f"{k}_{a}") for a in names for f, k in ((F.min, "lo"), (F.max, "hi"))]
    stats = points.where("id >= 0").agg(*ends)
    corners = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    value = []
    for d, a in enumerate(names):
        reach = 2 * SAFETY * (F.col(f"hi_{a}") - F.col(f"lo_{a}"))
        middle = (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 if centre == "mid" else F.lit(0.0)
        value.append(F.when(F.col("i").bitwiseAND(1 << d) > 0, middle + reach).otherwise(middle - reach).alias(a))
    return corners.select((F.col("i") - n).cast("long").alias("id"), *value)


def all_ids(points: DataFrame, dim: int) -> DataFrame:
    """Every finite id from 1 on and every far id."""
    far = points.sparkSession.range(-(1 << dim), 0)
    return points.where("id >= 1").select("id").unionByName(far)


def spatial_schema(dim: int) -> T.StructType:
    return T.StructType([T.StructField("id", T.LongType(), False)] + [T.StructField(a, T.DoubleType(), False) for a in axes(dim)])
