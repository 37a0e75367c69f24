"""Sets of ids and multimaps as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(ids: DataFrame, more: DataFrame) -> DataFrame:
    return ids.unionByName(more).distinct()


def contains(queries: DataFrame, ids: DataFrame, key: str = "k") -> DataFrame:
    """queries with `present`."""
    return queries.join(ids.select(key).distinct().withColumn("present", F.lit(True)), key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def merge(a: DataFrame, b: DataFrame, without: DataFrame | None = None, only: DataFrame | None = None, key: str = "k") -> DataFrame:
    """The union; what is in `without` goes, or only what is in `only` stays."""
    out = a.unionByName(b).distinct()
    if without is not None:
        out = out.join(without.select(key), key, "left_anti")
    return out if only is None else out.join(only.select(key), key, "left_semi")


def map_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """map(k, v): the values of a where both have a key."""
    return a.unionByName(b.join(a.select("k"), "k", "left_anti"))


def multimap_get(multimap: DataFrame, keys: DataFrame) -> DataFrame:
    """All values of the keys; repeated pairs stay."""
    return multimap.join(keys.select("k").distinct(), "k")


def multimap_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def difference(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    """(side, ...): rows of one table that the other lacks."""
    left = a.join(b, list(on), "left_anti").select(F.lit("left").alias("side"), *on)
    return left.unionByName(b.join(a, list(on), "left_anti").select(F.lit("right").alias("side"), *on))


def restrict(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_semi")


def drop(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")
