"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

#: Keys that a broadcast may hold at most (16 bytes each); beyond it the same join shuffles.
BROADCAST_KEYS = 1_000_000


def normalised(text):
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, row, keep_id, group_size, kept, text_sha256) for each row of docs(doc_id, text).

    Of rows with equal normalised texts the one with the smallest doc_id stays; of rows with that doc_id too, the
    first read. `row` numbers the rows of the input. Nulls: a null text is an empty one; a null doc_id is larger
    than any other. Other columns are ignored; an empty table gives an empty result; texts are never cut.

    Rows are grouped by the MD5 of the text, with partial aggregates per task. For groups of two or more, the
    smallest and the largest text of the group are compared byte by byte; where they differ (a collision), the
    group's rows are grouped by the text itself.
    """
    norm = normalised(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    each = settle(texts.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.md5(F.col("norm").cast("binary"))).alias("key"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "hashed")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("best")
    groups = settle(each.groupBy("key").agg(F.count("*").alias("group_size"), best).where("group_size > 1"), "groups")
    few = groups.count() <= broadcast_keys
    keys = groups.select("key")
    members = texts.withColumn("key", F.unhex(F.md5(F.col("norm").cast("binary")))).join(F.broadcast(keys) if few else keys, "key", "left_semi")
    compared = members.groupBy("key").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    collided = settle(compared.where("low <> high").select("key"), "collided")
    if not collided.isEmpty():  # two different texts with one MD5: the SHA-256 tells them apart, as their bytes do
        mixed = each.join(collided, "key", "left_semi")
        parted = mixed.groupBy("key", "text_sha256").agg(F.count("*").alias("group_size"), best)
        groups = settle(groups.join(collided, "key", "left_anti").withColumn("sha", F.lit(None).cast("string")).unionByName(parted.withColumnRenamed("text_sha256", "sha")), "groups")
        joined = each.join(groups, (each.key == groups.key) & F.coalesce(groups.sha == each.text_sha256, F.lit(True)), "left")
    else:
        joined = each.join(groups, each.key == groups.key, "left")
    return joined.select(
        each.doc_id,
        "row",
        F.when(F.col("best").isNull(), each.doc_id).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
