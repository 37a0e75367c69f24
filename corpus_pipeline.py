"""A corpus pipeline: quality, language, exact copies, near copies, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last keep the columns of `documents`; each works on all rows that the one before kept.

What the stages of quality and language return runs Python after they have returned, so they set the session's ARROW_BATCH for
good: rows go to Python some megabytes at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact, langid, packing, quality, simhash
from tessella.llm.common import ARROW_BATCH, ARROW_BYTES, settle, table

#: A document goes if its language is learnt with less probability than this, or isn't known at all.
LEAST_LANGUAGE = 0.35
#: Keys of dropped rows that a broadcast may hold at most; beyond it the same join shuffles.
BROADCAST_KEYS = 500_000


def _without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't among dropped(key)."""
    dropped = settle(dropped.distinct(), "dropped")
    few = dropped.count() <= BROADCAST_KEYS
    own = docs.withColumn("__key", key)
    return own.join((F.broadcast(dropped) if few else dropped).withColumnRenamed("key", "__key"), "__key", "left_anti").drop("__key")


def _row_key(sha: Column) -> Column:
    """A key of a row that null ids have too."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    spark.conf.set(ARROW_BATCH, ARROW_BYTES)
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told."""
    spark.conf.set(ARROW_BATCH, ARROW_BYTES)
    return langid.keep_known(docs, langid.fit(docs), LEAST_LANGUAGE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group with equal texts: the one with the smallest doc_id."""
    groups = exact.exact_groups(docs).where("group_size > 1")
    groups = settle(groups.select(_row_key(F.col("text_sha256")).alias("key"), "kept"), "copies")
    tally = settle(groups.groupBy("key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "tally")
    key = _row_key(F.sha2(exact.normalised(F.col("text")).cast("binary"), 256))
    out = _without(docs, key, tally.where("not kept").select("key"))
    twice = tally.where("kept and n > 1").select("key")
    if not twice.isEmpty():  # rows with one id and one text: one of them stays
        columns = docs.columns
        both = docs.withColumn("__key", key).join(twice.withColumnRenamed("key", "__key"), "__key", "left_semi")
        one = both.groupBy("__key").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
        out = _without(out, key, twice).unionByName(one)
    return out


def _without_copies(docs: DataFrame, groups: DataFrame, key: Column) -> DataFrame:
    """One document of each group of groups(doc_id, key, root): the one with the smallest doc_id."""
    groups = settle(groups, "groups")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("best"), F.count("*").alias("n"))
    best = settle(best.where("n > 1").select("root", F.col("best.key").alias("best")), "best")
    return _without(docs, key, groups.join(best, "root").where("key <> best").select("key"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: Jaccard similarity of five-word shingles of 0.8 or more."""
    key = _row_key(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return _without_copies(docs, simhash.near_copy_groups(docs.select("doc_id", "text", key.alias("key"))), key)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("packing", packing_stage),
]
#: SQL can't express the models and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
