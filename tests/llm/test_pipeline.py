"""The pipeline on the small tables: every stage's decisions take effect, and what isn't a copy stays."""

import re

import corpus_pipeline
from tessella.llm.common import settle

from .test_near_copies import near, shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF), name)
        seen.append(docs.count())
        if name == "exact_dedup":
            first = {}
            for r in sorted(before.collect(), key=lambda r: r.doc_id):
                first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
            assert {r.doc_id for r in docs.collect()} == set(first.values())
        rows, kept_ids = before.collect(), {r.doc_id for r in docs.collect()}
        if name == "quality_classifier":  # what goes is labelled bad, and what is labelled good stays, but for a few
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            wrong = [r.doc_id for r in rows if labels.get(r.doc_id) is not None and labels[r.doc_id] != (r.doc_id in kept_ids)]
            assert len(wrong) <= 0.05 * len(labels)
        if name == "language_id":
            assert {r.doc_id for r in rows if r.lang is not None and any(map(str.isalpha, r.text or ""))} - kept_ids == set()
        if name == "simhash_near_dedup":
            sets, group = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}
            for a in sets:
                for b in sets:
                    if a < b and near(sets[a], sets[b]):
                        low, high = sorted((group[a], group[b]))
                        group = {k: low if g == high else g for k, g in group.items()}
            assert kept_ids == set(group.values())
        if name != "packing":
            assert docs.columns == columns
            kept = docs
    assert seen[1] < seen[0] and seen[3] <= seen[2]
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in kept.collect()}


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (5, "the same the same words", "en", "s", 1), (5, "the same the same words", "en", "s", 1), (6, "the same the same words", "en", "s", 1)], docs.schema)
    left = corpus_pipeline.exact_stage(spark, odd, SF)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 5]
    assert corpus_pipeline.near_stage(spark, left, SF).count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
