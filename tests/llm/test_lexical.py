"""Lexical search against a plain version: edge rows, ties, turns, pruning that loses nothing."""

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import lexical
from tessella.llm.common import settle

SF = "/root/testdata/sf0.001"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t, {w: t.count(w) for w in set(t)}) for i, t in held if t]
    n, length, out = len(held), sum(len(t) for _, t, _ in held), []
    for item, text in items:
        scores = []
        for order, (i, t, tf) in enumerate(held):
            s = 0
            for w in set(terms(text)):
                if w in tf:
                    df = sum(w in o for _, _, o in held)
                    m = 50 + (50 * len(t) * n) // length
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, order, i))
        out += [(item, r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


DOCS = [
    (1, "The cat sat on the mat"), (2, "the CAT sat, on the mat!"), (3, None), (4, ""), (5, " \t.,;"), (6, "dog dog dog"), (6, "dog dog dog"), (6, "dog"),
    (None, "cat dog"), (None, "dog cat"), (7, "x" * 5000 + " cat " + "y " * 3000), (8, "日本語 ünï Ünï cat_dog cat-dog a1b2"), (9, "1 22 333 cat"), (10, "É é cat cat"),
]
ITEMS = [(1, "cat dog"), (1, "dog"), (2, None), (3, ""), (None, "ünï Ünï 22"), (4, "no such words"), (5, "cat CAT Cat cat cat"), (6, "x" * 5000 + " cat dog cat the mat cat cat É")]


def frames(spark, docs, items):
    docs = spark.createDataFrame([(i, t, "en", 1, 2, [3]) for i, t in docs], "doc_id long, text string, term string, item long, n long, terms array<int>")
    return docs, spark.createDataFrame([(i, t, 5, 6) for i, t in items], "item_id long, text string, doc_id long, rank int")


@pytest.mark.parametrize("k,turn", [(50, 1000), (2, 4), (1, 1000)])
def test_edges(spark, k, turn):
    docs, items = frames(spark, DOCS, ITEMS)
    got = rows(lexical.ranked(docs.coalesce(1), items, k, turn))
    assert got == plain(DOCS, ITEMS, k)
    assert lexical.ranked(docs.limit(0), items).count() == 0 and lexical.ranked(docs, items.limit(0)).count() == 0


def test_zipf(spark):
    r = random.Random(7)
    words = [f"w{j}" for j in range(300)]
    draw = lambda n: " ".join(r.choices(words, [1 / (j + 1) for j in range(300)], k=n))
    docs = [(j // 2, draw(r.randint(1, 120))) for j in range(300)] + [(900 + j, "w0 w0 w1 hot") for j in range(60)]
    items = [(j, draw(r.randint(1, 30))) for j in range(25)]
    a, b = frames(spark, docs, items)
    order = {j: d for j, d in enumerate(docs)}
    got = rows(lexical.ranked(a.coalesce(1), b, 5))
    assert len(order) == len(docs) and got == plain(docs, items, 5)


def test_steps_of_few_places(spark, monkeypatch):
    monkeypatch.setattr(lexical, "STEP_PLACES", 8)
    docs, items = frames(spark, DOCS, ITEMS)
    plan = lexical.Plan(np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([0, 0, 0]), np.array([5, 9, 3]), 2)
    owner, term, impact = np.repeat(np.arange(9), 2), np.tile([0, 1], 9), np.arange(18)
    steps = list(plan.expand(0, owner, term, impact))
    assert len(steps) > 3 and sorted(np.concatenate([s[2] for s in steps]).tolist()) == sorted([*range(0, 18, 2), *range(1, 18, 2), *range(1, 18, 2)])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 1, 2]), pa.array([5, 6, 7]), pa.array([4, 4, 4]), pa.array([[0, 1], [], [1]], pa.list_(pa.int32())), pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))],
        ["row", "doc_id", "n", "terms", "tfs"],
    )
    weight = np.array([700, 300])
    got = sorted((int(i), int(d), int(s)) for out in lexical._scored(batch, plan, weight, 3, 12) for i, d, s in zip(*out))
    one = lambda w, tf: w * ((10**9 * tf) // (1000 * tf + 20 * 100))
    assert got == [(0, 0, one(700, 1) + one(300, 2)), (0, 2, one(300, 3)), (1, 0, one(300, 2)), (1, 2, one(300, 3))]


def test_terms_are_pruned(spark):
    """On the documents the seeded floors leave terms out, and most (item, document) pairs get no exact score."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = settle(lexical._item_terms(items), "pairs")
    keys = pairs.select("a", "b").distinct().toPandas().to_numpy().view(np.uint64)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    low, high = keys[order, 0], keys[order, 1]
    vectors = lexical._vectors(docs, low, high)
    df = np.bincount(np.concatenate([np.asarray(r.terms, np.int64) for r in vectors.collect()]), minlength=len(low))
    n, length = vectors.count(), vectors.groupBy().sum("n").first()[0]
    weight = spark.sparkContext.broadcast(lexical.weights(df, n))
    term = {(int(a), int(b)): j for j, (a, b) in enumerate(zip(low.view(np.int64), high.view(np.int64)))}
    own = spark.createDataFrame([(r.item, term[r.a, r.b]) for r in pairs.collect()], "item long, term long")
    found = lexical._thresholds(own, lexical._heads(vectors, weight, n, length, 50), 50).toPandas()
    assert (found.suffix < found.floor).mean() > 0.1
    names, item = np.unique(found.item.to_numpy(), return_inverse=True)
    plan = lexical.Plan(item, found.term.to_numpy(), found.floor.to_numpy(), found.suffix.to_numpy(), len(low))
    scored = sum(len(i) for b in vectors.toArrow().to_batches() for i, _, _ in lexical._scored(b, plan, weight.value, n, length))
    assert len(names) * 50 <= scored < 0.5 * len(names) * n


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(lexical.op11(spark, SF)) == sorted(con.execute(lexical.OP11_SQL).fetchall(), key=str)
