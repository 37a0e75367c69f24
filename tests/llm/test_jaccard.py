"""The Jaccard join against brute force: both sides of the boundary, hot keys in blocks, edge rows."""

import random
import re

import pytest

from tessella.llm import jaccard

SCHEMA = "doc_id long, text string, key string, n long, row long, root long, sketch array<long>"


def sets(text, words):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def plain(rows, words, share):
    own = [sets(t, words) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and own[j] and both * share[1] >= share[0] * len(own[i] | own[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(s), least.get(r) if s else i) for (i, _), s, r in zip(rows, own, root)), key=str)


def found(spark, rows, parts=3, **kw):
    docs = spark.createDataFrame([(i, t, "k", 1, 2, 3, [4]) for i, t in rows], SCHEMA).repartition(parts)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs, **kw).collect()), key=str)


def corpus(seed, sizes=(4, 7, 12, 25, 60, 150), copies=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdef", k=4))
    shared, out = [word() for _ in range(40)], []
    for n in sizes:
        for _ in range(3):
            base = [word() for _ in range(n)]
            out += [" ".join(base), " ".join(base).upper(), " ".join(shared + base)]
            for _ in range(copies):
                copy = list(base)
                for _ in range(r.randint(0, max(1, n // 25))):
                    copy[r.randrange(n)] = word()
                out.append("\t".join(copy[r.randint(0, 2) :]))
    return list(enumerate(out))


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two\tthree"), (8, "one two three four"), (8, "one two three four"),
    (None, "one two three four"), (None, "a null alone in here now"), (9, "x " * 5000), (10, "x x x x"), (11, "É é É é É"), (12, "é é é é é"), (13, "one two three four five"),
    (14, " ".join(f"w{k}" for k in range(9000))), (15, " ".join(f"w{k}" for k in range(8900))), (16, "x x x"),
]


@pytest.mark.parametrize("small", [None, 0, 10, 40, 10**6])
def test_brute_force(spark, small):
    rows = corpus(3) + EDGES
    assert found(spark, rows, small=small) == plain(rows, 4, (85, 100))


@pytest.mark.parametrize("words,share", [(1, (3, 5)), (2, (9, 10)), (5, (1, 1))])
def test_other_measures(spark, words, share):
    rows = corpus(5, (5, 9, 30), 5) + EDGES
    assert found(spark, rows, words=words, share=share, small=12) == plain(rows, words, share)


def test_hot_keys_in_blocks(spark, monkeypatch):
    """A family whose members share most shingles, and texts that share a passage only, with blocks of few rows."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "STEP_PAIRS", 50)
    r = random.Random(9)
    passage = [f"p{k}" for k in range(12)]
    rows = [(k, " ".join(passage + [f"q{r.randrange(4)}" for _ in range(r.randint(0, 3))])) for k in range(90)]
    rows += [(100 + k, " ".join(passage + [f"own{k}w{j}" for j in range(20)])) for k in range(60)]
    for turns, small in ((0, 0), (4, 0), (1, 100)):
        monkeypatch.setattr(jaccard, "TURNS", turns)
        assert found(spark, rows, small=small) == plain(rows, 4, (85, 100))


def test_empty_and_alone(spark):
    assert found(spark, [(1, "a b c d")][:0] or [(1, "a b c d")]) == [(1, 1, 1)]
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_groups(docs).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_groups(docs, share=(1, 2))


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op12(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], 4, (85, 100))
