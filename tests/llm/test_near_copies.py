"""The near-copy stages against brute force: no two texts with a Jaccard similarity of 0.8 on five-word shingles stay."""

import random
import re
import tracemalloc
import uuid

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tessella.llm import jaccard, simhash
from tessella.llm.common import ARROW_BATCH, ARROW_BYTES


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    common = [word() for _ in range(30)]
    out = ["", " ", None, "one", "One", "one two", "a b c d e", "a b c d f", "A  b\tc d e"]
    for n in (20, 60, 200, 900):
        for _ in range(4):
            base = [word() for _ in range(n)]
            out += [" ".join(base), " ".join(common + base)]
            for _ in range(6):
                copy = list(base)
                for _ in range(r.randint(1, max(1, n // 30))):
                    copy[r.randrange(n)] = word()
                out.append(" ".join(copy[r.randint(0, 2) :]))
    return out


def test_all_near_copies_are_linked(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, str(i)) for i, t in rows], "doc_id long, text string, key string").repartition(3)
    sets = [shingles(t) for _, t in rows]
    want = list(range(len(rows)))
    pairs = [(i, j) for i in want for j in range(i) if near(sets[i], sets[j])]
    assert len(pairs) > 50
    for i, j in pairs:
        low, high = sorted((want[i], want[j]))
        want = [low if w == high else w for w in want]
    for groups in (lambda d: jaccard.jaccard_groups(d, 5, (4, 5), "key", empty=True), simhash.near_copy_groups):
        got = {r.doc_id: r.root for r in groups(docs).collect()}
        low = {}
        for i in sorted(got):
            low.setdefault(got[i], i)
        assert [low[got[i]] for i in range(len(rows))] == want
        assert groups(docs.limit(0)).count() == 0


def test_the_pipeline_keeps_no_near_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = corpus_pipeline.exact_stage(spark, docs, "")
    pairs = lambda df: [(a, b) for s in [[shingles(r.text) for r in df.select(F.col("text")).collect()]] for a in range(len(s)) for b in range(a) if near(s[a], s[b])]
    assert pairs(left)
    for name, stage in corpus_pipeline.STAGES:
        if "near" in name:
            left = stage(spark, left, "")
    assert not pairs(left)


def test_sketches_never_differ_more_than_the_sets(spark):
    r = np.random.default_rng(5)
    sets = []
    for n in (1, 30, 40, 63, 64, 65, 130, 500):
        own = r.integers(0, 1 << 62, n).astype(np.uint64)
        sets += [own, np.concatenate([own[: n - n // 5], r.integers(0, 1 << 62, n // 4).astype(np.uint64)])]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sketches = jaccard.sketches(owner, np.concatenate(sets), len(sets)).to_pylist()
    assert len({len(s) for s in sketches}) > 3
    pairs = [(k, sketches[k], sketches[k + 1]) for k in range(0, len(sets), 2)]
    found = spark.createDataFrame(pairs, "k int, x array<long>, y array<long>").select("k", jaccard.differing(F.col("x"), F.col("y")).alias("d")).collect()
    for row in found:
        assert row.d <= len(set(sets[row.k].tolist()) ^ set(sets[row.k + 1].tolist()))


def test_no_copy_by_chance(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes; they aren't copies, and both stay."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES:
        if "near" in name:
            assert stage(spark, docs, "").count() == 2


def test_copies_that_are_too_far_apart_make_few_pairs(spark, monkeypatch):
    """Texts with edits of their own share all common shingles, and sizes and places allow their pairs; pairs don't grow with the group's square."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=8))
    rows = []
    for size, edits in ((100, 2), (130, 3), (700, 14)):  # sketches of 4, 8 and 32 words
        base = [word() for _ in range(size)]
        for k in range(200):
            own = list(base)
            for place in r.sample(range(2, size - 2), edits if k % 10 else 1):
                own[place] = word()
            rows.append(" ".join(own))
    docs = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(rows)], "doc_id long, text string, key string").repartition(3)
    made, settle = [], jaccard.settle

    def counted(df, tag):
        out = settle(df, tag)
        if tag == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "settle", counted)
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_groups(docs, 5, (4, 5), "key", empty=True).collect()}
    assert max(made) < 8 * len(rows), made
    sets, want = [shingles(t) for t in rows], list(range(len(rows)))
    for i in want[:]:
        for j in range(i - i % 200, i):
            if want[i] != want[j] and near(sets[i], sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    assert [got[i] for i in range(len(rows))] == want


def test_whole_texts_reach_python_in_small_batches(spark, monkeypatch, tmp_path):
    """18 MB of text in one partition isn't one batch, in which the JVM and the worker would hold all of it; the session's setting is as before."""
    r, real = random.Random(4), jaccard.steps
    texts = [" ".join(r.randbytes(15).hex() for _ in range(1000)) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "doc_id long, text string, key string").coalesce(1)

    def noted(batch, **most):
        (tmp_path / uuid.uuid4().hex).write_text(str(batch.nbytes))
        return real(batch, **most)

    monkeypatch.setattr(jaccard, "steps", noted)
    before = spark.conf.get(ARROW_BATCH)
    assert jaccard.jaccard_groups(docs, 5, (4, 5), "key", empty=True).count() == len(texts)
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(sizes) > 2 * 18e6 and max(sizes) < 2 * ARROW_BYTES
    assert spark.conf.get(ARROW_BATCH) == before


def test_counting_shingles_takes_little_room_besides_them():
    r = np.random.default_rng(6)
    jaccard._repeated(np.zeros(2, np.uint64))  # what Arrow imports at its first use doesn't count
    for n in (0, 1, 2, 7, 1 << 20):
        value = r.integers(0, max(1, n // 2), n).astype(np.uint64)
        distinct, counts = np.unique(value, return_counts=True)
        value = value.copy()
        tracemalloc.start()
        got = jaccard._repeated(value)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(np.asarray(got.column(0)).view(np.uint64), distinct[counts > 1])
        assert np.array_equal(np.asarray(got.column(1)), counts[counts > 1])
        assert peak < 2 * value.nbytes + 100_000, (n, peak)  # np.unique takes over three times as much here
