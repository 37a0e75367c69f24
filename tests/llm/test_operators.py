"""Each operator against a plain version of its own: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessella.llm import ann, bpe, bpe_ids, chat, exact, kneser, langid, packing, quality, simhash, warc
from tessella.llm import components as graph
from tessella.llm.components import connected_components

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, row long, group long, part int"
LONG = " ".join(f"word{k % 97}" for k in range(20_000))


def rows(texts):
    return [(i, t, ("en", "fr", None)[(i or 0) % 3], "s", 1, 7, "k", 3, 5, 1) for i, t in texts]


TEXTS = [
    (1, "the cat sat on the mat and looked at the dog"), (2, "the cat  sat\ton the mat and looked at the dog"), (3, None), (4, ""), (5, "   "),
    (6, "the cat sat on the mat and looked at the dog"), (6, "the cat sat on the mat and looked at the dog"), (7, LONG), (8, LONG + " end"), (None, "no id here"),
    (9, "12345 !!"), (10, "日本語 ünï 　 code\r\n\r\n  x"), (11, "x" * 500), (12, "one"), (13, "one two"), (14, "a<|endoftext|>b"), (15, "The Cat SAT"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(TEXTS), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(n):
            if linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("block,hot", [(2, 2), (4096, 4096)])
def test_simhash_groups(docs, empty, block, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    got = simhash.simhash_groups(docs, block=block).collect()
    assert len(got) == len(TEXTS)
    fps = [simhash.fingerprint(t) for _, t in TEXTS]
    root = components(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    want = Counter((i, fp - (1 << 64) if fp >> 63 else fp, min((TEXTS[j][0] for j in range(len(fps)) if root[j] == r and TEXTS[j][0] is not None), default=None)) for (i, _), fp, r in zip(TEXTS, fps, root))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == want
    assert simhash.simhash_groups(empty).collect() == []


def test_fingerprint_by_hand():
    import xxhash

    text = "A b\tC d e"
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c d", "c d e")]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest("a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def near_codes(seed, n=60):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    return np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) for _ in range(6)]))


def in_gray_order(codes):
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return codes[np.argsort(rank)]


def apart(codes):
    return np.bitwise_count(codes[:, None] ^ codes[None])


@pytest.mark.parametrize("limit,block", [(0, 4), (2, 16), (2, 4096), (5, 64)])
def test_near_links_join_all_pairs(spark, limit, block):
    codes = np.concatenate([near_codes(limit), np.arange(200, dtype=np.uint64) * np.uint64(3)])  # the latter agree on two of the three runs
    near = apart(codes) <= limit
    root = components(len(codes), lambda i, j: bool(near[i, j]))
    want = Counter(Counter(root).values())
    table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links = simhash.near_links(table, limit, block)
    assert block < 4096 or links.count() <= 3 * len(codes)
    found = connected_components(links).collect()
    sizes = Counter(Counter(r.root for r in found).values())
    sizes[1] += len(codes) - len(found)
    assert +sizes == want


@pytest.mark.parametrize("limit", [0, 1, 2, 7])
def test_gray_index_finds_all_pairs(limit):
    order = in_gray_order(near_codes(limit))
    pairs = {(int(a), int(b)) for q, c in simhash.GrayIndex(order).search(order, limit) for a, b in zip(q, c)}
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(apart(order) <= limit))))
    exact = simhash.GrayIndex(order, exact=0xFF << 56)
    pairs = {(int(a), int(b)) for q, c in exact.search(order, limit) for a, b in zip(q, c)}
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero((apart(order) <= limit) & (order[:, None] >> np.uint64(56) == order[None] >> np.uint64(56))))))


def test_gray_index_prunes_on_documents(spark):
    """The fingerprints of the documents, with the exact run of the turn as op1 has it and without: whole groups are left out, and what is found is what brute force finds."""
    fps = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("fp").distinct().toPandas().fp.to_numpy().view(np.uint64)
    order = in_gray_order(fps)
    run = np.uint64(simhash.Turns(2).exact(0))
    want, same_run = 0, 0
    for k in range(0, len(order), 500):
        near = np.bitwise_count(order[k : k + 500, None] ^ order[None]) <= 2
        want, same_run = want + near.sum(), same_run + (near & ((order[k : k + 500, None] ^ order[None]) & run == 0)).sum()
    for exact, most, pairs in ((0, 0.25, want), (int(run), 0.1, same_run)):
        index = simhash.GrayIndex(order, exact=exact)
        assert sum(len(q) for q, _ in index.search(order, 2)) == pairs
        assert index.compared < most * len(order) * sum(map(len, index.values))


@pytest.mark.parametrize("few", [0, 16_384])
def test_components_of_a_chain(spark, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.v: r.root for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(links.limit(0)).collect() == []


@pytest.mark.parametrize("few", [0, 1000])
def test_exact_groups(docs, empty, few):
    got = exact.exact_groups(docs, broadcast_keys=few).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = Counter(norm(t) for _, t in TEXTS)
    least = {n: min((i is None, i or 0) for i, t in TEXTS if norm(t) == n) for n in groups}
    want = Counter((i, None if least[norm(t)][0] else least[norm(t)][1], groups[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in TEXTS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact.exact_groups(empty).collect() == []


def tiktoken_encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(docs, empty):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    real = tiktoken_encoding(ranks)
    vocabulary = bpe.make_vocabulary(docs, ranks)
    got = bpe.encode(docs, vocabulary).collect()
    want = Counter((i, np.array(real.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    again = bpe.decode(bpe.encode(docs, vocabulary), ranks).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in again) == want
    assert bpe.encode(empty, bpe.make_vocabulary(empty, ranks)).collect() == []
    for piece in (b" hello", b"zzzzqqqq" * 20, b"=", b"\xff\xfe"):
        assert bpe.merge_bytes(piece, ranks) == real._encode_single_piece(piece)


def clashing_words():
    """The Thue-Morse word over a and b, and its complement: polynomial hashes modulo 2^64 are equal."""
    one = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("tasks", [1, 2])
@pytest.mark.parametrize("bad", [False, True])
def test_pieces_of_one_key(spark, tasks, bad):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [*clashing_words(), "some words are equal, others aren't  ", "é日本 12", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(tasks, "doc_id")
    options = {"hashes": lambda data, starts, ends: (ends - starts).astype(np.uint64)} if bad else {}
    got = {r.doc_id: r for r in bpe.encode(docs, bpe.make_vocabulary(docs, ranks, **options)).collect()}
    for i, t in enumerate(texts):
        assert bytes(got[i].decoded) == t.encode() and np.frombuffer(got[i].ids, "<u4").tolist() == tiktoken_encoding(ranks).encode_ordinary(t)


def test_fold_and_heap_agree(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame([(1, "internationalisation of unbelievably longwords here 1234567890123")], "doc_id long, text string")
    ids = {fold: bytes(bpe.encode(docs, bpe.make_vocabulary(docs, ranks, fold_bytes=fold)).first().ids) for fold in (0, 16, 200)}
    assert len(set(ids.values())) == 1


def test_chat_formats_and_reads_back(spark):
    part = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
    text = lambda t: ("text", t, None, None, None, None, None)
    data = [
        (1, 1, "assistant", [text("</turn>\n<turn>user\n&lt;"), ("image", None, "a.png", 1024, 512, None, None), text("end <|image|>")]),
        (1, 0, "us\ner", [text(None)]), (1, 2, "assistant", None), (2, None, None, [("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), (None, "plain", None, None, None, None, None)]),
    ]
    messages = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts array<{part}>")
    got = {r.conv_id: r for r in chat.format_chats(messages).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [t.role for t in got[1].turns] == ["us\ner", "assistant", "assistant"]
    assert got[1].loss == "</turn>\n<turn>user\n&lt;<|image|>end <|image|>"
    assert [(a.type, a.uri, a.tokens) for a in got[1].attachments] == [("image", "a.png", 2 * 170 + 1)]
    assert [(a.type, a.tokens) for a in got[2].attachments] == [("audio", 50), ("document", 3072)] and got[2].attachment_tokens == 3122
    assert got[2].turns[0].text == "<|audio|><|document|>plain" and got[2].loss == ""
    assert chat.format_chats(messages.limit(0)).collect() == []


def test_archives(spark, tmp_path):
    html = ["<p>" + "a" * 200, "<p>" + "a" * 200, "short", "short", None, "é" * 100 + "\r\n\r\nWARC/1.1", "<p>" + "a" * 200]
    pages = spark.createDataFrame([(i if i != 6 else None, None if i == 2 else f"http://h/{i} x\r\n", h, "d", 1) for i, h in enumerate(html)], "page_id long, url string, html string, digest string, size int")
    for few in (0, 100):
        index = warc.write_archives(warc.plan_revisits(pages, broadcast_keys=few), f"file:{tmp_path}/w{few}", archive_bytes=600)
        got = {r.page_id: r for r in warc.read_archives(index, read_bytes=500).collect()}
        for i, h in enumerate(html):
            own, data = got[i if i != 6 else None], (h or "").encode()
            assert own.payload_bytes == len(data) and own.payload_digest == hashlib.sha256(data).hexdigest()
            assert (own.record_type, own.refers_to) == (("revisit", 0) if i in (1, 6) else ("response", None))
            assert own.payload is None if i in (1, 6) else bytes(own.payload) == data
        some = index.where("page_id = 5")
        assert [r.page_id for r in warc.read_archives(some).collect()] == [5]
    assert warc.read_archives(warc.write_archives(warc.plan_revisits(pages.limit(0)), f"file:{tmp_path}/e")).collect() == []


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:200] = x[7]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (904, [None] * 16), (None, x[3].tolist())]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("block", F.lit(2))
    got = ann.nearest(table, table.where("vec_id % 20 = 0")).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        score = unit @ unit[q]
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(score[v] - s) < 1e-12 for _, v, s in mine)
        score[q] = -9
        hits += len({v for _, v, _ in mine} & set(np.lexsort((np.arange(400), -score))[:5].tolist()))
        if 100 <= q < 200:
            assert [m[1] for m in mine] == [v for v in (7, 100, 101, 102, 103, 104) if v != q][:5]
    assert hits >= 0.9 * 5 * 20
    few = table.where("vec_id < 3")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(few, few).collect()) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert ann.nearest(table.limit(0), table.limit(0)).collect() == []


@pytest.mark.parametrize("probing", [True, False])
def test_nearest_with_repeated_ids(spark, probing, monkeypatch):
    """A query's own rows, however many, crowd out no other; rows that are repeated count as often."""
    if not probing:
        monkeypatch.setattr(ann, "candidates", lambda rows, asked, codes: asked.select(F.col("vec").alias("q"), "vec").limit(0))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 16)).tolist()
    own = [(7, x[0])] * 6 + [(8, x[0])] + [(100 + i, v) for i, v in enumerate(x[1:])] + [(105, x[6])]
    own += [(7, [v * (1 + i / 1e6) for v in x[0]]) for i in range(1, 40)]
    table = spark.createDataFrame(own, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(table, table.where("vec_id in (7, 105)")).collect())
    for q, at in ((7, x[0]), (105, x[6])):
        cos = lambda v: float(np.dot(at, v) / np.linalg.norm(at) / np.linalg.norm(v))
        want = sorted((round(-cos(v), 9), i) for i, v in own if i != q)[:5]
        assert [(-round(s, 9), i) for a, _, i, s in got if a == q] == want
    assert [r[2] for r in got if r[0] == 7][0] == 8


def test_probing_meets_every_code_within_the_radius(spark):
    """By the pigeonhole principle; and codes that differ in no more than one bit of a substring share its bucket."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 32))
    codes = ann.Codes(x, 5, 600)
    codes.substrings, codes.radius = 16, 31
    codes.turns = codes.turns[:, :256]
    near = x[:30] + 0.05 * rng.normal(size=(30, 32))
    table = lambda ids, v: spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, v)], "vec long, embedding array<double>")
    found = {(r.q, r.vec) for r in ann.candidates(table(range(600), x), table(range(1000, 1030), near), codes, 600).collect()}
    apart = np.bitwise_count(codes.codes_of(near)[:, None] ^ codes.codes_of(x)[None]).sum(2)
    want = {(1000 + int(q), int(v)) for q, v in zip(*np.nonzero(apart <= 31))}
    assert found == want and len(want) >= 20


def test_recall_on_embeddings(spark):
    """All 2000 embeddings of the larger table against brute force; most codes aren't opened."""
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    ids, x = rows.vec_id.to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.op6(spark, folder).toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -9
        hits += len(set(ids[np.lexsort((ids, -score))[:5]]) & set(got.vec_id[got.query_id == ids[q]]))
    assert len(got) == 5 * (ids % 50 == 0).sum() and hits >= 0.9 * len(got)
    assert ann.Codes(x, 5, len(x)).opened < 0.2


def test_language(spark, docs, empty):
    said = {"en": "the quick brown fox and the lazy dog were there", "de": "der schnelle braune fuchs und der faule hund waren da", "fr": "le renard brun rapide et le chien paresseux étaient là"}
    data = [(i, " ".join(np.random.default_rng(i).permutation(said[lang].split())), lang) for i in range(90) for lang in [("en", "de", "fr")[i % 3]]]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(table)
    got = langid.identify(table, model).collect()
    assert sum(r.lang_pred == data[r.doc_id][2] for r in got) >= 88 and all(0 <= r.score <= 1 for r in got)
    edge = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(edge[i].lang_pred == "und" for i in (3, 4, 5, 9)) and edge[7].lang_pred in said
    assert langid.identify(empty, langid.fit(empty)).collect() == []
    assert {r.lang_pred for r in langid.identify(table, langid.fit(empty)).collect()} == {"und"}
    assert langid.keep_known(docs, model, 0.0).where("doc_id in (3, 4, 9)").count() == 0


def test_language_held_out(spark):
    """On the documents: rows that weren't learnt from, told by their own column lang."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op7(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = [r.lang == r.lang_pred for r in got]
    assert len(right) > 200 and np.mean(right) >= 0.99


def test_language_of_repeated_rows(spark):
    said = {"en": "the quick brown fox and the lazy dog were there", "de": "der schnelle braune fuchs und der faule hund waren da"}
    data = [(1, said["en"], "en")] * 600 + [(None, said["de"], "de")] * 300 + [(1, f"{said['de']} {k}", "de") for k in range(900)] + [(k, "x", f"odd{k}") for k in range(40)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    seen = []
    keep = langid.follow_the_leader
    langid.follow_the_leader = lambda model, rows, **o: (seen.append(len(rows)), keep(model, rows, **o))
    try:
        model = langid.fit(table, class_most=100, langs_most=2)
    finally:
        langid.follow_the_leader = keep
    assert model.langs == ["de", "en"] and 40 < seen[0] < 200
    got = langid.identify(table, model).collect()
    assert len(got) == len(data) and sum(r.lang_pred == "en" for r in got[:600]) == 600


def plain_kneser(texts, asked):
    tokens = lambda t: [w for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())] + ["end"]
    count = Counter(w for t in texts for w in tokens(t))
    pairs = Counter(p for t in texts for p in zip(["begin", *tokens(t)[:-1]], tokens(t)))
    n, v = sum(count.values()), len(count)

    def discounts(values):
        c = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        return kneser.discounts(c)

    high, cont = discounts(list(pairs.values())), Counter(w for _, w in pairs)
    low, total = discounts(list(cont.values())), len(pairs)
    d = lambda c, t: t[min(c, 3) - 1] if c else 0.0
    rest = sum(d(c, low) for c in cont.values())
    context, share = Counter(), Counter()
    for (h, _), c in pairs.items():
        context[h] += c
        share[h] += d(c, high)

    def p(h, w):
        base = (max(cont[w] - d(cont[w], low), 0) + rest / (v + 1)) / total if total else 1 / (v + 1)
        return base if h not in context else max(pairs[h, w] - d(pairs[h, w], high), 0) / context[h] + share[h] / context[h] * base

    for t in asked:
        w = tokens(t)
        yield len(w), sum(x in count for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(h, x)) for h, x in zip(["begin", *w[:-1]], w))


@pytest.mark.parametrize("bad", [False, True])
def test_kneser_ney_of_clashing_words(spark, bad):
    """Words that a polynomial hash can't tell apart, and keys whose first halves are all equal."""
    one, other = clashing_words()
    texts = [one, f"{one} a bc def", "a bc", other, f"bc {other[:-1]} def", ""] + [" ".join(f"w{k}" for k in range(150))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def clash(data, starts, ends):
        from tessella.llm.common import span_keys

        low, high = span_keys(data, starts, ends)
        return low & np.uint64(0), high

    options = {"hashes": clash} if bad else {}
    model = kneser.train(docs.where("doc_id <> 3 and doc_id <> 4"), **options)
    got = sorted(tuple(r) for r in kneser.score_texts(docs, model, **options).collect())
    want = list(plain_kneser([t for i, t in enumerate(texts) if i not in (3, 4)], texts))
    assert np.allclose([g[1:] for g in got], want, rtol=1e-9) and got[3][2] == 1


def test_kneser_ney(docs, empty):
    train = [t for i, t in TEXTS if i is not None and i % 2]
    model = kneser.train(docs.where("doc_id % 2 = 1"))
    got = sorted(tuple(r)[1:] for r in kneser.score_texts(docs, model).collect())
    want = sorted(plain_kneser(train, [t for _, t in TEXTS]))
    assert np.allclose(got, want, rtol=1e-9)
    assert kneser.score_texts(empty, model).collect() == []
    assert [r.score for r in kneser.score_texts(docs.where("doc_id = 4"), kneser.train(empty)).collect()] == [0.0]


def real_ids(text):
    """The ids that the tokenizers library gives in its default setting."""
    from tokenizers import Tokenizer

    if not REAL:
        REAL.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return REAL[0].encode(text or "", add_special_tokens=False).ids


REAL: list = []


def check_packed(got, docs, capacity):
    """Every id of every document, by the tokenizers library, lies in exactly one piece; sequences have no padding but at a power of two."""
    want = [(i, np.array([*real_ids(t), 1], "<u4")) for i, t in docs]
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    left = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    for i, ids in want:
        at = 0
        while at < len(ids):
            piece = next(x for x in left if x[0] == i and x[1] == at and x[4] == len(ids) and zlib.crc32(ids[at : at + x[2]].tobytes()) == x[3])
            left[piece] -= 1
            left += Counter()
            at += piece[2]
    assert not left


@pytest.mark.parametrize("group_tokens,capacity", [(300, 64), (1 << 18, 2048)])
def test_packing(docs, empty, group_tokens, capacity):
    check_packed(packing.pack_documents(docs, capacity=capacity, group_tokens=group_tokens).collect(), TEXTS, capacity)
    assert packing.pack_documents(empty).collect() == []


def test_packing_of_one_id(spark):
    data = [(5, f"row {k} " + "word " * (k % 50)) for k in range(3000)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    got = packing.pack_documents(table, capacity=256, group_tokens=2000).collect()
    groups = {r.sequence_id >> 40 for r in got}
    assert sum(r.length for r in got) == sum(len(real_ids(t)) + 1 for _, t in data) and len(groups) == 2
    uneven = [n for n in Counter({r.sequence_id: 0 for r in got}) if sum(r.length for r in got if r.sequence_id == n) < 256]
    assert len(uneven) > 40  # each group ends with sequences of its own


def test_ids_are_those_of_tokenizers():
    ranks, added = bpe_ids.load_json(public_tokenizers.path("byte_bpe_50k.json"))
    assert ranks == bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")) and added == {"<|endoftext|>": 50256}
    mine = bpe_ids.PieceIds(ranks, added)
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "a", "Word", "'s", "<|endoftext|>", "<|endoftext", "|>", "\n", "\t", "1", "23", "é", "日本", "!?", "\u3000", "\u00a0", "<"]
    fuzz = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 12))) for _ in range(2000)]
    for t in [t for _, t in TEXTS if t is not None] + fuzz:
        assert np.frombuffer(mine.ids(t), mine.kind).tolist() == real_ids(t), t


def test_tournament_is_first_fit():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 50, 30).tolist()
        tree, room = packing.Tournament(30, 64), [64] * 30
        for s in sizes:
            k = tree.first(s)
            assert k == next(j for j, r in enumerate(room) if r >= s)
            tree.take(k, s)
            room[k] -= s


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(2)
    good = [(i, " ".join(rng.choice(["a", "good", "text", "reads", "well", "and", "varies"], 40)) + ".", 1) for i in range(0, 300, 2)]
    bad = [(i, " ".join(rng.choice(["SPAM!!", "###", "BUY!!"], 40)), 0) for i in range(1, 300, 2)]
    table = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(0, None), (None, 1), (0, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in quality.score_quality(table, labels).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in good + bad) and all(0 <= s <= 1 for s in got.values())
    assert len(quality.score_quality(docs, labels).collect()) == len(TEXTS)
    assert quality.score_quality(empty, labels).collect() == []
    assert {r.score for r in quality.score_quality(table, labels.limit(0)).collect()} == {0.5}
    assert np.isfinite(quality.statistics(LONG)).all() and not quality.statistics(None).any()


def area(scores, labels):
    """The chance that a row of label 1 scores higher than one of label 0; ties count half."""
    good, bad = (np.array([s for s, y in zip(scores, labels) if y == k]) for k in (1, 0))
    return ((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean()


def test_quality_held_out(spark):
    """On the documents: labelled rows that weren't learnt from."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.op10(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and area([r.score for r in got], [r.quality for r in got]) >= 0.97
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.93


def test_quality_of_repeated_ids(spark):
    data = [(1, f"good text reads well and varies {k}") for k in range(600)] + [(2, "SPAM!! ### BUY!!" + " #" * (k % 300)) for k in range(600)] + [(None, "x")] * 5
    table = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, label int")
    stats = quality.document_statistics(table)
    model = quality.fit(stats, labels, most=200)
    assert len(model.steps[0]) < 100
    got = quality.score_quality(table, labels, most=200).collect()
    assert len(got) == len(data) and all((r.score >= 0.3) == (r.doc_id == 1) for r in got if r.doc_id)
    kept = quality.keep_good(table, labels, most=200)
    assert kept.columns == table.columns and kept.where("doc_id = 1").count() == 600 and kept.where("doc_id = 2").count() == 0


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=500)
    knots, values = quality.isotonic(raw, (raw + rng.normal(size=500) > 0).astype(float))
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all() and 0 <= values.min() and values.max() <= 1
