"""Ids equal tiktoken's on characters that are newer than Java's Unicode tables."""

import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from tessella.llm import bpe


def test_java_differs_on_unknown_code_points_only(spark):
    """Where Java and `regex` put a code point in other classes, Java doesn't know it, so its piece goes to `regex`."""
    points = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    rows = spark.createDataFrame([(k, chr(k)) for k in points], "k long, c string")
    classes = [r"\p{L}", r"\p{N}", r"\s"]
    java = rows.select("k", F.col("c").rlike(bpe.UNKNOWN).alias("unknown"), *[F.col("c").rlike("(?U)" + x).alias(f"c{n}") for n, x in enumerate(classes)]).where("not unknown").collect()
    assert len(java) > 130_000
    assert [hex(r.k) for r in java if [r.c0, r.c1, r.c2] != [bool(regex.match(x, chr(r.k))) for x in classes]] == []


@pytest.mark.parametrize("seed", [1, 2])
def test_newer_characters(spark, seed):
    r = random.Random(seed)
    new = [0x0C5D, 0x0870, 0x1E4D0, 0x1E4F0, 0x10D40, 0x16D40, 0x1D2C0, 0x11F50, 0x31350, 0x2EBF0, 0x1DF25, 0xA7CB, 0x1C89, 0xFFFF, 0x378]
    texts = ["".join(r.choice([chr(r.choice(new)), r.choice("ab1 .'s\n"), "'s", " ", "\u00e9", "\u00a0"]) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    texts += ["", chr(0x0C5D) + "'s", chr(0x1E4D0) * 300 + "'s"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.encode(docs, bpe.make_vocabulary(docs, bpe.load_ranks(path))).collect()
    want = {k: real.encode_ordinary(t) for k, t in enumerate(texts)}
    assert {x.doc_id: [int.from_bytes(x.ids[k : k + 4], "little") for k in range(0, len(x.ids), 4)] for x in got} == want
