"""Where pieces begin doesn't depend on the neighbouring texts, so any batches give the same ids."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.llm import bpe
from tessella.llm.common import texts_of


def begins(texts):
    data, offsets = texts_of(pa.array(texts, pa.string()))
    at = bpe.cuts(data, offsets)
    return [(at[(at >= a) & (at < b)] - a).tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_texts_do_not_see_each_other():
    r = random.Random(2)
    texts = ["abc", "\nb", "", "x\n", "\n", "y", " ", "a ", "b", "\n\n", "c\nd"]
    texts += ["".join(r.choices("ab1.!? \n\r\t\u00a0\u3000\u00e9", k=r.randint(0, 6))) for _ in range(4000)]
    assert begins(texts) == [begins([t])[0] for t in texts]


def test_batches_of_one_row(spark):
    r = random.Random(5)
    texts = ["abc", "\nb"] + ["".join(r.choices("abz.! \n", k=r.randint(0, 8))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    want = {k: len(real.encode_ordinary(t)) for k, t in enumerate(texts)}
    for rows, parts in ((1, 1), (10_000, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        docs.repartition(parts, F.xxhash64("doc_id")).write.mode("overwrite").parquet(path_of := f"{spark.conf.get('spark.checkpoint.dir')}/one-row-{rows}/documents.parquet")
        got = {x.doc_id: x.n_tokens for x in bpe.op3(spark, path_of.rsplit("/", 1)[0]).collect()}
        assert got == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.isfinite(len(want))
