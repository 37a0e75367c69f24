"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import crc_mod, table

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: About so many documents of each language are learnt from, chosen by a hash of id and text.
CLASS_MOST = 400
#: The commonest languages that a model can have; rarer ones aren't learnt. A label column that isn't one of languages stays bounded.
LANGS_MOST = 256
#: Features are shares of n-grams times IDF, times this.
SCALE = 30.0
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 1e-3, 1e-4, 4
NO_LANGUAGE = "und"
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def buckets(text: str) -> np.ndarray:
    """The hashed n-grams of a lower-cased text, one after another, all orders."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, rolling = [], np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        if len(codes) < n:
            break
        rolling = rolling[: len(codes) - n + 1] * np.uint64(_ODD[0]) + codes[n - 1 :] + np.uint64(n)
        mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(_ODD[1])
        out.append((mixed >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def document_counts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many each n-gram bucket occurs: over all of them."""

    def run(batches):
        n, found = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                seen = np.zeros(BUCKETS, bool)
                seen[buckets(text.as_py())] = True
                found += seen
            n += batch.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], ["bucket", "n"])

    rows = docs.select("text").where("text is not null").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS + 1, np.int64)
    counts[rows.bucket.to_numpy()] = rows.n.to_numpy()
    return int(counts[-1]), counts[:-1]


class Model:
    """Weights per bucket and language, with the IDF in them, and the temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf
        self.weights, self.bias, self.temperature = np.zeros((BUCKETS, max(1, len(langs)))), np.zeros(max(1, len(langs))), 1.0
        self.folded = self.weights.astype(np.float32)

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = buckets(text)
        counts = np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        return at, SCALE * counts[at] / max(1, len(found)) * self.idf[at]

    def fold(self) -> None:
        self.folded = (self.weights * self.idf[:, None] * SCALE).astype(np.float32)

    def logits(self, text: str) -> np.ndarray:
        found = buckets(text)
        total = np.zeros(len(self.bias))
        for at in range(0, len(found), 1 << 20):
            total += self.folded[found[at : at + (1 << 20)]].sum(0, dtype=np.float64)
        return total / max(1, len(found)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return NO_LANGUAGE, 0.0
        p = softmax(self.logits(text) / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 5) -> None:
    """FTRL-proximal with an elastic net: weights follow from z and n whenever a row needs them."""
    k, rng = len(model.langs), np.random.default_rng(seed)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last is the bias
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    whole = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = whole[:-1], whole[-1]
    model.fold()


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray) -> None:
    """The temperature with the least log loss on rows that weren't fitted."""
    if len(labels):
        tries = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in tries]
        model.temperature = float(tries[int(np.argmin(loss))])


def fit(docs: DataFrame, class_most: int = CLASS_MOST, langs_most: int = LANGS_MOST) -> Model:
    """A model of docs(doc_id, text, lang). IDF is over all of them; weights learn from a bounded sample of each language.

    The sample is chosen by a hash of id and text, and rows with one id, text and language are learnt from once, so
    that repeated rows neither crowd out the others nor all come at once. Rows without text or language aren't
    learnt from; other columns are ignored; of an empty table a model is made that knows no language.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    n, found = document_counts(known)
    idf = np.log((1 + n) / (1 + found)) + 1
    place = F.xxhash64(F.lit(3), "doc_id", "text")
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(place, 0.02).alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(langs_most)
    sizes = {r["lang"]: max(1, r["n"]) for r in sizes.toLocalIterator()}
    model = Model(sorted(sizes), idf)
    if not sizes:
        return model
    shares = F.from_json(F.lit(json.dumps({lang: int(min(1.0, class_most / size) * (1 << 30)) for lang, size in sizes.items()})), "map<string,long>")
    wanted = F.pmod(place, F.lit(1 << 30)) < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0))
    empty, langs = Model(model.langs, idf), {x: k for k, x in enumerate(model.langs)}
    shared = docs.sparkSession.sparkContext.broadcast(empty)

    def run(batches):
        for batch in batches:
            got = [shared.value.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a for a, _ in got], pa.list_(pa.int64())), pa.array([x for _, x in got], pa.list_(pa.float64()))], ["doc_id", "lang", "at", "x"])

    rows, held = [], []
    sample = known.where(wanted).dropDuplicates().mapInArrow(run, "doc_id long, lang string, at array<long>, x array<double>")
    for k, r in enumerate(sorted(sample.toArrow().to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["at"], r["x"]))):
        (held if k % 5 == 4 else rows).append((np.array(r["at"], np.int64), np.array(r["x"]), langs[r["lang"]]))
    follow_the_leader(model, rows)
    calibrate(model, np.array([x @ model.weights[at] + model.bias for at, x, _ in held]).reshape(-1, len(langs)), np.array([y for *_, y in held], int))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts: the likeliest learnt language and its calibrated probability.

    A text that is null or has no letter, and any text if no language was learnt, is `und` with score 0. Repeated
    rows keep a row each; other columns are ignored; an empty table gives an empty result; a text is never cut.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs with a learnt language of calibrated probability `least` or more; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [shared.value.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array([lang != NO_LANGUAGE and p >= least for lang, p in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = crc_mod(F.col("doc_id"), 4) == 2
    return identify(docs, fit(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")
