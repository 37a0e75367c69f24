"""Quality scores: random Fourier features of document statistics, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import WORD, crc_mod, settle, table

#: About so many labelled rows are learnt from; more are sampled by a hash of the row.
LABELLED_MOST = 100_000
#: Labels that a broadcast may hold at most (16 bytes each); beyond it the same join shuffles.
BROADCAST_LABELS = 1_000_000
FEATURES, RIDGE, SEED = 384, 1e-3, 11
#: Share of the labelled rows that calibrates instead of fitting.
CALIBRATION = 4
THRESHOLD = 0.3
#: The statistics of a text, in the order of `statistics`.
NAMES = (
    "log_bytes", "log_words", "word_mean", "word_sd", "upper", "digits", "symbols", "shouts", "stops", "space", "breaks",
    "distinct", "repeats", "ragged", "same_lines", "line_log", "entropy", "high", "commonest", "upper_words", "short_words", "long_words",
)
_CLASSES = np.zeros((256, 9))
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#$%&*|@^~<>{}[]\\/_=+", b"!", b".,;:", b" \t\r\n\x0b\x0c", b"\n", range(128, 256))):
    _CLASSES[list(_bytes), _k] = 1
_TAIL = frozenset(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())


def statistics(text: str | None) -> np.ndarray:
    """The numbers NAMES of a whole text; an empty or null text has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(NAMES), np.float32)
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digit, symbol, shout, stop, space, breaks, high = (counts @ _CLASSES).tolist()
    n = len(data)
    share = counts[counts > 0] / n
    words = re.findall(WORD, data)
    lines = data.split(b"\n")
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally = Counter(words)
    out[:] = (
        np.log1p(n), np.log1p(len(words)), lengths.mean(), lengths.std(), upper / max(1, upper + lower), digit / n, symbol / n, shout / n, stop / n,
        space / n, 100 * breaks / n, len(tally) / w, sum(map(eq, words, words[1:])) / w, sum(x[-1:] in _TAIL for x in words) / w,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), -(share * np.log2(share)).sum(), high / n,
        max(tally.values(), default=0) / w, sum(map(bytes.isupper, words)) / w, (lengths <= 2).mean(), (lengths > 20).mean(),
    )
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) per row of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            stats = np.stack([statistics(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, len(NAMES)), np.float32)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(NAMES)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, stats array<float>")


class Model:
    """Everything that a score needs: the scaling, the random directions, the ridge weights and the calibration."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng, d = np.random.default_rng(seed), len(mean)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1)
        self.directions = rng.normal(0, 1 / np.sqrt(d), (d, features))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights, self.steps = np.zeros(features + 1), (np.array([0.0]), np.array([0.5]))

    def lift(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats.astype(np.float64) - self.mean) / self.sd, -4, 4)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def isotonic(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising function from raw scores to shares of label 1, by pooling neighbours that fall."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of raw scores
    for r, y in zip(raw[order].tolist(), labels[order].tolist()):
        blocks.append([y, 1, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, n2, r2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + r2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _scored(stats: DataFrame, model: Model) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_rows(batch, "stats")))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def fit(stats: DataFrame, labels: DataFrame, most: int = LABELLED_MOST) -> Model:
    """A model of labels(doc_id, label) on stats(doc_id, stats). Labels of one id are averaged; null ones are left out.

    Means and deviations are over all documents. Rows with one id and the same statistics are learnt from once. Of
    these labelled rows about `most` are used, by a hash of id and statistics, so that a repeated id doesn't bring
    all its rows at once. Each partition sums its products; the driver adds at most 32 such sums and calibrates on
    a fourth of the rows used. Without labels the score is 0.5, with one class its share.
    """
    at = [F.col("stats")[k] for k in range(len(NAMES))]
    moments = stats.agg(*[F.avg(a) for a in at], *[F.stddev_pop(a) for a in at]).first()
    moments = np.array([0.0 if m is None else m for m in moments])
    model = Model(moments[: len(at)], moments[len(at) :])
    known = labels.where("label is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("label").alias("label"))
    known = settle(known, "labels")
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    known = stats.join(known, "doc_id").groupBy("doc_id", "stats").agg(F.first("label").cast("double").alias("label"))
    known = settle(known.select("doc_id", "stats", "label"), "labelled")
    n = known.count()
    place = lambda seed, m: F.pmod(F.xxhash64("doc_id", "stats", F.lit(seed)), F.lit(m))
    if n > most:
        known = known.where(place(SEED, 1 << 20) < int(most / n * (1 << 20)))
    part = place(SEED + 1, CALIBRATION)
    size, shared = len(model.weights), stats.sparkSession.sparkContext.broadcast(model)

    def sums(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z, y = shared.value.lift(_rows(batch, "stats")), np.asarray(batch.column(1))
                total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = np.zeros((size, size + 1))
    for row in known.where(part > 0).select("stats", "label").coalesce(32).mapInArrow(sums, "sums binary").toLocalIterator():
        total += np.frombuffer(row.sums).reshape(total.shape)
    rows = total[-1, -2]  # the last feature is the constant 1
    if rows:
        penalty = RIDGE * rows * np.eye(size)
        penalty[-1, -1] = 1e-9
        model.weights = np.linalg.solve(total[:, :-1] + penalty / size, total[:, -1])
        fitted = stats.sparkSession.sparkContext.broadcast(model)

        def held(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(fitted.value.raw(_rows(batch, "stats"))), batch.column(1)], ["raw", "label"])

        pairs = known.where(part == 0).select("stats", "label").mapInArrow(held, "raw double, label double").orderBy("raw", "label").toPandas()
        if len(pairs):
            model.steps = isotonic(pairs.raw.to_numpy(), pairs.label.to_numpy())
        else:
            model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, most: int = LABELLED_MOST) -> DataFrame:
    """(doc_id, score) per row of docs(doc_id, text), learning from labels(doc_id, label).

    Null and empty texts have zero statistics and a score; rows without doc_id are scored, not learnt from;
    repeated rows keep a row each; other columns are ignored; an empty table gives an empty result.
    """
    stats = settle(document_statistics(docs), "statistics")
    return _scored(stats, fit(stats, labels, most))


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs with the numbers of each whole text in a column of that name."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                stats = [statistics(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stats, pa.list_(pa.float32()))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = LABELLED_MOST) -> DataFrame:
    """The rows of docs whose whole text scores the threshold at least, learning from labels(doc_id, label); all columns as they are.

    The texts are read once: their statistics are written beside the rows. Edge cases as in `score_quality`.
    """
    name = "__stats"
    docs = settle(with_statistics(docs, name), "with-statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long"), F.col(name).alias("stats")), labels, most))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                good = pa.array(shared.value.score(_rows(batch, name)) >= threshold)
                yield batch.drop_columns([name]).filter(good)

    return docs.mapInArrow(run, docs.drop(name).schema)


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod(F.col("doc_id"), 5) > 0).select("doc_id", F.col("quality").alias("label"))


def op10(spark, sf_dir: str) -> DataFrame:
    scores = score_quality(table(spark, sf_dir, "documents"), train_labels(table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
