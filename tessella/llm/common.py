"""What the operators of this subpackage share: the shared folder, written intermediate tables, whole-text byte kernels."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and the controls from tab to carriage return.
WORD = rb"[^\x20\x09-\x0d]+"
#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Spark's setting for the bytes of rows that go to Python at once, and what it is where whole texts meet little memory.
ARROW_BATCH, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A folder of our own is made only for a local master without the setting, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tessella-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors, computes once."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python in batches of about ARROW_BYTES; the session's own setting holds again afterwards.

    A batch of Spark's 64 MB is in the JVM, twice while it grows, and in the worker, with its copies; neither gives all of that back.
    """
    before = spark.conf.get(ARROW_BATCH)
    spark.conf.set(ARROW_BATCH, ARROW_BYTES)
    try:
        yield
    finally:
        spark.conf.set(ARROW_BATCH, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column, n: int):
    """crc32 of an id as text, modulo n; a null id has remainder -1."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(-1))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES):
    """Slices of whole rows with about `most` bytes of text each."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = texts_of(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield batch.slice(first, last - first)
        first = last


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False
_WEIGHT = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base to 0..n and its inverses, modulo 2^64."""
    if len(_powers["up"]) <= n:
        for k, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps_ = np.full(n + 1, base, np.uint64)
            steps_[0] = 1
            _powers[k] = np.multiply.accumulate(steps_)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums of weighted powers: all spans at once."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WEIGHT[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ROUNDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of byte spans, in two halves: one to one for spans of one length up to 16 bytes, BLAKE2b for longer ones."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    a, b = eight[starts] & _HEAD[np.minimum(size, 8)], eight[starts + 8 * (size > 8)] & _HEAD[np.clip(size - 8, 0, 8)]
    n = size.astype(np.uint64)
    for k in range(0, len(_ROUNDS), 2):  # a balanced Feistel network
        a ^= mix(b + _ROUNDS[k] + n)
        b ^= mix(a + _ROUNDS[k + 1] + n)
    for k in np.flatnonzero(size > 16).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=16).digest()
        a[k], b[k] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    return a, b


def word_spans(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words of consecutive texts; `of` tells for each byte whether it is in a word."""
    inside = of[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    before[offsets] = False
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return _LOWER[data]
