"""Whitening of embeddings by principal components found without a covariance matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

#: Entries become floor(GRID * c).
GRID = 256
#: Columns of a block for each component asked for.
BLOCK_X = 4
#: Blocks that are kept; beyond it the best Ritz vectors go on alone.
KEPT_BLOCKS = 8
#: A component is certified by a residual of at most this share of the largest eigenvalue; smaller eigenvalues than this share are zero.
CERTIFIED = 1e-13
MOST_PASSES = 200
#: Numbers that one vectorised step holds.
STEP_VALUES = 1 << 20


def _usable(c: Column) -> Column:
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def gridded(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x array<long>) of the usable rows, and their dimension (0: there are none)."""
    each = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("c")).where(_usable(F.col("c")))
    common = each.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return each.where(F.size("c") == d).select("vec_id", F.transform("c", lambda v: F.floor(v * GRID)).alias("x")), d


def _matrices(batches, name: str, d: int):
    """(batch slice, its vectors as a matrix) in bounded steps."""
    wide = max(1, STEP_VALUES // d)
    for batch in batches:
        for at in range(0, batch.num_rows, wide):
            part = batch.slice(at, wide)
            values = part.column(part.schema.get_field_index(name)).flatten()
            yield part, np.asarray(values, np.int64).reshape(-1, d)


def _summed(fit: DataFrame, d: int, cells: int, kernel) -> np.ndarray:
    """kernel(matrix) of `cells` numbers, summed over all vectors: within a task by numpy, among tasks by Spark."""

    def run(batches):
        total = np.zeros(cells)
        for _, x in _matrices(batches, "x", d):
            total += kernel(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "v"])

    out = np.zeros(cells)
    for row in fit.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[row["cell"]] = row["v"]
    return out


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension: halves of 32 bits are summed apart."""

    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _matrices(batches, "x", d):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    halves = fit.select("x").mapInArrow(run, "dim long, n long, high long, low long")
    rows = halves.groupBy("dim").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low"))).collect()
    sums = [0] * d
    for r in rows:
        sums[r["dim"]] = (int(r["high"]) << 32) + int(r["low"])
    return (rows[0]["n"] if rows else 0), sums


def _fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what block adds to the span of basis (none, if nothing)."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.size else q


def components(apply, d: int, k: int, block_x: int = BLOCK_X, kept: int = KEPT_BLOCKS, seed: int = 20240917) -> tuple[np.ndarray, np.ndarray, int]:
    """Falling eigenvalues, unit eigenvectors (columns) and passes, for the k largest of a symmetric matrix given by apply(Q).

    Block subspace iteration: each pass applies the matrix to one block; QR makes the block orthogonal to those before,
    Rayleigh-Ritz takes the best vectors of all blocks kept, and what they miss (their residuals) is the next block. It
    ends when the residuals of all k are at most CERTIFIED of the largest value, or nothing new is left to apply it to.
    Blocks before the last are kept because nearly equal eigenvalues would need hundreds of passes without. Beyond
    `kept` blocks only the best Ritz vectors stay. Directions without variance give no component.
    """
    wide = min(d, block_x * k)
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, wide)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for passes in range(1, MOST_PASSES + 1):
        basis, image = np.hstack([basis, new]), np.hstack([image, apply(new)])
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, image @ turn
        missed = moved[:, :wide] - ritz[:, :wide] * value[:wide]
        top = min(k, len(value))
        done = np.linalg.norm(missed[:, :top], axis=0) <= CERTIFIED * max(value[0], 0)
        new = _fresh(missed, basis)
        if done.all() or not new.shape[1]:
            if not done.all() and np.linalg.norm(missed[:, :top], axis=0).max() > 1e3 * CERTIFIED * value[0]:
                raise ArithmeticError("the components couldn't be certified")
            real = value[:top] > CERTIFIED * max(value[0], 0)
            return value[:top][real], ritz[:, :top][:, real], passes
        if basis.shape[1] + new.shape[1] > max(kept * wide, 2 * wide):
            basis, image = ritz[:, : 2 * wide - wide // 2], moved[:, : 2 * wide - wide // 2]
            new = _fresh(missed, basis)
    raise ArithmeticError(f"no {k} certified components after {MOST_PASSES} passes")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row the sum over dimensions of (n * x - S)^2, exactly."""
    most = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, sums)) if len(x) else 0
    if most * most * x.shape[1] < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = x.astype(object) * n - np.array(sums, object)
    return (off * off).sum(axis=1).tolist()


def whiten(vectors: DataFrame, k: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of vectors(vec_id, embedding).

    Entries become x = floor(256 * c). The fit list holds each distinct x vector once; mean, covariance (divisor n) and
    components are over it, so copies, however many, don't weigh. Components have numbers from 1 by falling eigenvalue.
    `deviation` is decimal(38,0), exact, and null only if it doesn't fit.

    Rows whose vector is null or empty, holds a null, NaN or infinity, or hasn't the commonest length (of equally common
    ones the longest) take no part. A null vec_id is kept, repeated rows each keep their rows; other columns are ignored.
    Directions without variance give no component: a table with one distinct vector, like an empty one, gives an empty
    result. Equal eigenvalues have components in any direction of their space, the same for all rows.

    Passes over the fit list sum d x block numbers in each task, so nothing but such blocks comes to the driver.
    """
    spark = vectors.sparkSession
    rows, d = gridded(vectors)
    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], kinds)
    fit = settle(rows.select("x").distinct(), "fit")
    n, sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums])
    trace = float(_summed(fit, d, 1, lambda x: np.array([np.square(x - mean).sum()]))[0]) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def kernel(x):
            off = x - mean
            return (off.T @ (off @ q)).ravel()

        return _summed(fit, d, q.size, kernel).reshape(q.shape) / n

    value, axes, _ = components(apply, d, min(k, d))
    own = len(value)
    if not own:
        return spark.createDataFrame([], kinds)
    turn = axes / np.sqrt(value)

    def moments(x):
        w = (x - mean) @ turn
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums_w = _summed(fit, d, own + own * own, moments) / n
    identity = float(np.abs(sums_w[own:].reshape(own, own) - np.outer(sums_w[:own], sums_w[:own]) - np.eye(own)).max())

    def run(batches):
        for part, x in _matrices(batches, "x", d):
            w = (x - mean) @ turn
            far = [str(v) if v < 10**38 else None for v in deviations(x, n, sums)]
            at = np.repeat(np.arange(len(x)), own)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, own + 1, dtype=np.int32), len(x))), pa.array(far, pa.string()).take(pa.array(at)), pa.array(w.ravel())],
                ["vec_id", "component", "deviation", "whitened"],
            )

    out = rows.mapInArrow(run, "vec_id long, component int, deviation string, whitened double")
    explained = F.element_at(F.array(*(F.lit(float(e / trace)) for e in value)), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", explained.alias("explained"), F.lit(identity).alias("identity_error"))


def op13(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: a deviation beyond a long is null there, and whole in deviation_exact."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
