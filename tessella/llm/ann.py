"""Nearest neighbours by multi-index hashing of learned rotated binary codes, with float reranking."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

#: Bits of a substring: so many more than the logarithm of the number of vectors, so that buckets don't grow with them, within these bounds.
WIDTH_MORE, WIDTH_LEAST, WIDTH_MOST = 1, 16, 32
#: Most substrings of a code; bits by which a probe may differ.
SUBSTRINGS_MOST, PROBE_BITS = 320, 1
#: 64-bit integers of a code that candidates are compared by.
WORDS = 4
#: A query's radius is that of its so many nearest codes among those that probing meets, and of all codes at that distance.
RERANKED = 512
#: Beyond PROBE_BITS a probe also flips this many at once of so many of a query's bits, those nearest to the border: (bits flipped, among).
FLIPS = ((2, 7), (3, 6), (4, 5))
#: Vectors that the rotations and the radius are learned from, at most, and steps of learning a rotation.
FIT_ROWS, FIT_QUERIES, FIT_STEPS = 4096, 256, 6
#: Shares of the fit queries' true neighbours that the substrings must meet, and that the radius must hold. The first
#: is (all vectors are in the sample, there are more): among more vectors neighbours are nearer than in the sample.
FIT_RECALL, FIT_RADIUS = (0.95, 0.92), 0.99
#: Queries that are compared with all rows at a time, where probing has found fewer than k.
REST_QUERIES = 2048
#: Numbers in a block of pairs that are compared at once.
COMPARED = 1 << 20
INDEX = "bucket long, vec long, " + ", ".join(f"c{j} long" for j in range(WORDS))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if x.size else x


def rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A rotation of centred vectors, learned by iterative quantisation from a random one."""
    d = x.shape[1]
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    for _ in range(FIT_STEPS if len(x) > d else 0):
        left, _, right = np.linalg.svd(np.where(x @ turn >= 0, 1.0, -1.0).T @ x)
        turn = (left @ right).T
    return turn


def neighbours(fit: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The places of each fit vector's k nearest in x, whose first vectors they are, without itself."""
    near = np.argsort(-(fit @ x.T), axis=1, kind="stable")[:, : k + 1].tolist()
    return np.array([[v for v in row if v != q][:k] for q, row in enumerate(near)])


class Codes:
    """Learned rotations, how many substrings of their signs are indexed, and the radius that neighbours need.

    The signs under all rotations, one rotation after another, are a code; `width` of them make a substring. By the
    pigeonhole principle all codes that differ in up to (PROBE_BITS + 1) * substrings - 1 bits share a substring but
    for PROBE_BITS bits. Neighbours are often further apart than that in all bits and still share one, more so if
    bits of the query that are near the border are flipped too (FLIPS); the number of substrings is the least that
    meets FIT_RECALL of the true neighbours of the fit queries. The radius holds FIT_RADIUS of them.
    """

    def __init__(self, sample: np.ndarray, k: int, n: int, seed: int = 3):
        rng, x = np.random.default_rng(seed), _unit(sample)
        self.d = x.shape[1] if x.size else 1
        self.mean = x.mean(0) if len(x) else np.zeros(self.d)
        centred, fit = x - self.mean, x[:FIT_QUERIES]
        self.width = min(max((n - 1).bit_length() + WIDTH_MORE, WIDTH_LEAST), WIDTH_MOST)
        turns = [rotation(centred[:1024] if x.size else np.zeros((0, self.d)), rng) for _ in range(-(-SUBSTRINGS_MOST * self.width // self.d))]
        self.turns = np.concatenate(turns, axis=1)
        self.substrings, self.radius, self.opened = SUBSTRINGS_MOST, 64 * WORDS, 1.0
        if len(x) > k + 1:
            near = neighbours(fit, x, k)
            subs, asked = self.substrings_of(sample, SUBSTRINGS_MOST), self.probes_of(sample[: len(fit)], SUBSTRINGS_MOST)
            met = np.stack([(asked[:, t, None, :] == subs[near, t, None]).any(2) for t in range(SUBSTRINGS_MOST)], axis=2)
            recall = np.logical_or.accumulate(met, axis=2).mean((0, 1))
            enough = np.flatnonzero(recall >= FIT_RECALL[n > len(x)])
            if len(enough):
                self.substrings = int(enough[0]) + 1
            code = self.codes_of(sample)
            apart = np.bitwise_count(code[: len(fit), None] ^ code[near]).sum(2)
            self.radius = int(np.quantile(apart, FIT_RADIUS, method="higher"))
            seen = [np.logical_or.reduce([np.isin(subs[:, t], asked[q, t]) for t in range(self.substrings)]) for q in range(min(16, len(fit)))]
            self.opened = float(np.mean(seen))
        self.turns = self.turns[:, : max(self.substrings, WORDS * self.lanes) * self.width]

    def turned(self, vectors: np.ndarray, n: int) -> np.ndarray:
        return (_unit(vectors) - self.mean) @ self.turns[:, :n]

    def substrings_of(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The first substrings of each vector's code."""
        bits = self.turned(vectors, count * self.width).reshape(len(vectors), count, self.width) >= 0
        return bits @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def probes_of(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """For each vector and each of its first substrings: all values within PROBE_BITS bits, and those of FLIPS."""
        turned = self.turned(vectors, count * self.width).reshape(len(vectors), count, self.width)
        one = np.int64(1) << np.arange(self.width, dtype=np.int64)
        own = (turned >= 0) @ one
        border = one[np.argsort(np.abs(turned), axis=2)]
        balls = [sum((1 << b for b in bits), 0) for r in range(PROBE_BITS + 1) for bits in combinations(range(self.width), r)]
        masks = [np.broadcast_to(np.array(balls, np.int64), (*own.shape, len(balls)))]
        for r, among in FLIPS:
            masks += [border[:, :, list(bits)].sum(2, keepdims=True) for bits in combinations(range(among), r)]
        return own[:, :, None] ^ np.concatenate(masks, axis=2)

    @property
    def lanes(self) -> int:
        """Substrings in 64 bits."""
        return 64 // self.width

    def codes_of(self, vectors: np.ndarray) -> np.ndarray:
        """The first substrings of each vector's code, as many as WORDS 64-bit integers hold: those that candidates are compared by."""
        subs = self.substrings_of(vectors, WORDS * self.lanes).astype(np.uint64).reshape(len(vectors), WORDS, self.lanes)
        return (subs << (np.arange(self.lanes) * self.width).astype(np.uint64)).sum(2, dtype=np.uint64)

    def rows(self, ids: np.ndarray, vectors: np.ndarray, probes: bool):
        """INDEX rows: each substring's bucket; with probes also the buckets of its probes."""
        code, place = self.codes_of(vectors), np.arange(self.substrings, dtype=np.int64) << 32
        bucket = self.probes_of(vectors, self.substrings) + place[:, None] if probes else self.substrings_of(vectors, self.substrings) + place
        bucket = bucket.reshape(len(ids), -1)
        each = bucket.shape[1]
        columns = [bucket.ravel(), np.repeat(ids, each), *(np.repeat(code[:, j].view(np.int64), each) for j in range(WORDS))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in INDEX.split(", ")])


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of x with those of y, in double precision."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _vectors(batch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def candidates(rows: DataFrame, asked: DataFrame, codes: Codes, reranked: int = RERANKED) -> DataFrame:
    """(q, vec): the vectors of rows(vec, embedding) that probing finds within the radius of each of asked(vec, embedding).

    A pair that agrees on one of the substrings in its codes is met there only, so alike vectors don't meet in all tables.
    The radius is the fitted one, or for a query with more codes in it that of its `reranked` nearest.
    """
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def buckets(probes):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield shared.value.rows(np.asarray(part.column(0), np.int64), _vectors(part, "embedding"), probes)

        return run

    index = rows.select("vec", "embedding").mapInArrow(buckets(False), INDEX)
    probes = asked.select("vec", "embedding").mapInArrow(buckets(True), INDEX).withColumnRenamed("vec", "q")
    xor = [index[c].bitwiseXOR(probes[c]) for c in (f"c{j}" for j in range(WORDS))]
    apart = reduce(add, map(F.bit_count, xor))
    lane = lambda j: F.shiftrightunsigned(xor[j // codes.lanes], j % codes.lanes * codes.width).bitwiseAND(F.lit((1 << codes.width) - 1))
    first = [(lane(j) != 0) | (F.shiftright(index.bucket, 32) <= j) for j in range(WORDS * codes.lanes)]
    met = index.join(probes.hint("merge"), reduce(and_, first, (index.bucket == probes.bucket) & (apart <= codes.radius)))
    pairs = met.select("q", "vec", apart.alias("apart")).distinct()
    return pairs.withColumn("place", F.rank().over(Window.partitionBy("q").orderBy("apart"))).where(F.col("place") <= reranked).select("q", "vec")


def _fit(rows: DataFrame, d: int, k: int, n: int) -> Codes:
    sample = rows.orderBy(F.xxhash64("embedding"), "vec").limit(FIT_ROWS).select("embedding").toArrow().column(0)
    return Codes(np.asarray(sample.combine_chunks().flatten()).reshape(-1, d), k, n)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries(vec_id, embedding) its k nearest of vectors(vec_id, embedding).

    Nearness is the cosine in double precision; ties go to the smaller vec_id; a row with the query's own vec_id
    is no candidate. Vectors that are null or zero, that hold a null, NaN or infinity, whose length isn't the
    commonest one, or that have no vec_id take no part. Queries of one vec_id count once; a candidate counts as often as its row is repeated. Other columns are
    ignored; an empty table gives an empty result; with fewer than k candidates all are returned.

    Equal vectors are searched for, and found, once, with the k + 1 smallest of their ids (k rows of each at most), so copies don't make
    buckets grow. Rotations and radius are fitted on at most FIT_ROWS vectors; every vector is indexed: a row for each
    substring of its code. Probes meet these rows in one join on the bucket; codes within the radius are reranked
    by the floats. A query that finds fewer than k is compared with all rows, REST_QUERIES at a time.
    """
    valid = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    clean = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid)
    rows = clean(vectors)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d, n = (common["d"], common["count"]) if common else (1, 0)
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    each = rows.where(F.size("embedding") == d).groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    few = each.withColumn("place", place).where(F.col("place") <= k + 1).withColumn("ids", F.array_repeat("vec_id", F.col("n")))
    ids = F.sort_array(F.flatten(F.collect_list("ids")))
    rows = settle(few.groupBy("embedding").agg(ids.alias("ids")).select(F.col("ids")[0].alias("vec"), "ids", "embedding"), "vectors")
    wanted = clean(queries).where(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    wanted = settle(wanted.withColumn("q", F.first("vec_id").over(Window.partitionBy("embedding").orderBy("vec_id"))), "queries")
    asked = wanted.where("q = vec_id").select(F.col("vec_id").alias("vec"), "embedding")
    codes = _fit(rows, d, k, n)
    pairs = settle(candidates(rows, asked, codes), "candidates")

    def scored(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine(_vectors(batch, "x"), _vectors(batch, "y")))], ["q", "ids", "score"])

    both = pairs.join(asked.select(F.col("vec").alias("q"), F.col("embedding").alias("x")), "q").join(rows.select("vec", "ids", F.col("embedding").alias("y")), "vec")
    found = both.select("q", "ids", "x", "y").mapInArrow(scored, "q long, ids array<long>, score double").select("q", F.explode("ids").alias("vec_id"), "score")
    best = settle(_best(found, k), "found")
    own = best.groupBy("q", "vec_id").agg(F.count("*").alias("n")).groupBy(F.col("q").alias("vec")).agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    short = settle(asked.join(own.where(F.col("all") - F.col("most") >= k), "vec", "left_anti"), "short")
    if not short.isEmpty():
        best = best.join(short.select(F.col("vec").alias("q")), "q", "left_anti").unionByName(_compared(rows, short, k))
    best = best.withColumnRenamed("vec_id", "found")
    out = wanted.select("vec_id", "q").join(best, "q").where("found <> vec_id")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "found"))
    return out.select(F.col("vec_id").alias("query_id"), rank.alias("rank"), F.col("found").alias("vec_id"), "score").where(F.col("rank") <= k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, score): the 2k nearest rows of each q, of which no vec_id has more than k.

    Without any one vec_id, that of a query, k of them are left.
    """
    of_id, of_all = (Window.partitionBy(*c).orderBy(F.desc("score"), "vec_id") for c in (("q", "vec_id"), ("q",)))
    few = found.withColumn("place", F.row_number().over(of_id)).where(F.col("place") <= k)
    return few.withColumn("place", F.row_number().over(of_all)).where(F.col("place") <= 2 * k).select("q", "vec_id", "score")


def _tops(near: np.ndarray, alone: np.ndarray, k: int) -> np.ndarray:
    """(query, row) places of the rows that may hold the 2k best of _best: alone is the vec_id of rows that have one only, else -1."""
    order = np.argsort(-near, axis=1, kind="stable")
    ids, n = np.unique(alone[alone >= 0], return_counts=True)
    if not len(ids) or n.max() <= k:
        order = order[:, : 2 * k]
        return np.stack([np.repeat(np.arange(len(near)), order.shape[1]), order.ravel()], 1)
    by = np.argsort(alone[order], axis=1, kind="stable")
    own = np.take_along_axis(alone[order], by, 1)
    start = np.maximum.accumulate(np.where(np.c_[np.ones(len(own), bool), own[:, 1:] != own[:, :-1]], np.arange(own.shape[1]), 0), axis=1)
    turn = np.empty_like(by)
    np.put_along_axis(turn, by, np.arange(own.shape[1]) - start, 1)
    kept = (alone[order] < 0) | (turn < k)
    kept &= np.cumsum(kept, 1) <= 2 * k
    q, place = np.nonzero(kept)
    return np.stack([q, order[q, place]], 1)


def _compared(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, score): the rows of _best for each of asked among all rows, a bounded number of queries at a time."""
    parts = max(1, -(-asked.count() // REST_QUERIES))
    spread = F.pmod(F.xxhash64("vec"), F.lit(parts))
    out = None
    for part in range(parts):
        some = asked.where(spread == part).select("vec", "embedding").toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((np.asarray(some.column(0).combine_chunks(), np.int64), np.asarray(some.column(1).combine_chunks().flatten(), np.float64).reshape(some.num_rows, -1)))

        def run(batches, shared=shared):
            q, x = shared.value
            for batch in batches:
                y = _vectors(batch, "embedding") if batch.num_rows else None
                ids = batch.column(0).to_pylist()
                numbers = {v: n for n, v in enumerate(sorted({own[0] for own in ids}))}
                alone = np.array([numbers[own[0]] if own[0] == own[-1] else -1 for own in ids])
                for at in range(0, batch.num_rows, 512) if len(q) else ():
                    own = y[at : at + 512]
                    step = max(1, COMPARED // own.size)
                    for first in range(0, len(q), step):
                        near = cosine(np.repeat(x[first : first + step], len(own), axis=0), np.tile(own, (len(x[first : first + step]), 1))).reshape(-1, len(own))
                        row, place = _tops(near, alone[at : at + 512], k).T
                        yield pa.RecordBatch.from_arrays([pa.array(q[first + row]), batch.column(0).take(pa.array(place + at)), pa.array(near[row, place])], ["q", "ids", "score"])

        found = rows.select("ids", "embedding").mapInArrow(run, "q long, ids array<long>, score double").select("q", F.explode("ids").alias("vec_id"), "score")
        found = settle(_best(found, k), "compared")
        out = found if out is None else out.unionByName(found)
    return out


def op6(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
