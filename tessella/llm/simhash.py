"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, components of linked fingerprints."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, settle, small_batches
from tessella.llm.components import connected_components
from tessella.llm.jaccard import jaccard_groups

#: Codes of a block, children of a node, queries of a step.
BLOCK_CODES, FANOUT, CHUNK = 1 << 15, 8, 1024
#: Fingerprints of so many rows or more are joined to their rows by a broadcast.
HOT_ROWS = 20_000
BLOCK = "block long, turn long, low long, high long, codes binary"


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of one text: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    found = re.findall(WORD, (text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return 0
    whole = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(found) - words + 1
    for at in range(0, n, 4096):
        upto = min(at + 4096, n)
        part = [digest(whole[s:e], 42) for s, e in zip(starts[at:upto].tolist(), ends[at + words - 1 : upto + words - 1].tolist())]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, carry: str | None = None) -> DataFrame:
    """(doc_id, fp, key): the fingerprint of each whole text as a signed 64-bit integer; null texts count as empty.

    `carry` names a string column of docs that comes along as key.
    """

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "key"])

    key = F.col(carry) if carry else F.lit(None)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), key.cast("string").alias("key")).mapInArrow(run, "doc_id long, fp long, key string")


def gray_rank(fp: Column) -> Column:
    """The place of a code in the Gray sequence, as a signed integer that sorts as the unsigned one does."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """A tree over codes, or over groups of codes, in Gray order.

    A node holds the bits that all codes below it share and that no node above it holds. A search adds up the
    differing bits on its way down and leaves a node, with all below it, once they are over the limit, or at
    once if one of the bits in `exact` differs. A group is given by the AND (`low`) and the OR (`high`) of its codes.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray | None = None, exact: int = 0):
        high, levels = low if high is None else high, []
        levels.append((~(low ^ high), low))
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            levels.append((~(low ^ high), low))
        self.exact, self.values = np.uint64(exact), [value for _, value in levels[::-1]]
        masks = [mask for mask, _ in levels[::-1]]
        self.own = [m & ~np.repeat(masks[k - 1], FANOUT)[: len(m)] if k else m for k, m in enumerate(masks)]
        #: Nodes that searches have compared, for tests and reports.
        self.compared = 0

    def search(self, queries: np.ndarray, limit: int):
        """(places of queries, places of codes or groups) that differ in `limit` bits at most, query chunk by chunk."""
        for at in range(0, len(queries) if len(self.values[0]) else 0, CHUNK):
            some = queries[at : at + CHUNK]
            q, node, spent = np.arange(len(some)), np.zeros(len(some), np.int64), np.zeros(len(some), np.uint8)
            for k, value in enumerate(self.values):
                if k:
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    there = node < len(value)
                    q, node, spent = np.repeat(q, FANOUT)[there], node[there], np.repeat(spent, FANOUT)[there]
                differ = (some[q] ^ value[node]) & self.own[k][node]
                self.compared += len(q)
                spent = spent + np.bitwise_count(differ)
                on = (spent <= limit) & (differ & self.exact == 0)
                q, node, spent = q[on], node[on], spent[on]
            yield q + at, node


def stars(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """(place, smallest place it is connected with) for all of n that pairs connect with a smaller one."""
    root = np.arange(n)
    for i, j in pairs:
        while (root[i] != root[j]).any():
            low = np.minimum(root[i], root[j])
            for x in (root[i], root[j]):
                np.minimum.at(root, x, low)
            while (root[root] != root).any():
                root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _turned(codes: np.ndarray, left: int) -> np.ndarray:
    return codes << np.uint64(left) | codes >> np.uint64(64 - left) if left % 64 else codes


def _links(codes: np.ndarray, at: np.ndarray, root: np.ndarray, left: int) -> pa.RecordBatch:
    a, b = (_turned(codes[x], (64 - left) % 64).view(np.int64) for x in (at, root))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


class Turns:
    """How the bits are turned: a run of them comes first in each turn, and codes within the limit agree on a run at least."""

    def __init__(self, limit: int):
        self.limit, self.cuts = limit, [round(64 * k / (limit + 1)) for k in range(limit + 2)]

    def columns(self) -> Column:
        turn = lambda a: F.shiftleft("fp", a).bitwiseOR(F.shiftrightunsigned("fp", 64 - a)) if a else F.col("fp")
        return F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), turn(a).alias("code")) for k, a in enumerate(self.cuts[:-1])])

    def exact(self, turn: int) -> int:
        width = self.cuts[turn + 1] - self.cuts[turn]
        return (1 << width) - 1 << 64 - width


def _in_blocks(most: int):
    """Rows (turn, code) in Gray order as blocks of up to `most` codes of one turn."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        turn, codes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            turn, codes = (np.concatenate([x, np.asarray(batch.column(k), np.int64)]) for k, x in enumerate((turn, codes)))
            while len(turn) and (turn[0] != turn[-1] or len(turn) >= most):
                n = min(most, int(np.searchsorted(turn, turn[0], "right")))
                yield block(part << 32 | made, turn[0], codes[:n])
                turn, codes, made = turn[n:], codes[n:], made + 1
        if len(turn):
            yield block(part << 32 | made, turn[0], codes)

    def block(k, turn, codes):
        own = codes.view(np.uint64)
        low, high = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((k, int(turn), int(low.view(np.int64)), int(high.view(np.int64)), codes.tobytes()), kinds)], [c.split()[0] for c in BLOCK.split(", ")])

    return run


def _codes(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def near_links(fps: DataFrame, limit: int = 2, block: int = BLOCK_CODES) -> DataFrame:
    """(a, b): links between distinct fingerprints fps(fp), whose components are those of all pairs within `limit` bits.

    The bits are turned in limit + 1 ways, each with another run of them in front; two codes within the limit agree
    on the run in front of one turn at least. The codes of a turn are sorted by Gray rank, over the whole table, and
    cut into blocks. A block is a tree whose nodes hold shared bits; the blocks' own shared bits are the leaves of an
    upper tree. A code goes down the upper tree, which prunes blocks, then down the trees of the blocks that are left: its own
    and, where codes of its run go on in others, those of them that can hold a code within the limit.
    However large a group of codes with one run is, it is cut into blocks, so a task's size is bounded.

    The driver holds a row for each `block` codes: the upper tree. Links are stars in a block, never all pairs.
    """
    spark, turns = fps.sparkSession, Turns(limit)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turned = fps.select(F.explode(turns.columns()).alias("t")).select("t.turn", "t.code").withColumn("rank", gray_rank(F.col("code")))
    ordered = turned.repartitionByRange(parts, "turn", "rank").sortWithinPartitions("turn", "rank").select("turn", "code")
    blocks = settle(ordered.mapInArrow(_in_blocks(block), BLOCK), "gray-blocks")
    roots = blocks.select("block", "turn", "low", "high").orderBy("turn", "block").toArrow()
    ids, own_turn, low, high = (np.asarray(roots.column(k).combine_chunks(), np.int64) for k in range(4))
    upper = spark.sparkContext.broadcast({t: (ids[own_turn == t], low[own_turn == t].view(np.uint64), high[own_turn == t].view(np.uint64)) for t in range(limit + 1)})

    def within(batches):
        for batch in batches:
            for turn, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = _codes(value)
                found = GrayIndex(codes, exact=turns.exact(turn)).search(codes, limit)
                yield _links(codes, *stars(len(codes), ((q[q < c], c[q < c]) for q, c in found)), turns.cuts[turn])

    def sent(batches):
        trees = {t: (own, GrayIndex(a, b, turns.exact(t))) for t, (own, a, b) in upper.value.items()}
        for batch in batches:
            for k, turn, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                codes, (own, tree) = _codes(value), trees[turn]
                found = list(tree.search(codes, limit))
                q, to = (np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in (0, 1))
                q, to = q[own[to] > k], to[own[to] > k]
                by = np.argsort(to, kind="stable")
                q, to = q[by], to[by]
                first = np.flatnonzero(np.diff(to, prepend=-1))
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(to)]):
                    yield pa.RecordBatch.from_arrays([pa.array([int(own[to[a]])]), pa.array([codes[q[a:b]].tobytes()], pa.binary())], ["block", "asked"])

    def between(batches):
        for batch in batches:
            for turn, value, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                codes, asked = _codes(value), _codes(asked)
                found = GrayIndex(codes, exact=turns.exact(turn)).search(asked, limit)
                yield _links(np.concatenate([codes, asked]), *stars(len(codes) + len(asked), ((c, q + len(codes)) for q, c in found)), turns.cuts[turn])

    links = blocks.select("turn", "codes").mapInArrow(within, "a long, b long")
    asked = settle(blocks.select("block", "turn", "codes").mapInArrow(sent, "block long, asked binary"), "asked")
    across = asked.join(blocks.select("block", "turn", "codes"), "block").select("turn", "codes", "asked")
    return links.unionAll(across.mapInArrow(between, "a long, b long"))


def simhash_groups(docs: DataFrame, words: int = 3, limit: int = 2, block: int = BLOCK_CODES, carry: str | None = None) -> DataFrame:
    """(doc_id, fp, key, root, component_id) for each row of docs(doc_id, text).

    component_id is the smallest doc_id reachable, root the smallest fingerprint, key the column `carry`.

    Nulls: a null or wordless text has fingerprint 0 and links as any other; a null doc_id stays a row and its
    component is the smallest id among its links, null if there is none. Repeated rows each keep a row. Other
    columns are ignored. An empty table gives an empty result. A text is never cut.

    Only fingerprints of two rows or more, or with links, are joined back to the rows; those of very many rows are
    at most one in HOT_ROWS rows and are broadcast, so no task has all rows of one fingerprint.
    """
    each = settle(fingerprints(docs, words, carry), "fingerprints")
    codes = settle(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "codes")
    links = settle(near_links(codes.select("fp"), limit, block), "links")
    roots = settle(connected_components(links), "roots")
    linked = codes.join(roots, codes.fp == roots.v).select("fp", "root", "low", "n")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = linked.join(lows, "root").select("fp", "root", "component_id", "n")
    alone = codes.where("n > 1").join(roots, F.col("fp") == F.col("v"), "left_anti").select("fp", F.col("fp").alias("root"), F.col("low").alias("component_id"), "n")
    classes = settle(linked.unionByName(alone), "classes").withColumnRenamed("fp", "c")
    hot, rest = (classes.where(w).drop("n") for w in (f"n >= {HOT_ROWS}", f"n < {HOT_ROWS}"))
    hot = hot.select(F.col("c").alias("h"), F.col("root").alias("h_root"), F.col("component_id").alias("h_component"))
    both = each.join(F.broadcast(hot), each.fp == hot.h, "left").withColumn("c", F.when(F.col("h").isNull(), F.col("fp")))
    out = both.join(rest, "c", "left")
    only = F.col("c").isNotNull() & F.col("root").isNull()
    return out.select("doc_id", "fp", "key", F.coalesce("h_root", "root", "fp").alias("root"), F.when(only, F.col("doc_id")).otherwise(F.coalesce("h_component", "component_id")).alias("component_id"))


def near_copy_groups(docs: DataFrame, words: int = 5, share: tuple[int, int] = (4, 5), limit: int = 2, carry: str = "key") -> DataFrame:
    """(doc_id, key, root) for each row of docs(doc_id, text, carry): root is equal for rows that near copies connect.

    Near copies have a Jaccard similarity of share[0] / share[1] or more on sets of shingles. The index gives the
    rows whose fingerprints are within the limit, which are compared on whole sets; fingerprints of most pairs at
    0.8 are further apart than any limit that an index can prune by, so an exact join finds the rest. Both
    keep only pairs that have the similarity. Edge cases as in simhash_groups; a text of fewer words than a
    shingle is one shingle, and texts without words are copies of each other.
    """
    with small_batches(docs.sparkSession):
        each = settle(fingerprints(docs, words, carry), "fingerprints")
        codes = settle(each.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")), "codes")
        links = settle(near_links(codes.select("fp"), limit), "links")
    first = codes.select("fp", "first")
    across = links.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    hot, rest = (codes.where(w).select("fp", "first") for w in (f"n >= {HOT_ROWS}", f"n > 1 and n < {HOT_ROWS}"))
    same = [each.join(f, "fp").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b")) for f in (F.broadcast(hot), rest)]
    found = jaccard_groups(docs, words, share, carry, across.unionByName(same[0]).unionByName(same[1]), empty=True)
    return found.select("doc_id", "key", "root")


def op1(spark, sf_dir: str) -> DataFrame:
    from tessella.llm.common import table

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
