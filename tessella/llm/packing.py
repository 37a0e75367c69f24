"""Packing documents into token sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe_ids import piece_ids
from tessella.llm.common import table

CAPACITY = 2048
#: Tokens after which a group is packed, and groups that a task fills at a time.
GROUP_TOKENS, GROUPS = 1 << 18, 4
END = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Room of bins in a tree of maxima, to find the first bin with enough room."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [0] * (2 * self.leaves)
        for k in range(bins):
            self.most[self.leaves + k] = room
        for k in range(self.leaves - 1, 0, -1):
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])

    def first(self, size: int) -> int:
        k = 1
        while k < self.leaves:
            k = 2 * k if self.most[2 * k] >= size else 2 * k + 1
        return k - self.leaves

    def take(self, bin_: int, size: int) -> None:
        k = bin_ + self.leaves
        self.most[k] -= size
        while k > 1:
            k //= 2
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces that hold each token of each document once.

    A document's full sequences are cut off first. The rests go by first-fit decreasing. Then the emptiest
    sequences are broken up and cut to fill the gaps of the others exactly, and the one that is left over is
    cut into sequences whose lengths are powers of two. So at most the cuts, not the padding, grow with the rests.
    """
    full, rests = [], []
    for doc, size in enumerate(sizes):
        full += [[(doc, at, capacity)] for at in range(0, size - size % capacity, capacity)]
        if size % capacity:
            rests.append((doc, size - size % capacity, size % capacity))
    rests.sort(key=lambda r: (-r[2], r[0]))
    tree, bins = Tournament(len(rests), capacity), []
    for rest in rests:
        k = tree.first(rest[2])
        tree.take(k, rest[2])
        if k == len(bins):
            bins.append([])
        bins[k].append(rest)
    fill = [sum(r[2] for r in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-fill[k], k))
    bins, gaps, first = [bins[k] for k in order], [capacity - fill[k] for k in order], 0
    while len(bins) > first + 1:
        if not gaps[first]:
            first += 1
            continue
        doc, start, length = bins[-1].pop()
        cut = min(length, gaps[first])
        bins[first].append((doc, start + length - cut, cut))
        gaps[first] -= cut
        gaps[-1] += cut
        if cut < length:
            bins[-1].append((doc, start, length - cut))
        elif not bins[-1]:
            bins.pop()
            gaps.pop()
    if bins and gaps[-1]:
        last, total = bins.pop(), capacity - gaps[-1]
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                need, piece = 1 << bit, []
                while need:
                    doc, start, length = last.pop(0)
                    cut = min(need, length)
                    piece.append((doc, start, cut))
                    need -= cut
                    if cut < length:
                        last.insert(0, (doc, start + cut, length - cut))
                bins.append(piece)
    return full + bins


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, seed: int = 7) -> DataFrame:
    """PIECE rows of docs(doc_id, text): each document's ids and its end id, cut and packed into sequences.

    ids_crc32 is over the piece's ids as little-endian unsigned 32-bit integers; sequence_id is unique over all
    groups. A null text is empty (one piece, the end id); an added token's string has that token's id. Rows of one
    doc_id, and rows without one, are documents of their own. Other columns are ignored; an empty table gives an
    empty result; a document is never cut before it is encoded.

    A task deals the documents it reads at random to GROUPS groups; a group is packed once it has `group_tokens`
    tokens, and what is left at the task's end is packed together. So a task holds a bounded number of tokens besides one document's, whatever
    the ids and the copies are, and nothing is shuffled.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def fill(group: list[tuple[int | None, np.ndarray]], base: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of a group, and how many sequences they make."""
        group = sorted(group, key=lambda d: (d[0] is None, d[0] or 0, len(d[1])))
        rows, sequences = [], pack([len(ids) for _, ids in group], capacity)
        for k, pieces in enumerate(sequences):
            offset = 0
            for d, start, length in pieces:
                doc_id, own = group[d]
                own_ids = np.ascontiguousarray(own[start : start + length], "<u4")
                rows.append((doc_id, start, length, zlib.crc32(own_ids), len(own), base + k, offset))
                offset += length
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows)], [c.split()[0] for c in PIECE.split(", ")]), len(sequences)

    def run(batches):
        part, table_ = TaskContext.get().partitionId(), piece_ids(path)
        rng, made = np.random.default_rng((seed, part)), part << 40
        groups, held = [[] for _ in range(GROUPS)], [0] * GROUPS
        for batch in batches:
            for doc_id, text, g in zip(batch.column(0).to_pylist(), batch.column(1), rng.integers(0, GROUPS, batch.num_rows).tolist()):
                ids = np.append(np.frombuffer(table_.ids(text.as_py()), table_.kind), table_.kind.type(END))
                groups[g].append((doc_id, ids))
                held[g] += len(ids)
                if held[g] >= group_tokens:
                    out, n = fill(groups[g], made)
                    yield out
                    groups[g], held[g], made = [], 0, made + n
        if any(groups):
            yield fill(sum(groups, []), made)[0]

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, PIECE)


def op9(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
