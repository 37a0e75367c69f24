"""Byte-level BPE: distinct pieces of text are merged by higher-order functions, whole texts look their pieces up."""

from __future__ import annotations

import base64
import heapq
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe_ids import PATTERN
from tessella.llm.common import fresh_path, settle, span_hashes, steps, table, texts_of
from tessella.llm.files import make_folder
from tessella.llm.hashstore import HashStore, map_arrays, shard_of, write_arrays

#: Buckets of the literal rank map: Spark searches a map from its start, so each is kept to an entry or two.
RANK_BUCKETS = 1 << 16
#: Pieces of more bytes are merged with a heap: the steps of the fold cost the square of the length.
FOLD_BYTES = 128
#: Code points that Java's Unicode tables leave unassigned: newer tables may call them letters or digits.
UNKNOWN = r"\p{Cn}"
DISTINCT_FLUSH = 1 << 20
NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: the only element of an array that is transformed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: an array of small maps from hexadecimal bytes to ranks."""
    rows: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for token, rank in ranks.items():
        name = token.hex().upper()
        rows[zlib.crc32(name.encode()) % RANK_BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), "array<map<string,int>>")


def merge_matches(matches: Column, literal: Column) -> Column:
    """The ids of matches of the pattern, given in hexadecimal, one match after another.

    A match that is a token has one id. Else a fold over as many steps as it has bytes but one merges it. The state
    is the tokens so far and the ranks of their adjacent pairs; a step joins the leftmost pair of the least rank
    and looks up the ranks of the new token's two pairs only.
    """

    def run(ranks: Column) -> Column:
        def of(token: Column) -> Column:
            bucket = F.get(ranks, (F.crc32(token.cast("binary")) % RANK_BUCKETS).cast("int"))
            return F.coalesce(F.try_element_at(bucket, token), F.lit(NONE))

        def with_place(tokens: Column, pairs: Column) -> Column:
            """A state: the tokens, their pairs' ranks and the place of the first least rank, 0 if no pair has one."""

            def place(found: Column) -> Column:
                low = F.coalesce(F.array_min(found), F.lit(NONE))
                at = F.when(low == NONE, F.lit(0)).otherwise(F.array_position(found, F.array_min(found)).cast("int"))
                return F.struct(tokens.alias("tokens"), found.alias("pairs"), at.alias("at"))

            return let(pairs, place)

        def step(state: Column, _: Column) -> Column:
            tokens, pairs, at = state["tokens"], state["pairs"], state["at"]
            token = F.concat(F.get(tokens, at - 1), F.get(tokens, at))
            before, after = of(F.concat(F.get(tokens, at - 2), token)), of(F.concat(token, F.get(tokens, at + 1)))
            joined = F.transform(tokens, lambda t, k: F.when(k == at - 1, token).when(k != at, t))
            ranked = F.transform(pairs, lambda r, k: F.when(k == at - 2, before).when(k == at, after).when(k != at - 1, r))
            joined, ranked = (F.filter(x, lambda v: v.isNotNull()) for x in (joined, ranked))
            return F.when(at == 0, state).otherwise(with_place(joined, ranked))

        def fold(match: Column) -> Column:
            n = (F.length(match) / 2).cast("int")
            places = F.sequence(F.lit(1), F.length(match) - 1, F.lit(2))
            tokens = F.transform(places, lambda k: F.substring(match, k, F.lit(2)))
            pairs = F.transform(F.slice(places, F.lit(1), n - 1), lambda k: of(F.substring(match, k, F.lit(4))))
            merged = F.aggregate(F.slice(places, F.lit(1), n - 1), with_place(tokens, pairs), step, lambda s: s["tokens"])
            return F.transform(merged, of)

        return F.flatten(F.transform(matches, lambda m: let(of(m), lambda whole: F.when(whole < NONE, F.array(whole)).otherwise(fold(m)))))

    return let(literal, run)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of any length: the least rank first, the leftmost of equals, from a heap."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(a: int) -> None:
        b = after[a]
        if b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, upto = heapq.heappop(heap)
        if not alive[a] or after[a] >= n or end[after[a]] != upto:
            continue
        b = after[a]
        alive[b], end[a], after[a] = False, end[b], after[b]
        if after[a] < n:
            before[after[a]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [ranks[piece[a : end[a]]] for a in range(n) if alive[a]]



_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of consecutive texts begin. No match of the pattern crosses such a place, and none depends on
    what lies beyond it:

    at each text; at each space before a character that isn't white space; between an ASCII letter and an ASCII
    sign; before a line break that a visible ASCII character precedes; after one between two of these.
    """
    n = len(data)
    begins = np.zeros(n + 1, bool)
    if n:
        at = np.flatnonzero(data == 32)
        byte = lambda k: data[np.minimum(at + k, n - 1)]
        one, two, three = byte(1), byte(2), byte(3)
        white = (one == 32) | ((one >= 9) & (one <= 13)) | ((one == 0xC2) & ((two == 0x85) | (two == 0xA0)))
        white |= ((one == 0xE1) & (two == 0x9A) & (three == 0x80)) | ((one == 0xE3) & (two == 0x80) & (three == 0x80))
        white |= (one == 0xE2) & (((two == 0x80) & ((three <= 0x8A) | np.isin(three, (0xA8, 0xA9, 0xAF)))) | ((two == 0x81) & (three == 0x9F)))
        begins[at[~white]] = True
        ends = offsets[1:] - 1
        begins[ends[(ends >= 0) & (data[ends] == 32)]] = False  # a space that ends a text has nothing after it
        seen, broken = (data >= 33) & (data <= 126), data == 10
        begins[1:n] |= (_LETTER[data[:-1]] & _SIGN[data[1:]]) | (seen[:-1] & broken[1:])
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        begins[2:n] |= seen[:-2] & broken[1:-1] & seen[2:] & ~first[1 : n - 1]  # a break that begins a text has nothing before it
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins[:n])


def pieces(batch: pa.RecordBatch, hashes=span_hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a batch's texts; starts, ends and 64-bit keys of their pieces; where each text's begin (and the end)."""
    data, offsets = texts_of(batch.column(batch.schema.get_field_index("text")))
    starts = cuts(data, offsets)
    ends = np.append(starts[1:], len(data)).astype(np.int64) if len(starts) else starts
    return data, starts, ends, hashes(data, starts, ends), np.searchsorted(starts, offsets)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Spans of an array one after another."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def distinct_pieces(docs: DataFrame, hashes=span_hashes) -> DataFrame:
    """(key, piece) for each 64-bit key of the texts' pieces, with a piece that has it: one for each task and more at most."""

    def run(batches):
        held_keys = np.zeros(0, np.uint64)
        for batch in batches:
            for part in steps(batch):
                data, starts, ends, keys, _ = pieces(part, hashes)
                keys, first = np.unique(keys, return_index=True)
                if len(held_keys):
                    new = held_keys[np.minimum(np.searchsorted(held_keys, keys), len(held_keys) - 1)] != keys
                    keys, first = keys[new], first[new]
                lengths = ends[first] - starts[first]
                text = gather(data, starts[first], lengths)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                column = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), column.cast(pa.string())], ["key", "piece"])
                if len(held_keys) >= DISTINCT_FLUSH:
                    held_keys = keys
                else:  # two sorted runs, which a stable sort merges
                    held_keys = np.sort(np.concatenate([held_keys, keys]), kind="stable")

    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "key long, piece string").distinct()


class Vocabulary:
    """Where the ids of a piece of each key are: a store of sorted keys with places in an array of ids."""

    def __init__(self, store: HashStore, ids: dict[int, tuple[str, int]], ranks: dict[bytes, int], pattern: str, hashes):
        self.store, self.ids, self.ranks, self.pattern, self.hashes = store, ids, ranks, pattern, hashes
        self.mapped: dict[int, np.ndarray] = {}
        self.decoder = Decoder(ranks)

    def __getstate__(self):
        return self.__dict__ | {"mapped": {}, "hashes": None}

    def encode(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a batch's texts, where each text's begin (and the end), and the bytes that the ids decode to.

        Two pieces may have one key, so what the ids decode to is compared with each piece; pieces that differ are
        merged by themselves. The decoded bytes are those of the texts then, which is checked too.
        """
        data, starts, ends, keys, bounds = pieces(batch, self.hashes)
        ids, counts = self.lookup(keys)
        places = np.concatenate([[0], np.cumsum(self.decoder.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        decoded = self.decoder.bytes_of(ids)
        if not (np.array_equal(places[:-1], starts) and np.array_equal(decoded, data)):
            same = (np.diff(places) == ends - starts) & np.fromiter((np.array_equal(decoded[p : p + e - s], data[s:e]) for p, s, e in zip(places, starts, ends)), bool, len(starts))
            own, at = [], np.cumsum(counts) - counts
            pattern = regex.compile(self.pattern)
            for k, (a, n) in enumerate(zip(at, counts)):
                if same[k]:
                    own.append(ids[a : a + n])
                else:
                    piece = data[starts[k] : ends[k]].tobytes().decode("utf-8", "surrogatepass")
                    own.append(np.array([i for m in pattern.findall(piece) for i in merge_bytes(m.encode("utf-8", "surrogatepass"), self.ranks)], np.uint32))
            ids, counts = np.concatenate(own), np.array([len(x) for x in own])
            decoded = self.decoder.bytes_of(ids)
            if not np.array_equal(decoded, data):
                raise ValueError("the ids don't decode to the text")
        return ids, np.concatenate([[0], np.cumsum(counts)])[bounds], decoded

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids that these keys have, one after another, and how many each has."""
        found, back = np.unique(keys, return_inverse=True)
        count, where, chunks, base = np.zeros(len(found), np.int64), np.full(len(found), -1), [], 0
        for at, k, place in self.store.find(found):
            if k not in self.mapped:
                self.mapped[k] = map_arrays(self.ids[k][0], [("u4", self.ids[k][1])])[0]
            ends = self.store.shard(k)[1]
            stop = ends[place].astype(np.int64)
            start = np.where(place > 0, ends[np.maximum(place - 1, 0)].astype(np.int64), 0)
            count[at] = stop - start
            where[at] = base + np.cumsum(count[at]) - count[at]
            chunks.append(gather(self.mapped[k], start, count[at]))
            base += len(chunks[-1])
        if (where < 0).any():
            raise ValueError("a piece isn't in the vocabulary: the texts have changed since it was made")
        every = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
        return gather(every, where[back], count[back]), count[back]


def make_vocabulary(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, fold_bytes: int = FOLD_BYTES, hashes=span_hashes) -> Vocabulary:
    """Ids of the distinct pieces of docs(text), by the fold over the literal rank map.

    Distinct pieces are found in each task before they are shuffled. Java's (?U) gives the pattern the Unicode
    classes; pieces with a code point that this Java doesn't know are split by `regex`, whose tables are newer, and
    merged with the heap. `hashes` gives the 64-bit keys of pieces; of pieces with one key, one is merged here, and the others
    where the texts are encoded.
    """
    spark = docs.sparkSession
    literal = rank_literal(ranks)
    found = settle(distinct_pieces(docs, hashes), "pieces")
    matches = F.transform(F.regexp_extract_all("piece", F.lit("(?U)" + pattern), F.lit(0)), lambda m: F.hex(m.cast("binary")))
    unknown, short = F.col("piece").rlike(UNKNOWN), F.octet_length("piece") <= fold_bytes
    folded = found.where(short & ~unknown).select("key", merge_matches(matches, literal).alias("ids"))

    def merge_long(batches):
        for batch in batches:
            ids = [[i for m in row.as_py() for i in merge_bytes(bytes.fromhex(m), ranks)] for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    def split_and_merge(batches):
        every = regex.compile(pattern)
        for batch in batches:
            ids = [[i for m in every.findall(piece.as_py()) for i in merge_bytes(m.encode(), ranks)] for piece in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    long = found.where(~short & ~unknown).select("key", matches.alias("matches")).mapInArrow(merge_long, "key long, ids array<int>")
    newer = found.where(unknown).select("key", "piece").mapInArrow(split_and_merge, "key long, ids array<int>")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = fresh_path(spark, "vocabulary")
    make_folder(folder)

    def with_shard(batches):
        for batch in batches:
            keys = np.asarray(batch.column(0), np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards).astype(np.int64)), batch.column(0), batch.column(1)], ["shard", "key", "ids"])

    def write(part: pa.Table) -> pa.Table:
        keys = np.asarray(part.column("key").combine_chunks(), np.int64).view(np.uint64)
        keys, order = np.unique(keys, return_index=True)
        lists = part.column("ids").combine_chunks()
        offsets = np.asarray(lists.offsets, np.int64)
        flat = np.asarray(lists.values, np.int32)
        lengths = np.diff(offsets)[order]
        ids = gather(flat, offsets[:-1][order], lengths).astype(np.uint32)
        file = write_arrays(folder, keys, np.cumsum(lengths).astype(np.uint64))
        return pa.table({"shard": [part.column("shard")[0].as_py()], "file": [file], "n": [len(keys)], "id_file": [write_arrays(folder, ids)], "n_ids": [len(ids)]})

    index = folded.unionAll(long).unionAll(newer).mapInArrow(with_shard, "shard long, key long, ids array<int>").groupBy("shard").applyInArrow(write, "shard long, file string, n long, id_file string, n_ids long")
    rows = settle(index, "vocabulary-index").collect()  # a row for each shard
    return Vocabulary(HashStore({r.shard: (r.file, r.n) for r in rows}, shards, ["u8"]), {r.shard: (r.id_file, r.n_ids) for r in rows}, ranks, pattern, hashes)


class Decoder:
    """Binary pieces by id."""

    def __init__(self, ranks: dict[bytes, int]):
        names: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            names[rank] = token
        self.every = np.frombuffer(b"".join(names), np.uint8)
        self.lengths = np.array([len(x) for x in names])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.every, self.starts[ids], self.lengths[ids])

    def join(self, ids: np.ndarray) -> bytes:
        return self.bytes_of(ids).tobytes()


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, decoded): each whole text's ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
    shared, hashes = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.hashes

    def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        size = values.dtype.itemsize
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((size * ends).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())])
        return column.cast(pa.binary())

    def run(batches):
        vocabulary = shared.value
        vocabulary.hashes = hashes
        for batch in batches:
            for part in steps(batch):
                ids, ends, decoded = vocabulary.encode(part)
                lengths = np.concatenate([[0], np.cumsum(vocabulary.decoder.lengths[ids])])
                yield pa.RecordBatch.from_arrays([part.column(0), binary(ids.astype("<u4"), ends), binary(decoded, lengths[ends])], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, decoded): the binary pieces of encoded(doc_id, ids), one after another."""
    shared = encoded.sparkSession.sparkContext.broadcast(Decoder(ranks))

    def run(batches):
        for batch in batches:
            out = [shared.value.join(np.frombuffer(x.as_py(), "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op3(spark, sf_dir: str) -> DataFrame:
    """Null texts are empty: no ids. Repeated rows keep a row each; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    back = encode(docs, make_vocabulary(docs, ranks))
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
