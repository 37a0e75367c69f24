"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted in Spark, memory-mapped by workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import crc_mod, fresh_path, lowered, mix, settle, span_keys, steps, table, texts_of, word_spans
from tessella.llm.files import make_folder
from tessella.llm.hashstore import FLUSH, HashStore, blobs, distinct_pairs, map_arrays, pack_counts, pack_sorted, shard_of, sum_by_key, unpack_counts, unpack_sorted, write_arrays

#: The halves of the key of the token that ends a text, and the number of the context that begins one.
END_KEY = np.uint64(0x5EED0E4D0FDEC0DE), np.uint64(0x0DDBA11C0FFEE123)
BEGIN = np.uint64(0xFFFFFFFF)
BLOB = "shard long, keys binary, counts binary"
WORDS = "shard long, keys binary, halves binary, counts binary"
MERGED = "kind string, shard long, n long, total long, of_counts array<long>, file string, keys binary, counts binary"
CONTEXTS = "shard long, file string, of_counts array<long>"
SCORE = "doc_id long, n_tokens long, n_known long, base_score double, score double"
STEP = 1 << 20
#: Bytes of text that a shard of the model stands for, if there are more than the session's shuffle partitions hold.
SHARD_BYTES = 256 << 20


def token_keys(batch: pa.RecordBatch, hashes=span_keys, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The halves of 128-bit keys of the tokens of a batch's texts, and where each text's begin (and the end)."""
    data, offsets = texts_of(batch.column(batch.schema.get_field_index(text)))
    data = lowered(data)
    starts, ends, owner = word_spans(data, offsets)
    n = len(offsets) - 1
    bounds = np.searchsorted(owner, np.arange(n + 1)) + np.arange(n + 1)
    low, high = (np.full(bounds[-1], k, np.uint64) for k in END_KEY)
    at = np.arange(len(owner)) + owner
    low[at], high[at] = hashes(data, starts, ends)
    return low, high, bounds


def discounts(of_counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4.

    Where a needed number is zero, the discount is three quarters.
    """
    n1, n2, n3, n4 = of_counts
    if not n1 or not n2:
        return [0.75, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(out, 1)]


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _ids(low: np.ndarray, high: np.ndarray, words: HashStore, bases: dict[int, int]) -> np.ndarray:
    low, high, back = distinct_pairs(low, high)
    ids = np.full(len(low), BEGIN, np.uint64)
    for at, k, place in words.find_pairs(low, high):
        ids[at] = bases[k] + place
    return ids[back]


def _pairs(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1]] = BEGIN
    return before << np.uint64(32) | ids


class Model:
    """The stores and the constants of a trained model."""

    def score(self, batch: pa.RecordBatch, hashes) -> pa.RecordBatch:
        *keys, bounds = token_keys(batch, hashes)
        found, second, back = distinct_pairs(*keys)
        n = len(found)
        ids, count, cont, ones, twos, more = np.full(n, BEGIN, np.uint64), *(np.zeros(n) for _ in range(5))
        for at, k, place in self.words.find_pairs(found, second):
            ids[at] = self.bases[k] + place
            count[at] = self.words.shard(k)[2][place]
            if k not in self.contexts_mapped:
                self.contexts_mapped[k] = map_arrays(self.contexts[k], [("u4", self.words.shards[k][1])] * 4)
            cont[at], ones[at], twos[at], more[at] = (a[place] for a in self.contexts_mapped[k])
        known = ids != BEGIN
        base = np.log10((count + 1) / (self.tokens + self.types + 1))
        low = np.zeros(n)
        if self.pairs_distinct:
            low = (np.maximum(cont - _discount(cont, self.low_discounts), 0) + self.low_rest / (self.types + 1)) / self.pairs_distinct
        else:
            low[:] = 1 / (self.types + 1)
        high = self.high_discounts
        rest = high[0] * ones + high[1] * twos + high[2] * more
        begin_rest = high[0] * self.begin[1] + high[1] * self.begin[2] + high[2] * self.begin[3]
        p_low, w = low[back], ids[back]
        context_count, context_rest, shift = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w), np.uint64)
        context_count[1:], context_rest[1:], shift[1:] = count[back][:-1], rest[back][:-1], w[:-1]
        first = bounds[:-1]
        context_count[first], context_rest[first], shift[first] = self.begin[0], begin_rest, BEGIN
        pair = shift << np.uint64(32) | w
        pair_found, pair_back = np.unique(pair, return_inverse=True)
        pair_count = np.zeros(len(pair_found))
        for at, k, place in self.pairs.find(pair_found):
            pair_count[at] = self.pairs.shard(k)[1][place]
        c = np.where(known[back], pair_count[pair_back], 0)
        seen = context_rest > 0
        divided = np.maximum(context_count, 1)
        p = np.where(seen, np.maximum(c - _discount(c, high), 0) / divided + context_rest / divided * p_low, p_low)
        each = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(bounds)), pa.array(each(known[back].astype(np.int64)).astype(np.int64)), pa.array(each(base[back])), pa.array(each(np.log10(p)))],
            [c.split()[0] for c in SCORE.split(", ")],
        )


def _discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(counts >= 3, d[2], np.where(counts == 2, d[1], np.where(counts == 1, d[0], 0.0)))


def _word_counts(shards: int, hashes):
    """Partial counts of words, packed by shard; a worker holds FLUSH tokens at most besides one text's."""

    def emit(held):
        low, high = (np.concatenate(x) for x in zip(*held))
        low, high, back = distinct_pairs(low, high)
        counts, shard = np.bincount(back, minlength=len(low)).astype(np.uint64), shard_of(low, shards)
        first = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(low)]):
            row = int(shard[a]), pack_sorted(low[a:b]), high[a:b].tobytes(), pack_counts(counts[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], [c.split()[0] for c in WORDS.split(", ")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in steps(batch, most=STEP):
                *keys, _ = token_keys(part, hashes)
                held.append(keys)
                size += len(keys[0])
                if size >= FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    return run


def _pair_counts(shards: int, shared, hashes):
    """Partial counts of pairs of word numbers, as _word_counts."""

    def emit(held):
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        yield from blobs(shard_of(mix(found), shards), found, counts.astype(np.uint64))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in steps(batch, most=STEP):
                *keys, bounds = token_keys(part, hashes)
                held.append(_pairs(_ids(*keys, *shared.value), bounds))
                size += len(held[-1])
                if size >= FLUSH:
                    yield from emit(held)
                    held, size = [], 0
        if size:
            yield from emit(held)

    return run


def _summed(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack_sorted(x.as_py()) for x in found.column("keys")]
    counts = [unpack_counts(x.as_py()) for x in found.column("counts")]
    return sum_by_key(np.concatenate(keys), np.concatenate(counts))


def train(docs: DataFrame, hashes=span_keys) -> Model:
    """A model of the texts of docs(text), each ended by an end token.

    Workers count over whole texts and pack partial counts by shards of the hash; a shard is merged, sorted and
    written as arrays to the shared folder. Words have keys of 128 bits (`hashes` gives them), of which the first 64
    may clash; ids of words are their places in all shards; a pair of ids is a key of 64 bits. There may be up to
    2^32 words. There are as many shards as the texts need for SHARD_BYTES of text each. The driver holds file names only.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    folder = fresh_path(spark, "ngrams")
    make_folder(folder)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = Model()

    def row(kind, shard, n=0, total=0, of_counts=(0, 0, 0, 0), file="", keys=b"", counts=b""):
        return kind, shard, n, total, list(of_counts), file, keys, counts

    def as_table(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.binary(), pa.binary())
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(MERGED.split(", "), zip(*rows), kinds)})

    def merge_words(found: pa.Table) -> pa.Table:
        low = np.concatenate([unpack_sorted(x.as_py()) for x in found.column("keys")])
        high = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in found.column("halves")])
        counts = np.concatenate([unpack_counts(x.as_py()) for x in found.column("counts")])
        low, high, back = distinct_pairs(low, high)
        summed = np.zeros(len(low), np.uint64)
        np.add.at(summed, back, counts)
        return as_table([row("file", found.column("shard")[0].as_py(), len(low), int(summed.sum()), file=write_arrays(folder, low, high, summed))])

    parts = texts.mapInArrow(_word_counts(shards, hashes), WORDS)
    merged = settle(parts.groupBy("shard").applyInArrow(merge_words, MERGED), "words").orderBy("shard").toLocalIterator()
    files, bases, base, tokens = {}, {}, 0, 0
    for r in merged:
        files[r.shard], bases[r.shard] = (r.file, r.n), base
        base, tokens = base + r.n, tokens + r.total
    model.words, model.bases, model.types, model.tokens = HashStore(files, shards, ["u8", "u8"]), bases, base, tokens
    of_shard = sorted(bases, key=bases.get)
    starts = np.array([bases[k] for k in of_shard], np.uint64)
    shared = spark.sparkContext.broadcast((model.words, bases))

    def merge_pairs(found: pa.Table) -> pa.Table:
        keys, counts = _summed(found)
        shard, rows = found.column("shard")[0].as_py(), []
        rows.append(row("file", shard, len(keys), int(counts.sum()), _of_counts(counts), write_arrays(folder, keys, counts)))
        context, word = keys >> np.uint64(32), keys & BEGIN
        one = np.ones(len(keys), np.uint64)
        for kind, ids, wanted in (("cont", word, one > 0), ("1", context, counts == 1), ("2", context, counts == 2), ("3", context, counts >= 3)):
            got, n = sum_by_key(ids[wanted], one[wanted])
            home = np.where(got == BEGIN, -1, np.searchsorted(starts, got, "right") - 1)
            first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else []
            for a, b in zip(first, [*first[1:], len(home)]):
                rows.append(row(kind, int(of_shard[home[a]]) if home[a] >= 0 else -1, keys=pack_sorted(got[a:b]), counts=pack_counts(n[a:b])))
        return as_table(rows)

    merged = settle(texts.mapInArrow(_pair_counts(shards, shared, hashes), BLOB).groupBy("shard").applyInArrow(merge_pairs, MERGED), "pairs")
    files, of_counts, distinct = {}, np.zeros(4, np.int64), 0
    for r in merged.where("kind = 'file'").select("shard", "file", "n", "of_counts").toLocalIterator():
        files[r.shard] = (r.file, r.n)
        of_counts += r.of_counts
        distinct += r.n
    model.pairs, model.pairs_distinct, model.high_discounts = HashStore(files, shards, ["u8"], mixed=True), distinct, discounts(of_counts.tolist())
    sizes = {k: n for k, (_, n) in model.words.shards.items()}

    def merge_contexts(found: pa.Table) -> pa.Table:
        shard = found.column("shard")[0].as_py()
        base, n = (int(BEGIN), 1) if shard < 0 else (bases[shard], sizes[shard])
        arrays = {k: np.zeros(n, np.uint32) for k in ("cont", "1", "2", "3")}
        for kind, keys, counts in zip(*(found.column(c) for c in ("kind", "keys", "counts"))):
            at = (unpack_sorted(keys.as_py()) - np.uint64(base)).astype(np.int64)
            arrays[kind.as_py()][at] += unpack_counts(counts.as_py()).astype(np.uint32)
        if shard < 0:
            return pa.table({"shard": [-1], "file": [""], "of_counts": [[int(arrays[k][0]) for k in ("1", "2", "3")]]})
        told = [*_of_counts(arrays["cont"]), int((arrays["cont"] >= 3).sum())]
        return pa.table({"shard": [shard], "file": [write_arrays(folder, *arrays.values())], "of_counts": [told]})

    contexts = settle(merged.where("kind <> 'file'").select("kind", "shard", "keys", "counts").groupBy("shard").applyInArrow(merge_contexts, CONTEXTS), "contexts")
    model.contexts, model.contexts_mapped, model.begin, told = {}, {}, [docs.count(), 0, 0, 0], np.zeros(5, np.int64)
    for r in contexts.toLocalIterator():
        if r.shard < 0:
            model.begin[1:] = r.of_counts
        else:
            model.contexts[r.shard] = r.file
            told += r.of_counts
    model.low_discounts = discounts(told[:4].tolist())
    model.low_rest = float(np.dot(model.low_discounts, [told[0], told[1], told[4]]))
    return model


def score_texts(docs: DataFrame, model: Model, hashes=span_keys) -> DataFrame:
    """SCORE rows of docs(doc_id, text): tokens, those learnt, and log10 probabilities by add-one and by the model.

    A null or empty text has its end token only. Repeated rows keep a row each, other columns are ignored, an
    empty table gives an empty result. A model of no text gives each token 1 / (types + 1).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in steps(batch, most=STEP):
                yield shared.value.score(part, hashes)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORE)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = crc_mod(F.col("doc_id"), 7) == 2
    model = train(docs.where(~out))
    return score_texts(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
