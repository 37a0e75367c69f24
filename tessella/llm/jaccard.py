"""Similarity join of word-shingle sets: fixed-size subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import lowered, mix, settle, small_batches, span_keys, steps, table, texts_of, word_spans
from tessella.llm.components import connected_components

#: Shingles counted in SEEN texts come last in the order, by their counts; the order holds at most MOST of them. CHUNK are counted at once.
SEEN, MOST, CHUNK = 8, 200_000, 4 << 20
#: Bytes of text whose shingles are made at once: their arrays take some 50 times as much.
STEP_TEXT = 512 << 10
#: What writing a row of an index costs in comparisons of two rows, for the boundary between small and large sets.
ROW_COST = 40
#: Of this many tokens one is counted for that cost.
TOKENS_SEEN = 64
#: Rows of one key that a task compares with each other; more are dealt to pairs of blocks.
BLOCK_ROWS = 2048
#: Pairs of a key with more rows are made only if their sketches, folded to at most BRIEF words of 64 bits, are close enough; STEP_BRIEF at once.
LONG_KEY, BRIEF, STEP_BRIEF = 32, 16, 1 << 14
#: Turns that link each row with TRIES members of its keys, before all pairs of a key are made: at most TURNS, and none after a
#: turn whose new links are at most one in FEW_LINKS of those before.
TURNS, TRIES, FEW_LINKS = 4, 4, 20
#: Pairs that are made at once.
STEP_PAIRS = 1 << 18
#: Rows that a broadcast may hold.
BROADCAST_ROWS = 500_000
_STEP, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)


def shingles(column: pa.Array, words: int, empty: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, other half of the key) of all shingles, repeats too, with keys of 128 bits.

    A text of fewer words is one shingle; one without words has none, or one with `empty`.
    """
    data, offsets = texts_of(column)
    data = lowered(data)
    starts, ends, owner = word_spans(data, offsets)
    halves, n = span_keys(data, starts, ends), len(offsets) - 1
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    at = np.flatnonzero(np.arange(len(owner)) - first[owner] + words <= count[owner])
    short = np.flatnonzero((count < words) & ((count > 0) | empty))
    out = []
    for a, b in (halves, halves[::-1]):
        long, whole = np.zeros(len(at), np.uint64), np.zeros(len(short), np.uint64)
        for k in range(words):
            long = mix(long + a[at + k] + _STEP) ^ b[at + k]
        for k in range(words - 1):
            more = np.flatnonzero(count[short] > k)
            place = first[short[more]] + k
            whole[more] = mix(whole[more] + a[place] + _STEP) ^ b[place]
        out.append(np.concatenate([mix(long), mix(whole + count[short].astype(np.uint64))]))
    return np.concatenate([owner[at], short]), *out


def ordered(column: pa.Array, words: int, common: np.ndarray, counts: np.ndarray, empty: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, the rarest first: text numbers and both halves of the keys."""
    owner, value, other = shingles(column, words, empty)
    rank = np.zeros(len(value), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, value), len(common) - 1)
        rank = np.where(common[at] == value, counts[at], 0)
    by = np.lexsort((other, value, rank, owner))
    owner, value, other = owner[by], value[by], other[by]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]) | (other[1:] != other[:-1])
    return owner[new], value[new], other[new]


def least_overlap(n, parts: tuple[int, int]):
    """ceil(n * parts[0] / parts[1]) in integers."""
    return -(-n * parts[0] // parts[1])


def _lists(owner: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)


def _repeated(value: np.ndarray) -> pa.RecordBatch:
    """(h, n): the values that occur twice or more, with their counts; sorts value in place, and takes little room besides."""
    value.sort()
    same = np.zeros(len(value) + 1, np.int8)
    same[1:-1] = value[1:] == value[:-1]
    turn = np.diff(same)
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return pa.RecordBatch.from_arrays([pa.array(value[first].view(np.int64)), pa.array(last - first + 1)], ["h", "n"])


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many texts, sorted, and their counts. Any order is exact; this one keeps groups small.

    All texts count. A task counts CHUNK shingles at a time and passes on those that two of its texts hold, so that what
    is shuffled are shingles of many texts, not all; a shingle of few texts may be missed, which costs its short list only.
    """

    def run(batches):
        held, size = np.empty(CHUNK, np.uint64), 0
        for batch in batches:
            for part in steps(batch, most=STEP_TEXT):
                _, value, _ = ordered(part.column(0), words, np.zeros(0, np.uint64), np.zeros(0, np.int64))
                if size + len(value) > CHUNK:
                    yield _repeated(held[:size])
                    size = 0
                if len(value) > CHUNK:
                    yield _repeated(value)
                else:
                    held[size : size + len(value)] = value
                    size += len(value)
        if size:
            yield _repeated(held[:size])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    rows = found.orderBy(F.desc("n"), "h").limit(MOST).toArrow()
    value = np.asarray(rows.column("h").combine_chunks(), np.int64).view(np.uint64)
    by = np.argsort(value)
    return value[by], np.asarray(rows.column("n").combine_chunks(), np.int64)[by]


def sketches(owner: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    """For each of n sets, a power of two of bits, twice its size at least: whether an odd number of its values falls on each."""
    size = np.bincount(owner, minlength=n)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    spot = at[owner] + (value & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(spot, minlength=at[-1]) & 1).astype(bool)
    words = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array((at // 64).astype(np.int32)), pa.array(words))


def differing(x: Column, y: Column) -> Column:
    """In how many bits two sketches differ; one of twice the bits is folded to the other's first."""
    xor = lambda a, b: a.bitwiseXOR(b)
    fold = lambda v, n: F.when(F.size(v) > n, F.zip_with(F.slice(v, 1, n), F.slice(v, n + 1, n), xor)).otherwise(v)
    both = F.zip_with(fold(x, F.size(y)), fold(y, F.size(x)), lambda a, b: F.bit_count(xor(a, b)))
    return F.aggregate(both, F.lit(0), lambda s, k: s + k)


def briefs(sketch: Column) -> list[Column]:
    """A sketch folded to at most BRIEF words: how many it has, then the words, padded with zeros."""
    rest = F.sequence(F.lit(1), F.greatest(F.size(sketch) / BRIEF, F.lit(1)).cast("int"))
    words = F.least(F.size(sketch), F.lit(BRIEF))
    word = lambda k: F.aggregate(rest, F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.coalesce(F.get(sketch, (i - 1) * BRIEF + k), F.lit(0).cast("long"))))
    return [words.cast("long").alias("words"), *[word(k).alias(f"w{k}") for k in range(BRIEF)]]


def _boundary(fronts: DataFrame) -> int:
    """The largest size of a small set: where subsets of all smaller sets and lists of all larger ones cost least together.

    A set costs an index row for each pair of its front's shingles if small; if large, a row for each shingle of its front
    and a comparison with each row of their lists, whose lengths are counted on one of TOKENS_SEEN shingles.
    """
    level = F.floor(F.log2("n") * 2).cast("int")
    p = F.size("front")
    sizes = fronts.groupBy(level.alias("level")).agg(F.sum((p * (p - 1) / 2).cast("long")).alias("subsets"), F.sum(p - 1).alias("tokens"), F.max("n").alias("most"))
    one = F.explode(F.slice("front", 1, F.greatest(p - 1, F.lit(1))))
    seen = fronts.select(level.alias("level"), one.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(TOKENS_SEEN)) == 0)
    own = seen.groupBy("t", "level").count()
    lists = own.groupBy("t").agg(F.sum("count").alias("all"))
    scans = own.join(lists, "t").groupBy("level").agg(F.sum(F.col("count") * F.col("all")).alias("scans"))
    rows = sorted((r.asDict() for r in sizes.join(scans, "level", "left").collect()), key=lambda r: r["level"])
    small = np.array([ROW_COST * r["subsets"] for r in rows], float)
    large = np.array([ROW_COST * r["tokens"] + TOKENS_SEEN * (r["scans"] or 0) for r in rows], float)
    costs = [small[:k].sum() + large[k:].sum() for k in range(len(rows) + 1)]
    best = int(np.argmin(costs))
    return rows[best - 1]["most"] if best else 0


def _keys(small: int, share: tuple[int, int]):
    """(key, row, n, left) for batches of (row, n, front): even keys for the subsets of small sets, odd ones for the lists.

    left is how many of the set's shingles don't come before the key's first. Lists hold the large sets, and those small ones
    whose size a large one may have a partner of.
    """
    least = least_overlap(small + 1, share)

    def emit(key, row, n, left, odd):
        for at in range(0, len(key), STEP_PAIRS):
            k = key[at : at + STEP_PAIRS]
            yield pa.RecordBatch.from_arrays([pa.array(((k | _ODD) if odd else (k & ~_ODD)).view(np.int64)), *(pa.array(x[at : at + STEP_PAIRS]) for x in (row, n, left))], ["key", "row", "n", "left"])

    def run(batches):
        for batch in batches:
            row, n = (np.asarray(batch.column(k), np.int64) for k in (0, 1))
            at = np.asarray(batch.column(2).offsets, np.int64)
            value = np.asarray(batch.column(2).flatten(), np.int64).view(np.uint64)
            at, size = at - at[0], np.diff(at)
            for p in np.unique(size[n <= small]).tolist():
                i, j = np.triu_indices(p, 1)
                own = np.flatnonzero((n <= small) & (size == p))
                wide = max(1, 4 * STEP_PAIRS // max(1, len(i)))
                for a in range(0, len(own) if p > 1 else 0, wide):
                    some = own[a : a + wide]
                    grid = value[at[some][:, None] + np.arange(p)]
                    key = mix(grid[:, i] + mix(grid[:, j] + _STEP))
                    yield from emit(key.ravel(), np.repeat(row[some], len(i)), np.repeat(n[some], len(i)), (n[some][:, None] - i).ravel(), False)
            own = np.flatnonzero(n >= least)
            p = np.maximum(size[own] - 1, 1)
            pos = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
            who = np.repeat(own, p)
            yield from emit(mix(value[at[who] + pos] ^ _STEP), row[who], n[who], n[who] - pos, True)

    return run


def _groups(batches, names: int, make):
    """make(columns, bounds) for whole groups of equal first columns of sorted batches."""
    held = [np.zeros((names, 0), np.int64)]
    for batch in batches:
        new = np.stack([np.asarray(batch.column(k), np.int64) for k in range(names)])
        last = held[-1][0, -1:] if held[-1].shape[1] else new[0, :1]
        change = np.flatnonzero(new[0] != np.concatenate([last, new[0, :-1]]))
        if len(change):
            whole = np.concatenate([*held, new[:, : change[-1]]], axis=1)
            yield from make(whole, np.flatnonzero(np.diff(whole[0], prepend=whole[0, :1] - 1, append=whole[0, -1:] + 1))) if whole.shape[1] else ()
            held = [new[:, change[-1] :]]
        else:
            held.append(new)
    whole = np.concatenate(held, axis=1)
    if whole.shape[1]:
        yield from make(whole, np.flatnonzero(np.diff(whole[0], prepend=whole[0, :1] - 1, append=whole[0, -1:] + 1)))


_MET = "key long, row long, n long, left long"
_HELD = f"{_MET}, root long"


def _several(names: int, of: int):
    """The rows of keys whose column `of` has two values or more."""

    def make(rows, bounds):
        low, high = np.minimum.reduceat(rows[of], bounds[:-1]), np.maximum.reduceat(rows[of], bounds[:-1])
        keep = np.repeat(low != high, np.diff(bounds))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], ["key", "row", "n", "left", "root"][:names])

    return lambda batches: _groups(batches, names, make)


class _Pairs:
    """(a, b) of rows under one key that may have the similarity, as far as sizes and places tell."""

    def __init__(self, share: tuple[int, int], small: int):
        self.share, self.small = share, small

    def may(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        part, whole = self.share
        n, left = rows[2], rows[3]
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        odd = (rows[0][i] & 1) == 1
        return (low * whole >= high * part) & (np.minimum(left[i], left[j]) >= least_overlap(n[i] + n[j], (part, part + whole))) & (~odd | (high > self.small))

    def near(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the brief sketches of pairs that sizes allow, so that one has at most twice the words, differ in few enough bits."""
        part, whole = self.share[0], sum(self.share)
        words, most = rows[6], int(rows[6].max())
        full = np.ascontiguousarray(rows[7 : 7 + most].T).view(np.uint64)
        at = np.arange(most) + np.maximum(words // 2, 1)[:, None]
        upper = np.where(at < words[:, None], np.take_along_axis(full, np.minimum(at, most - 1), 1), np.uint64(0))
        half = np.where(np.arange(most) < words[:, None] // 2, full ^ upper, np.uint64(0))
        ok = np.zeros(len(i), bool)
        for k in range(0, len(i), STEP_BRIEF):
            a, b = i[k : k + STEP_BRIEF], j[k : k + STEP_BRIEF]
            wa, wb = words[a][:, None], words[b][:, None]
            apart = np.bitwise_count(np.where(wa > wb, half[a], full[a]) ^ np.where(wb > wa, half[b], full[b])).sum(1, dtype=np.int64)
            ok[k : k + STEP_BRIEF] = apart * whole <= (rows[2][a] + rows[2][b]) * (whole - 2 * part)
        return ok

    def emit(self, rows, i, j):
        ok = (rows[1][i] != rows[1][j]) & self.may(rows, i, j)
        if len(rows) > 4:
            ok &= rows[4][i] != rows[4][j]
        if len(rows) > 6:
            at = np.flatnonzero(ok)
            ok[at] = self.near(rows, i[at], j[at])
        if ok.any():
            a, b = rows[1][i[ok]], rows[1][j[ok]]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def stars(self, batches):
        """A row with the one before it, and with its key's first. Keys cut by batches lose a start, no more."""
        for batch in batches:
            if batch.num_rows:
                rows = np.stack([np.asarray(batch.column(k), np.int64) for k in range(4)])
                at = np.arange(rows.shape[1])
                new = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])
                first = np.maximum.accumulate(np.where(new, at, 0))
                inner = np.flatnonzero(~new)
                yield from self.emit(rows, np.concatenate([inner - 1, first[inner]]), np.concatenate([inner, inner]))

    def some(self, batches):
        """Each row with TRIES members of its key's largest component."""

        def make(rows, bounds):
            size, at = np.diff(bounds), np.arange(rows.shape[1])
            group = np.repeat(np.arange(len(size)), size)
            by = np.lexsort((rows[4], group))
            run = np.flatnonzero(np.concatenate([[True], (np.diff(rows[4][by]) != 0) | (np.diff(group[by]) != 0)]))
            long = np.diff(run, append=len(at))
            best = np.lexsort((-long, group[by][run]))
            best = best[np.flatnonzero(np.diff(group[by][run][best], prepend=-1))]
            start, wide = run[best][group], long[best][group]
            turn = (mix(rows[1].view(np.uint64)) >> _ODD).astype(np.int64)
            for k in range(TRIES):
                yield from self.emit(rows, by[start + (turn + k) % wide], at)

        return _groups(batches, 5, make)

    def all(self, batches, names: int = 6):
        """All pairs of each key; rows of different blocks, where the sixth column isn't negative, only across."""

        def make(rows, bounds):
            i, j, made = [], [], 0
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                wide = max(1, STEP_PAIRS // (end - begin))
                for at in range(begin, end - 1, wide):
                    own = np.arange(at, min(at + wide, end))
                    x, y = np.repeat(own, end - at), np.tile(np.arange(at, end), len(own))
                    keep = x < y
                    keep &= (rows[5][x] != rows[5][y]) | (rows[5][x] < 0)
                    i.append(x[keep])
                    j.append(y[keep])
                    made += len(i[-1])
                    if made >= STEP_PAIRS:
                        yield from self.emit(rows[: names - (names == 6)], np.concatenate(i), np.concatenate(j))
                        i, j, made = [], [], 0
            if made:
                yield from self.emit(rows[: names - (names == 6)], np.concatenate(i), np.concatenate(j))

        return _groups(batches, names, make)

    def close(self, batches):
        """As all, of rows with brief sketches: only pairs that are close by them."""
        return self.all(batches, 7 + BRIEF)


def _all_pairs(held: DataFrame, each: DataFrame, pairs: _Pairs, parts: int) -> DataFrame:
    """(a, b) of held(key, row, n, left, root) that pairs can't rule out; a key of at most LONG_KEY rows makes LONG_KEY / 2 for each of them at most."""
    long = settle(held.groupBy("key").count().where(F.col("count") > min(LONG_KEY, BLOCK_ROWS)), "long-keys")
    few = F.broadcast(long) if long.count() <= BROADCAST_ROWS else long
    short = held.join(few, "key", "left_anti").withColumn("side", F.lit(-1).cast("long"))
    made = short.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(pairs.all, "a long, b long")
    rows = settle(held.join(few, "key"), "long-rows")
    own = each.join(rows.select("row").distinct(), "row", "left_semi").select("row", *briefs(F.col("sketch")))
    return made.unionAll(_in_blocks(rows.join(settle(own, "briefs"), "row"), parts).mapInArrow(pairs.close, "a long, b long"))


def _in_blocks(wide: DataFrame, parts: int) -> DataFrame:
    """wide(key, row, n, left, root, count, brief sketch) with whole keys sorted in partitions: keys of over BLOCK_ROWS rows become a key for each pair of their blocks."""
    wide = wide.withColumn("count", F.when(F.col("count") > BLOCK_ROWS, F.col("count")))
    blocks = F.ceil(F.col("count") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("row", F.lit(3)), F.greatest(blocks, F.lit(1))).cast("int")
    each = wide.withColumn("own", own).withColumn("to", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1))))
    alone = F.col("to") < 0
    low, high = F.least("own", "to"), F.greatest("own", "to")
    parity = F.col("key").bitwiseAND(F.lit(1))
    key = F.when(alone, F.col("key")).otherwise(F.xxhash64("key", low, high).bitwiseAND(F.lit(-2)).bitwiseOR(parity))
    side = F.when(alone | (F.col("own") == F.col("to")), F.lit(-1)).otherwise(F.col("own")).cast("long")
    dealt = each.select(key.alias("key"), "row", "n", "left", "root", side.alias("side"), "words", *[f"w{k}" for k in range(BRIEF)])
    return dealt.repartition(parts, "key").sortWithinPartitions("key")


def _closest(pairs: DataFrame, each: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b, apart): the pairs whose sketches don't differ too much. Sets differ in at least as many values as their sketches in bits."""
    part, whole = share[0], share[0] + share[1]
    side = lambda end: each.select(F.col("row").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"of_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    sizes = F.col("n_a") + F.col("n_b")
    apart = differing(F.col("of_a"), F.col("of_b"))
    return both.select("a", "b", apart.alias("apart"), sizes.alias("sizes")).where(F.col("apart") * whole <= F.col("sizes") * (whole - 2 * part)).select("a", "b", "apart")


def _verified(pairs: DataFrame, each: DataFrame, texts: DataFrame, words: int, share: tuple[int, int], empty: bool) -> DataFrame:
    """The pairs whose whole sets, made from both whole texts again with keys of 128 bits, have the similarity."""
    part, whole = share

    def compared(batches):
        for batch in batches:
            size = pa.compute.add(pa.compute.binary_length(batch.column(2)), pa.compute.binary_length(batch.column(3)))
            total = np.cumsum(np.asarray(size, np.int64))
            cuts = np.flatnonzero(np.diff(total // STEP_TEXT, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                some, m = batch.slice(a, b - a), b - a
                both = pa.concat_arrays([some.column(2).cast(pa.large_string()), some.column(3).cast(pa.large_string())])
                owner, value, other = ordered(both, words, np.zeros(0, np.uint64), np.zeros(0, np.int64), empty)
                n = np.bincount(owner, minlength=2 * m)
                by = np.lexsort((other, value, owner % m))
                o, v, w = (owner % m)[by], value[by], other[by]
                same = (o[1:] == o[:-1]) & (v[1:] == v[:-1]) & (w[1:] == w[:-1])
                shared = np.bincount(o[1:][same], minlength=m)
                yield some.select(["a", "b"]).filter(pa.array(shared * whole >= (n[:m] + n[m:] - shared) * part))

    pairs = settle(pairs.select("a", "b"), "close")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    needed = settle(each.join(ends, "row", "left_semi").select("row", "doc_id", "t1", "t2"), "ends")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    same = (texts.t1 == few.t1) & (texts.t2 == few.t2) & texts.doc_id.eqNullSafe(few.doc_id)
    found = settle(texts.join(few, same).groupBy("row").agg(F.first("text").alias("text")), "texts")
    side = lambda end: found.select(F.col("row").alias(end), F.col("text").alias(f"text_{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(compared, "a long, b long")


def jaccard_groups(docs: DataFrame, words: int = 4, share: tuple[int, int] = (85, 100), carry: str | None = None, known: DataFrame | None = None, empty: bool = False, small: int | None = None) -> DataFrame:
    """(doc_id, key, n_shingles, root, component_id) for each row of docs(doc_id, text, carry).

    Two texts link if their sets of shingles have a Jaccard similarity of share[0] / share[1] (over a half) or more; words are
    runs without white space, A-Z as a-z; a text of fewer words is one shingle. root is equal for rows that links connect,
    component_id is their smallest doc_id. key is the column `carry`. known(a, b) gives pairs of its values that are
    compared first.

    Nulls: a null text is empty; a null doc_id is larger than any other, and a component of null ids has a null id. A text without
    words has an empty set, linked with nothing (with `empty`: one shingle, so such texts are linked). Rows of equal
    sets are one set of the join. Repeated rows each keep a row; other columns are ignored; an empty table gives an empty result.

    All pairs that may link meet: in one order of all shingles, rare ones first, the first n - ceil(share * n) + 2 of two such sets
    share two. A small set is indexed by all pairs of its front; large sets, and those of sizes that may link with one, by lists
    of the shingles of a front that is one shorter. The boundary is the size with the least cost, or `small`. Rows of one key are linked with
    few others first, in turns; then all pairs of a key that are in different components are compared by sizes and places, by
    sketches, and by whole sets. Pairs of a key with many rows are made only if brief sketches are close; keys of very many rows are dealt
    to pairs of blocks. If more pairs than there are links are left, each row's nearest and its hub are linked before the others.
    """
    if not 2 * share[0] > share[1] >= share[0] > 0:
        raise ValueError("the similarity must be over a half and at most 1")
    with small_batches(docs.sparkSession):
        return _groups_of(docs, words, share, carry, known, empty, small)


def _groups_of(docs: DataFrame, words: int, share: tuple[int, int], carry: str | None, known: DataFrame | None, empty: bool, small: int | None) -> DataFrame:
    """jaccard_groups; all that runs Python is written before it returns."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(_common(docs, words))

    def prefixes(batches):
        for batch in batches:
            for part in steps(batch, most=STEP_TEXT):
                owner, value, other = ordered(part.column(5), words, *shared.value, empty)
                at = _lists(owner, part.num_rows)
                n = np.diff(at).astype(np.int64)
                pos = np.arange(len(owner)) - at[owner]
                front = pos <= (n - least_overlap(n, share))[owner] + 1
                sums = []
                for x in (value, other):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x + _STEP), dtype=np.uint64)])
                    sums.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(_lists(owner[front], part.num_rows)), pa.array(value[front].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(5)), pa.array(n), *sums, lists, sketches(owner, value, part.num_rows)], ["row", "doc_id", "key", "t1", "t2", "n", "s1", "s2", "front", "sketch"])

    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), (F.col(carry) if carry else F.lit(None)).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(5))})
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "t1", "t2", "text")
    each = settle(numbered.mapInArrow(prefixes, "row long, doc_id long, key string, t1 long, t2 long, n long, s1 long, s2 long, front array<long>, sketch array<long>"), "fronts")
    texts = texts.select("doc_id", "t1", "t2", "text")
    sets = settle(each.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("row"), F.min("doc_id").alias("low"), F.count("*").alias("rows")), "sets")
    twice = settle(sets.where("rows > 1"), "twice")
    copies = each.select("row", "n", "s1", "s2").join(twice.withColumnRenamed("row", "v"), ["n", "s1", "s2"]).where("row <> v").select("row")
    copies = settle(copies, "copies")
    fronts = each.where("n > 1").select("row", "n", "front").join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "row", "left_anti")
    small = _boundary(fronts) if small is None else small
    made = fronts.mapInArrow(_keys(small, share), _MET)
    met = settle(made.repartition(parts, "key").sortWithinPartitions("key", "n", "row").mapInArrow(_several(4, 1), _MET), "met")
    pairs = _Pairs(share, small)

    def forest(close: DataFrame) -> DataFrame:
        """For each row two pairs: with its nearest row, and with that of its rows which has the most pairs."""
        ways = settle(close.select("a", "b", "apart").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart")), "ways")
        many = ways.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("many"))
        best = ways.join(many, "b").groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("near"), F.max_by("b", F.struct("many", "b")).alias("hub"))
        pairs = best.select("a", F.explode(F.array("near", "hub")).alias("b"))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    check = lambda p: settle(_verified(p, each, texts, words, share, empty), "links")
    start = settle(met.mapInArrow(pairs.stars, "a long, b long").distinct(), "pairs")
    links = check(forest(settle(_closest(start, each, share), "closest")))
    if known is not None:
        ends = each.join(sets.withColumnRenamed("row", "v"), ["n", "s1", "s2"]).select("key", "v")
        tried = known.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b")
        links = links.unionByName(check(_closest(settle(tried.distinct(), "known"), each, share)))
    whole = False
    for turn in range(TURNS + 2):
        roots = settle(connected_components(links), "roots")
        held = met.join(roots.withColumnRenamed("v", "row"), "row", "left").select("key", "row", "n", "left", F.coalesce("root", "row").alias("root"))
        held = settle(held.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_several(5, 4), _HELD), "held")
        met = held.select("key", "row", "n", "left")
        again, whole = whole, whole or turn == TURNS or turn > 0 and few
        made = _all_pairs(held, each, pairs, parts) if whole else held.mapInArrow(pairs.some, "a long, b long")
        close = settle(_closest(settle(made.distinct(), "pairs"), each, share), "closest")
        last = again or whole and close.count() <= links.count()
        new = check(close if last else forest(close))
        few = new.count() * FEW_LINKS <= links.count()
        links = links.unionByName(new)
        if last:
            roots = settle(connected_components(links), "roots")
            break
    own = sets.join(roots.withColumnRenamed("v", "row"), "row", "left").where("rows > 1 or root is not null").select("n", "s1", "s2", "low", F.coalesce("root", "row").alias("root"))
    least = own.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = settle(own.join(least, "root").select("n", "s1", "s2", "root", "component_id"), "classes")
    found = each.select("row", "doc_id", "key", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("root", "row").alias("root"), component.alias("component_id"))


def op12(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
