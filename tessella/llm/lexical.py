"""Ranked lexical search: a threshold-seeded join of items with the documents' term vectors, in exact integers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import lowered, settle, span_keys, steps, table, texts_of, word_spans

#: Documents that an item gets at most.
TOP = 50
#: Item terms (one for each item and term) that are searched for at once; more are searched for in several turns.
TURN_TERMS = 2_000_000
#: (item, document, term) places that one vectorised step holds.
STEP_PLACES = 4 << 20

#: Bytes of a term: digits, letters, and all of characters beyond ASCII.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, key, other half of the key) of each term of each text, in order, repeats too."""
    data, offsets = texts_of(column)
    data = lowered(data)
    starts, ends, owner = word_spans(data, offsets, _IN_TERM)
    return owner, *span_keys(data, starts, ends)


def _counted(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, term) in order, and how often each is there."""
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[first], term[first], np.diff(np.append(first, len(owner)))


def _lists(owner: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, a, b): a row for each distinct term of each row of items."""

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                owner, a, b = _terms(part.column(2))
                order = np.lexsort((b, a, owner))
                owner, a, b = owner[order], a[order], b[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                at = pa.array(owner[new])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64))], ["item", "item_id", "a", "b"])

    each = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
    return each.mapInArrow(run, "item long, item_id long, a long, b long")


def _vectors(docs: DataFrame, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """(row, doc_id, n, terms, tfs) of each document with a term: n counts all terms, the lists hold those of the sorted vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast((low, high))

    def run(batches):
        low, high = shared.value
        for batch in batches:
            for part in steps(batch):
                owner, a, b = _terms(part.column(2))
                n = np.bincount(owner, minlength=part.num_rows).astype(np.int64)
                if len(low):
                    at = np.searchsorted(low, a)
                    hit = np.flatnonzero(low[np.minimum(at, len(low) - 1)] == a)
                    owner, a, b, at = owner[hit], a[hit], b[hit], at[hit]
                    while True:  # a few keys may have one first half
                        wrong = np.flatnonzero(high[at] != b)
                        wrong = wrong[(at[wrong] + 1 < len(low)) & (low[np.minimum(at[wrong] + 1, len(low) - 1)] == a[wrong])]
                        if not len(wrong):
                            break
                        at[wrong] += 1
                    same = high[at] == b
                    owner, term, tf = _counted(owner[same], at[same])
                else:
                    owner, term, tf = (np.zeros(0, np.int64),) * 3
                lists = _lists(owner, part.num_rows)
                out = [part.column(0), part.column(1), pa.array(n), pa.ListArray.from_arrays(pa.array(lists), pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(pa.array(lists), pa.array(tf.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    each = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return settle(each.mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tfs array<long>"), "vectors")


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a term adds to a document's score, in 64-bit integers."""
    m = 50 + (50 * n * docs) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    known, back = np.unique(df, return_inverse=True)
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in known], np.int64)[back]


def _flat(batch: pa.RecordBatch, weight: np.ndarray, docs: int, length: int):
    """Document number, term and impact of all postings of a batch of vectors."""
    at = np.asarray(batch.column(3).offsets, np.int64)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
    term, tf = np.asarray(batch.column(3).flatten(), np.int64), np.asarray(batch.column(4).flatten(), np.int64)
    return owner, term, impacts(weight[term], tf, np.asarray(batch.column(2), np.int64)[owner], docs, length)


def _best(group: np.ndarray, score: np.ndarray, ties: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of the k highest scores of each group; ties by the smallest of ties."""
    order = np.lexsort((*ties[::-1], -score, group))
    g = group[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[place < k]


def _heads(vectors: DataFrame, weight, docs: int, length: int, k: int) -> DataFrame:
    """(term, row, impact): the k highest impacts of each term. A task sends k for each term at most, so a term of all documents is no hot key."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            owner, term, impact = _flat(batch, weight.value, docs, length)
            held = [np.concatenate(x) for x in zip(held, (term, impact, np.asarray(batch.column(0), np.int64)[owner]))]
            if len(held[0]) > STEP_PLACES:
                best = _best(held[0], held[1], (held[2],), k)
                held = [x[best] for x in held]
        best = _best(held[0], held[1], (held[2],), k)
        yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in held], ["term", "impact", "row"])

    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    return vectors.mapInArrow(run, "term long, impact long, row long").withColumn("place", place).where(F.col("place") <= k)


def _thresholds(pairs: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """(item, term, most, floor, suffix) of each item term that some document holds.

    most is the term's highest impact. floor is a lower bound of the item's kth score: the kth largest sum of the impacts
    that the terms' heads hold for a document, which is no less than any of its terms' kth impact; 0 if there are fewer
    documents. suffix sums `most` over this term and the item's terms with less: terms with suffix < floor can't
    alone bring a document among the k best.
    """
    met = pairs.join(heads, "term")
    some = met.groupBy("item", "row").agg(F.sum("impact").alias("s"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s")))
    kth = some.withColumn("place", place).where(F.col("place") == k).select("item", F.col("s").alias("floor"))
    most = met.where("place = 1").select("item", "term", F.col("impact").alias("most"))
    suffix = F.sum("most").over(Window.partitionBy("item").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    return most.where("most > 0").join(kth, "item", "left").select("item", "term", "most", F.coalesce("floor", F.lit(0)).alias("floor"), suffix.alias("suffix"))


class Plan:
    """The item terms of one turn: for each vocabulary term the items that have it, the essential ones first."""

    def __init__(self, item, term, floor, suffix, vocabulary: int):
        self.items = int(item.max()) + 1 if len(item) else 0
        self.floor, rest = np.zeros(self.items, np.int64), np.zeros(self.items, np.int64)
        self.floor[item] = floor
        pruned = suffix < floor
        np.maximum.at(rest, item[pruned], suffix[pruned])
        self.rest = rest
        self.starts, self.item = [], []
        for chosen in (~pruned, pruned):
            order = np.lexsort((item[chosen], term[chosen]))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(term[chosen], minlength=vocabulary))]))
            self.item.append(item[chosen][order])

    def expand(self, which: int, owner, term, impact):
        """(owner, item, impact) of all items that have the terms, in bounded steps of whole documents' postings."""
        starts = self.starts[which]
        wide = starts[term + 1] - starts[term]
        total = np.concatenate([[0], np.cumsum(wide)])
        at, cuts = 0, np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(cuts[1:], len(owner))
        while at < len(cuts):
            last = int(np.searchsorted(total[ends], total[cuts[at]] + STEP_PLACES, "right"))
            last = max(last, at + 1)
            a, b = cuts[at], ends[last - 1]
            w = wide[a:b]
            place = np.repeat(starts[term[a:b]] - (total[a:b] - total[a]), w) + np.arange(int(w.sum()))
            yield np.repeat(owner[a:b], w), self.item[which][place], np.repeat(impact[a:b], w)
            at = last


def _scored(batch: pa.RecordBatch, plan: Plan, weight: np.ndarray, docs: int, length: int):
    """(item, document number, score) of the candidates: those that their essential terms may bring to the floor, exactly scored."""
    owner, term, impact = _flat(batch, weight, docs, length)
    use = impact > 0
    owner, term, impact = owner[use], term[use], impact[use]
    at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    for own, item, part in plan.expand(0, owner, term, impact):
        if not len(own):
            continue
        first, last = int(own[0]), int(own[-1]) + 1
        wide = plan.items * (last - first)
        if wide <= 4 * STEP_PLACES:
            key = (own - first) * plan.items + item
            score = np.bincount(key, part.astype(np.float64), wide) if part.max() * len(part) < 1 << 52 else None
            if score is None:
                score = np.zeros(wide, np.int64)
                np.add.at(score, key, part)
            key = np.flatnonzero(score)
            score, own, item = score[key].astype(np.int64), key // plan.items + first, key % plan.items
        else:
            order = np.lexsort((item, own))
            own, item, part = own[order], item[order], part[order]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (item[1:] != item[:-1])]))
            score, own, item = np.add.reduceat(part, new), own[new], item[new]
        may = score + plan.rest[item] >= plan.floor[item]
        own, item, score = own[may], item[may], score[may]
        if not len(own):
            continue
        a, b = at[own[0]], at[own[-1] + 1]
        code = own * plan.items + item
        for own2, item2, part2 in plan.expand(1, owner[a:b], term[a:b], impact[a:b]):  # what the pruned terms add
            code2 = own2 * plan.items + item2
            place = np.minimum(np.searchsorted(code, code2), len(code) - 1)
            hit = code[place] == code2
            np.add.at(score, place[hit], part2[hit])
        ok = score >= np.maximum(plan.floor[item], 1)
        yield item[ok], own[ok], score[ok]


def _turn(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The results of one turn: pairs(item, item_id, a, b) are at most about TURN_TERMS."""
    spark = docs.sparkSession
    pairs = settle(pairs, "item-terms")
    keys = pairs.select("a", "b").distinct().toArrow()
    low, high = (np.asarray(keys.column(c).combine_chunks(), np.int64).view(np.uint64) for c in (0, 1))
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    vectors = _vectors(docs, low, high)
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    count, length = total["docs"], total["length"] or 0
    df = np.zeros(len(low), np.int64)
    seen = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df[np.asarray(seen.column(0).combine_chunks())] = np.asarray(seen.column(1).combine_chunks())
    weight = spark.sparkContext.broadcast(weights(df, count))
    vocabulary = spark.createDataFrame(pa.table({"a": low.view(np.int64), "b": high.view(np.int64), "term": np.arange(len(low))}))
    heads = settle(_heads(vectors, weight, count, length, k), "heads")
    own = pairs.join(vocabulary, ["a", "b"]).select("item", "term")
    found = _thresholds(own, heads, k).toArrow()
    item, term, _, floor, suffix = (np.asarray(found.column(c).combine_chunks(), np.int64) for c in range(5))
    names, place = np.unique(item, return_inverse=True)
    plan = spark.sparkContext.broadcast(Plan(place, term, floor, suffix, len(low)))

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        for batch in batches:
            ids = batch.column(1)
            lost = np.asarray(ids.is_null())
            ids, rows = np.asarray(ids.fill_null(0), np.int64), np.asarray(batch.column(0), np.int64)
            for item, own, score in _scored(batch, plan.value, weight.value, count, length):
                held = [np.concatenate(x) for x in zip(held, (item, score, ids[own], rows[own], lost[own]))]
                if len(held[0]) > STEP_PLACES // 8:
                    best = _best(held[0], held[1], (held[4], held[2], held[3]), k)
                    held = [x[best] for x in held]
        best = _best(held[0], held[1], (held[4], held[2], held[3]), k)
        item, score, ids, rows, lost = (x[best] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(names[item]), pa.array(score), pa.array(ids, mask=lost), pa.array(rows)], ["item", "score", "doc_id", "row"])

    best = vectors.mapInArrow(run, "item long, score long, doc_id long, row long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    best = settle(best.withColumn("rank", rank).where(F.col("rank") <= k), "best")
    return best.join(pairs.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, turn_terms: int = TURN_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) its k best documents of docs(doc_id, text).

    Terms are runs of digits, letters and characters beyond ASCII, A-Z as a-z, of whole texts. Equal scores go by
    doc_id, null ids last, then in the order read; documents with score 0 aren't found. A null text has no terms. Each row of
    items is ranked by itself, so a repeated item_id has its ranks repeatedly; documents repeat likewise. Other columns are
    ignored; without documents, items or terms the result is empty.

    The join is seeded with thresholds: the k best impacts of each term are stored; their sums bound each item's kth score from
    below. By the terms' highest impacts those terms are left out that can't reach the bound even together; the others
    generate the candidates, and only candidates that can still reach it get exact scores. Tasks keep k for each item.
    Items are dealt to as many turns as keep at most about turn_terms item terms in a broadcast.
    """
    pairs = settle(_item_terms(items), "item-terms")
    turns = -(-pairs.count() // turn_terms)
    out = None
    for turn in range(turns):
        found = _turn(docs, pairs.where(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn), k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (
    SELECT doc_id, rowid_, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
),
f AS (SELECT rowid_, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT rowid_, sum(tf)::BIGINT AS n FROM f GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, docs),
i AS (
    SELECT DISTINCT irow, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS irow FROM benchmark)
),
r AS (
    SELECT irow, item_id, doc_id, rowid_, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len))))::BIGINT AS score
    FROM i JOIN f USING (term) JOIN w USING (term) JOIN d USING (rowid_), s GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY irow ORDER BY score DESC, doc_id, rowid_))::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0
QUALIFY rank <= 50
"""
