"""Ranked lexical search: sort-based accumulation of integer term impacts.

One pass over the documents keeps, of each, its length and the query terms in it (numbers and
counts, packed). Document frequencies are summed from these rows. Scoring works on runs of
documents: each matched (term, document, impact) is repeated for the items that ask for the term, the
pairs are sorted by a radix sort of the item's 16-bit number (they are made in order of the document), and
equal (item, document) keys are summed with reduceat. Each task keeps a heap of the best documents of an item;
the heaps of all tasks are merged by two windows, the first salted, so no task sees all lists of an item.

Items are taken in blocks of at most MAX_ITEMS items and, unless one item alone has more, MAX_PAIRS terms; only a
block's terms, their weights and the items of each term are broadcast, so no broadcast grows with either table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, drop_materialised, lookup, map_texts, materialise, xxh64

#: Items and (item, term) pairs of a block.
MAX_ITEMS = 1 << 14
MAX_PAIRS = 1 << 20
#: Pairs of item and matched term that a task sorts at a time.
SORT_PAIRS = 1 << 21
#: Lists of an item that a task of the first merge sees, as a share of all: one of so many.
SALTS = 64

#: True for the bytes of terms: ASCII letters and digits, and all bytes of other characters.
IN_TERM = np.zeros(256, bool)
IN_TERM[ord("0") : ord("9") + 1] = IN_TERM[ord("A") : ord("Z") + 1] = IN_TERM[ord("a") : ord("z") + 1] = IN_TERM[128:] = True


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, XXH64) of each term in order, A-Z lower-cased, and the number of terms before each text."""
    data = texts.data[: texts.size]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(texts.n + 1, np.int64)
    inside = IN_TERM[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = np.unique(texts.offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] |= inside[cuts]
    end[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    before = np.searchsorted(starts, texts.offsets)
    low = texts.data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    return np.repeat(np.arange(texts.n), np.diff(before)), xxh64(low, starts, ends - starts), before


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each segment of an int32 array, without copying."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, h): the distinct term hashes of each item id; rows that share an id are one item."""

    def run(rows, texts):
        row, h, _ = tokens(texts)
        return rows.column(0).take(pa.array(row)), h.view(np.int64)

    return map_texts(items.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).alias("text")), ["item"], "text", run, "item bigint, h bigint").distinct()


def blocks(terms: DataFrame, max_items: int, max_pairs: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(item ids, item number, hash) of runs of items in order of their id, null first; one block is on the driver at a time."""
    ids, numbers, hashes = [], [], []

    def block(n: int, to: int):
        return ids[:n], np.array(numbers[:to], np.int64), np.array(hashes[:to], np.int64).view(np.uint64)

    for item, h in terms.orderBy("item", "h").toLocalIterator():
        if not ids or item != ids[-1]:
            if ids and (len(ids) >= max_items or len(hashes) >= max_pairs):
                yield block(len(ids), len(hashes))
                ids, numbers, hashes = [], [], []
            ids.append(item)
        numbers.append(len(ids) - 1)
        hashes.append(h)
        if len(hashes) > max_pairs and len(ids) > 1:  # the last item opens a block of its own
            at = numbers.index(len(ids) - 1)
            yield block(len(ids) - 1, at)
            ids, hashes = ids[-1:], hashes[at:]
            numbers = [0] * len(hashes)
    if ids:
        yield block(len(ids), len(hashes))


def matches(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, tfs): each document's number of terms, and the sorted numbers and counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(rows, texts):
        row, h, before = tokens(texts)
        at, known = lookup(shared.value, h)
        keys, tf = np.unique(row[known] * len(shared.value) + at[known], return_counts=True)
        doc, term = keys // max(1, len(shared.value)), keys % max(1, len(shared.value))
        bounds = np.searchsorted(doc, np.arange(texts.n + 1))
        return rows.column(0), np.diff(before), packed(term, bounds), packed(tf, bounds)

    return map_texts(docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")), ["doc"], "text", run, "doc bigint, n bigint, terms binary, tfs binary")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int32 values of a binary column end to end, and the bounds of each row's."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(np.int32) if data is not None else np.zeros(0, np.int32)
    return values, (offsets - offsets[0]) // 4


def frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is; a task adds up what it reads."""

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(flat(batch.column(0))[0], minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in found.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).toLocalIterator():
        out[r[0]] = r[1]
    return out


def best_documents(found: DataFrame, weights: np.ndarray, fan: np.ndarray, asked: np.ndarray, items: int, n_docs: int, n_words: int, k: int, sort_pairs: int = SORT_PAIRS) -> DataFrame:
    """(item number, doc, score): the k best documents of each item among those of each task.

    asked: item numbers, term by term; fan: how many of them each term has.
    """
    shared = found.sparkSession.sparkContext.broadcast((weights, fan, np.cumsum(fan) - fan, asked.astype(np.uint16)))

    def run(batches):
        weights, fan, first, asked = shared.value
        heaps: list[list] = [[] for _ in range(items)]
        floor = np.ones(items, np.int64)  # scores below an item's k-th best so far, or of 0, can't be among its best
        for batch in batches:
            ids, total = batch.column(0), batch.column(1).to_numpy()
            number, absent = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            terms, bounds = flat(batch.column(2))
            tfs = flat(batch.column(3))[0].astype(np.int64)
            m = 50 + (50 * total * n_docs) // n_words if n_words else total
            doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
            impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
            pairs = np.concatenate(([0], np.cumsum(fan[terms])))[bounds]
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(pairs, pairs[at] + sort_pairs, "right")) - 1)
                lo, hi = bounds[at], bounds[to]
                n = fan[terms[lo:hi]]
                source = np.repeat(np.arange(lo, hi), n)
                item = asked[np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + first[terms[source]]]
                order = np.argsort(item, kind="stable")  # a radix sort, as items are 16-bit numbers
                source = source[order]
                key = (item[order].astype(np.int64) << 32) | doc[source]
                start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                sums = np.add.reduceat(impact[source], start) if len(start) else np.zeros(0, np.int64)
                own, local = key[start] >> 32, key[start] & 0xFFFFFFFF
                stay = sums >= floor[own]
                push(heaps, floor, own[stay], sums[stay], number[local[stay]], absent[local[stay]], k)
                at = to
        rows = [(i, score, -doc if known else None) for i, heap in enumerate(heaps) for score, known, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in ((0, pa.int32()), (2, pa.int64()), (1, pa.int64()))], ["item", "doc", "score"])

    return found.mapInArrow(run, "item int, doc bigint, score bigint")


def push(heaps: list[list], floor: np.ndarray, item: np.ndarray, score: np.ndarray, doc: np.ndarray, absent: np.ndarray, k: int) -> None:
    """Puts the k best new documents of each item (item ascends) on its heap of (score, id is not null, -id)."""
    order = np.lexsort((doc, absent, -score, item))
    place = np.arange(len(order)) - np.searchsorted(item, item)  # within the item, as the order keeps items together
    for i in order[place < k].tolist():
        heap, entry = heaps[item[i]], (int(score[i]), not absent[i], -int(doc[i]))
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == k:
            floor[item[i]] = heap[0][0]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_items: int = MAX_ITEMS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest positive scores, ties by doc_id.

    Term weight floor(1000 ln((2N + 2) / (2 df + 1))); all else is 64-bit integer arithmetic. Null and empty texts have no
    terms; rows that share an item id (null is an id) are one item with the terms of all; each row of docs is a document, also where an id
    repeats, and a null id comes last among ties. Items without a match and empty tables give no rows. Other columns,
    whatever their names, aren't read. Very long texts are read whole. Terms are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    terms = materialise(query_terms(items, item_col, item_text_col), "queryterms")
    out = None
    for ids, number, h in blocks(terms, max_items, max_pairs):
        vocabulary, asked = np.unique(h, return_inverse=True)
        found = materialise(matches(docs, vocabulary, id_col, text_col), "matches")
        n_docs, n_words = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = frequencies(found, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        order = np.lexsort((number, asked))
        lists = best_documents(found, weights, np.bincount(asked, minlength=len(vocabulary)), number[order], len(ids), n_docs, n_words, k)
        best = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        lists = lists.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
        some = lists.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("r") <= k)
        top = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item int, item_id bigint")
        top = materialise(top.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"), "ranked")
        drop_materialised(found)
        out = top if out is None else out.unionByName(top)
    drop_materialised(terms)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
