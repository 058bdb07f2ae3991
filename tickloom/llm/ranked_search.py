"""Ranked lexical search by sort-based accumulation.

Items are the stated queries: a block of them, its terms by hash and each term's list of items, is what every task holds.
One pass over the texts leaves of each document its length and, for terms of the block, how often it has them; sums over
these are the statistics. A second pass, over that small table, turns them into impacts, concatenates (item, document, impact) arrays,
sorts packed keys by radix and sums runs of one key. Each task keeps the best of each item by a heap's rule; what tasks
keep is dealt out by ranges of (item, document), selected again, and then ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import whole, written
from tickloom.llm.wordhash import blocks, hashed

#: Pairs of an item and a term that are broadcast at once; more are searched block after block.
PAIRS = 1 << 20
#: (item, document, impact) entries sorted at once; at least those of one document.
ENTRIES = 1 << 21
#: Bytes of a term are digits, letters (A-Z like a-z) and everything beyond ASCII; others become blanks.
_TERMS = np.full(256, 0x20, np.uint8)
for _from, _to in (("0", "9"), ("A", "Z"), ("a", "z"), ("\x80", "\xff")):
    _TERMS[ord(_from) : ord(_to) + 1] = np.arange(ord(_from), ord(_to) + 1)


def term_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each term from there, hash of each term) of blocks of whole texts, in order.

    A text longer than a block comes in several.
    """
    for row, _, data, starts in blocks(column):
        h, first = hashed(_TERMS[data], starts)
        yield row, np.searchsorted(starts, first, "right") - 1, h


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and term: the distinct term hashes of each item with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for row, of, h in term_hashes(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + of]), pa.array(h.view(np.int64))], ["item_id", "term"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(run, "item_id long, term long").distinct()


def _matched(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n and, aligned, terms (places in the vocabulary) and tfs of every document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, of, h in term_hashes(b.column(1)):
                np.add.at(n, row + of, 1)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                key, count = np.unique((row + of[hit]) * len(known) + at[hit], return_counts=True)
                keys.append(key)
                counts.append(count)
            # A long text's blocks may have a key each.
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.zeros(len(key), np.int64)
            np.add.at(tf, inverse, np.concatenate(counts))
            there = np.flatnonzero(n)
            owner = key // max(len(known), 1)
            offsets = np.append(np.searchsorted(owner, there), len(key)).astype(np.int32)
            terms = (key % max(len(known), 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(there)), pa.array(n[there]), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tf)],
                ["doc_id", "n", "terms", "tfs"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts keys (64-bit, not negative), by stable passes over 16 bits each, lowest first."""
    order = np.arange(len(keys))
    top = int(keys.max()) if len(keys) else 0
    shift = 0
    while shift == 0 or top >> shift:
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # of 16-bit numbers, numpy's stable sort is a radix sort
        shift += 16
    return order


class Best:
    """The k best documents of each item: score, then id, null ids last."""

    def __init__(self, k: int, items: int) -> None:
        self.k = k
        self.floor = np.zeros(items, np.int64)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        """Rows below an item's k-th score so far are out at once."""
        live = (score > 0) & (score >= self.floor[item])
        self.rows.append((item[live], score[live], null[live], doc[live]))
        self.held += int(live.sum())
        if self.held > 4 * self.k * len(self.floor) + 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        item, score, null, doc = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        begins = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(begins, np.diff(np.append(begins, len(item))))
        order, item, place = order[place < self.k], item[place < self.k], place[place < self.k]
        self.floor[item[place == self.k - 1]] = score[order][place == self.k - 1]
        self.rows = [(item, score[order], null[order], doc[order])]
        self.held = len(item)
        return self.rows[0]


def accumulate(n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, of_term: tuple[np.ndarray, np.ndarray], corpus: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, document, score) of all pairs with a common term; documents are places in n, offsets those of their terms.

    of_term: where each term's items begin, and the items. corpus: documents and terms in all.
    """
    docs_in_all, terms_in_all = corpus
    begin, items = of_term
    m = 50 + (50 * n * docs_in_all) // max(terms_in_all, 1)
    doc = np.repeat(np.arange(len(n)), np.diff(offsets))
    impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc]))
    wide = begin[terms + 1] - begin[terms]
    total = np.append(0, np.cumsum(wide))  # entries before each term
    at = 0
    while at < len(n):
        to = int(np.searchsorted(total[offsets], total[offsets[at]] + ENTRIES, "right")) - 1
        to = min(max(to, at + 1), len(n))
        here = slice(int(offsets[at]), int(offsets[to]))
        length = wide[here]
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        item = items[np.repeat(begin[terms[here]], length) + place]
        key = item.astype(np.int64) * (to - at) + np.repeat(doc[here] - at, length)
        order = radix_order(key)
        key = key[order]
        if len(key):
            runs = np.flatnonzero(np.diff(key, prepend=-1))
            yield key[runs] // (to - at), key[runs] % (to - at) + at, np.add.reduceat(np.repeat(impact[here], length)[order], runs)
        at = to


def _tops(batches: Iterator[pa.RecordBatch], k: int, item_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows (item place, doc_id, score) the k best of each item."""
    best = Best(k, len(item_ids))
    for b in batches:
        item, doc, score = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
        best.add(item, score, doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy())
    item, score, null, doc = best.cut()
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best-scoring documents of each item: item_id, rank (from 1), doc_id and score, all with a score above 0.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z like a-z; they are told apart by 64-bit hashes. A
    null text has no terms. Items without an id take no part, rows of one id are one item with the terms of all; each row
    of docs is a document of its own, with equal scores by ascending id and null ids last. No terms, no items or no
    documents give an empty result. Other columns are not read, so names may clash.
    """
    spark = docs.sparkSession
    pairs = written(_item_terms(items, item_col, item_text), "item-terms")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    block_count = max(1, -(-pairs.count() // PAIRS))
    found = None
    for block in range(block_count):
        # A bounded part of the stated queries, against all documents.
        some = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(block_count)) == block).orderBy("term", "item_id").toArrow()
        item_ids, item = np.unique(some.column("item_id").to_numpy(), return_inverse=True)
        terms = some.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms, kind="stable")
        known, begin = np.unique(terms[order], return_index=True)
        of_term = (np.append(begin, len(terms)), item[order])
        matched = written(_matched(rows, spark.sparkContext.broadcast(known)), "matched")
        corpus = matched.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).head()
        corpus = (corpus["docs"], corpus["terms"])
        # A count for each term of the block.
        df = np.zeros(len(known), np.int64)
        for x in matched.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[x["term"]] = x["count"]
        weights = np.floor(1000 * np.log((2 * corpus[0] + 2) / (2 * df + 1))).astype(np.int64)
        told = spark.sparkContext.broadcast((item_ids, weights, of_term))

        def score(batches: Iterator[pa.RecordBatch], told=told, corpus=corpus) -> Iterator[pa.RecordBatch]:
            item_ids, weights, of_term = told.value

            def rows() -> Iterator[pa.RecordBatch]:
                for b in batches:
                    lists, tfs = b.column(2), b.column(3)
                    offsets = lists.offsets.to_numpy().astype(np.int64)
                    terms, offsets = lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
                    first = tfs.offsets.to_numpy()
                    for item, at, total in accumulate(b.column(1).to_numpy(), offsets, terms, tfs.values.to_numpy()[first[0] : first[-1]], weights, of_term, corpus):
                        yield pa.RecordBatch.from_arrays([pa.array(item), b.column(0).take(pa.array(at)), pa.array(total)], ["item", "doc_id", "score"])

            yield from _tops(rows(), k, item_ids)

        def select(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            yield from _tops(batches, k, told.value[0])

        shape = "item long, doc_id long, score long"
        best = matched.mapInArrow(score, shape).repartitionByRange("item", "doc_id").mapInArrow(select, shape)
        names = spark.createDataFrame(pa.table({"item": np.arange(len(item_ids)), "item_id": item_ids}), "item long, item_id long")
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).join(F.broadcast(names), "item")
        best = written(best.select("item_id", "rank", "doc_id", "score"), "ranked")
        found = best if found is None else found.unionByName(best)
    return found
