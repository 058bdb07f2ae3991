"""Best-fit packing of tokenized documents into sequences, large items matched first.

A length is at most the capacity, so the corpus comes down to a histogram of that many numbers at most. The plan is made
on the histogram: pieces above a third of the capacity, of which a bin holds two at most, are matched greedily, each
with the largest partner that fits; smaller ones go, by falling length, where they leave the least room. A plan's row
places a run of equally long pieces into a run of bins; pieces find their row by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import whole, written
from tickloom.llm.wordhash import blocks, hashed

#: Words a worker remembers; the store starts anew when it is full.
MEMORY = 1_000_000
#: Words tokenized at once.
LEARNED = 2048
#: Parts of the pieces of one length, so that a common length is ranked by many tasks.
PARTS = 256


class _Ids:
    """The ids of words by the hash of their exact bytes, as special tokens are matched in their own case only.

    The tokenizer drops white space and joins nothing across it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_padding()
        self.encoder.no_truncation()
        self.restart()

    def restart(self) -> None:
        self.words = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes sorted, none of them known."""
        new = []
        for at in range(0, len(words), LEARNED):  # an encoding takes much more room than its ids
            new += [np.array(x.ids, np.uint32) for x in self.encoder.encode_batch_fast(words[at : at + LEARNED], add_special_tokens=False)]
        lengths = np.array([len(x) for x in new], np.int64)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, *new])
        at = np.searchsorted(self.words, hashes)
        self.words, self.starts, self.lengths = (np.insert(x, at, y) for x, y in ((self.words, hashes), (self.starts, starts), (self.lengths, lengths)))

    def of(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in data on end, and where each text's ids begin."""
        hashes, first = hashed(data, starts, exact=True)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        unique, place, back = np.unique(hashes, return_index=True, return_inverse=True)
        while True:
            at = np.searchsorted(self.words, unique)
            known = np.zeros(len(unique), bool)
            inside = at < len(self.words)
            known[inside] = self.words[at[inside]] == unique[inside]
            if known.all():
                break
            if len(self.words) > MEMORY:
                self.restart()
                known[:] = False
            new = np.flatnonzero(~known)
            # A word ends where the next blank or text begins.
            ends = np.append(first[1:], len(data))
            raw = data.tobytes()
            self.learn(unique[new], [raw[first[i] : ends[i]].decode() for i in place[new].tolist()])
        entry = np.searchsorted(self.words, unique)[back]
        lengths = self.lengths[entry]
        after = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[entry] - after + lengths, lengths) + np.arange(after[-1])]
        return ids, np.concatenate([[0], after])[np.searchsorted(first, starts)]


_known: dict[str, _Ids] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _known:
        _known[path] = _Ids(path)
    store, end = _known[path], np.zeros(1, np.uint32)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out: list[list[int | None]] = [[] for _ in names]
        doc_ids = batch.column(0).to_pylist()
        held: list[np.ndarray] = []
        last = -1

        def close(doc_id: int | None, parts: list[np.ndarray]) -> None:
            ids = np.concatenate([*parts, end])
            for k, i in enumerate(range(0, len(ids), capacity)):
                piece = ids[i : i + capacity]
                for column, value in zip(out, (doc_id, k, i, len(piece), zlib.crc32(piece.astype("<u4").tobytes())), strict=True):
                    column.append(value)

        for row, _, data, starts in blocks(batch.column(1)):
            ids, bounds = store.of(data, starts)
            for k, part in enumerate(np.split(ids, bounds[1:]), row):
                if k != last:
                    if last >= 0:
                        close(doc_ids[last], held)
                    held, last = [], k
                held.append(part)
        if last >= 0:
            close(doc_ids[last], held)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, offset), sorted: pieces from that rank on go one to a bin from that bin on.

    The work follows the number of different lengths, not the number of pieces.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    ranks, rows, bins = np.zeros(capacity + 1, dtype=np.int64), [], 0
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first bin, bins)
    room = np.zeros(capacity + 1, dtype=bool)

    def put(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, int(ranks[length]), first, offset))
        ranks[length] += n
        left[length] -= n

    def add(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            free[gap].append((first, n))
            room[gap] = True

    third = capacity // 3
    for length in range(capacity, third, -1):
        while n := int(left[length]):
            fits = np.flatnonzero(left[third + 1 : min(length, capacity - length) + 1])
            partners = [third + 1 + int(x) for x in fits[::-1][:2]]
            if partners and partners[0] == length and n == 1:
                partners.pop(0)
            if not partners:
                put(length, n, bins, 0)
                add(capacity - length, bins, n)
                bins += n
                continue
            other = partners[0]
            m = n // 2 if other == length else min(n, int(left[other]))
            put(length, m, bins, 0)
            put(other, m, bins, length)
            add(capacity - length - other, bins, m)
            bins += m
    for length in range(third, 0, -1):
        while n := int(left[length]):
            tight = np.flatnonzero(room[length:])
            if len(tight):
                gap = length + int(tight[0])
                first, m = free[gap].pop()
                room[gap] = bool(free[gap])
            else:
                gap, first, m = capacity, bins, max(1, -(-n // (capacity // length)))
                bins += m
            each = gap // length
            full = min(m, n // each)
            for k in range(each if full else 0):
                put(length, full, first, capacity - gap + k * length)
            add(gap - each * length, first, full)
            first, m, n = first + full, m - full, n - full * each
            if m and n:  # fewer than a bin takes are left
                for k in range(n):
                    put(length, 1, first, capacity - gap + k * length)
                add(gap - n * length, first, 1)
                first, m = first + 1, m - 1
            add(gap, first, m)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _pieces(b, path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the pieces of all documents, each document's ids and a 0 after them, into sequences of at most `capacity`.

    path: the file of a tokenizer that drops white space. Returns doc_id, piece, start, length, ids_crc32, sequence_id
    and offset. A null or empty text is the closing 0 alone; null ids stay null; repeated rows are packed each; an empty
    table gives an empty result. Only id and text are read.
    """
    pieces = written(tokenized_pieces(docs, path, capacity, id_col, text_col), "pieces")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")
    pieces = pieces.withColumn("part", part)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("n0", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    # One row per length: `capacity` of them at most.
    histogram = {x["length"]: x["n"] for x in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = plan(histogram, capacity)
    within = W.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("k", F.row_number().over(within).cast("long") - 1).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("n0") + F.col("k")).alias("rank"))
    starts = (placed[:, 0] << 48) | placed[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = placed[np.searchsorted(starts, (length << 48) | rank, "right") - 1] if len(rank) else placed[:0]
            new = [pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *new], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
