"""Exact top-k inner products, norm-bucketed.

Vectors stand in buckets of similar length, whose edges and greatest lengths are those of the whole table. A query's
k-th best score among the longest vectors of all is its threshold from the start and rises as vectors are looked at. For
each bucket, the query's local threshold is the cosine a vector of the bucket's greatest length must reach: above 1 the
bucket is skipped; when it is high, vectors are pruned by the bounds it puts on the query's strongest coordinates;
otherwise by length alone. Every query chooses for itself. What is left is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import written

#: Lengths of one bucket differ by this factor at most.
RATIO = 1.05
#: Local thresholds from which coordinates prune.
HIGH = 0.6
#: Queries looked at in one pass over the vectors: so many are broadcast.
QUERIES = 4096
#: The longest vectors, from which the first thresholds come: so many go to the driver.
LONGEST = 4096
#: Coordinates that bound a vector.
FOCUS = 4


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers: exact, by floating point only where that is."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(1))


def bucket_of(length: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(length, 1e-9)) / np.log(RATIO)).astype(np.int64)


class Search:
    """The k best of every query among the vectors seen, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        """floor: scores that are known to be reached k times."""
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.own = lengths(queries) if len(queries) else np.zeros(0)
        self.strong = np.argsort(-np.abs(queries), axis=1, kind="stable")[:, :FOCUS] if queries.size else np.zeros((len(queries), 0), np.int64)
        self.scores = np.zeros((len(queries), k), np.int64)
        self.ids = np.zeros((len(queries), k), np.int64)
        self.found = np.zeros(len(queries), np.int64)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.skipped = self.pruned = self.verified = 0

    def threshold(self) -> np.ndarray:
        last = self.scores[:, -1].astype(np.float64) * (1 - 1e-15 * np.sign(self.scores[:, -1]))
        return np.maximum(self.floor, np.where(self.found == self.k, last, -np.inf))

    def add(self, ids: np.ndarray, vectors: np.ndarray, longest: dict[int, float]) -> None:
        """longest: the greatest length of each bucket."""
        length = lengths(vectors)
        level = bucket_of(length)
        for bucket in np.unique(level)[::-1].tolist():
            here = np.flatnonzero(level == bucket)
            theta, most = self.threshold(), longest.get(bucket, max(longest.values()))
            with np.errstate(invalid="ignore", divide="ignore"):
                local = np.where(self.own * most > 0, theta / (self.own * most), np.where(theta > 0, np.inf, -np.inf))
            # A cosine can't be above 1, but for rounding: such queries are done with this bucket.
            live = ~(local > 1 + 1e-9)
            self.skipped += int((~live).sum()) * len(here)
            by_length = np.flatnonzero(live & ~(local > HIGH))
            if len(by_length):
                self.verified += len(by_length) * len(here)
                for q, s in zip(by_length.tolist(), products(self.queries[by_length], vectors[here]), strict=True):
                    self.merge(q, s, ids[here])
            unit = None
            for q in np.flatnonzero(live & (local > HIGH)).tolist():
                unit = vectors[here] / np.maximum(length[here], 1e-9)[:, None] if unit is None else unit
                left = here[self.possible(q, unit, length[here], theta[q])]
                self.pruned += len(here) - len(left)
                self.verified += len(left)
                self.merge(q, products(self.queries[q : q + 1], vectors[left])[0], ids[left])

    def possible(self, q: int, unit: np.ndarray, length: np.ndarray, theta: float) -> np.ndarray:
        """Vectors that the query can't rule out by its strongest coordinates.

        With q and x the shares of those coordinates, the rest adds at most sqrt(1-|q|^2) sqrt(1-|x|^2) to the cosine.
        """
        strong, n = self.strong[q], self.own[q]
        a, b = self.queries[q, strong] / max(n, 1e-9), unit[:, strong]
        most = b @ a + np.sqrt(max(0.0, 1 - a @ a)) * np.sqrt(np.maximum(0.0, 1 - (b * b).sum(1)))
        bound = most * n * length
        return bound >= theta - 1e-9 * (abs(theta) + n * length) - 1e-6

    def merge(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = np.flatnonzero((ids != self.query_ids[q]) & ((scores >= self.scores[q, -1]) if self.found[q] == self.k else True))
        if len(hit) > 4 * self.k:  # all that tie with the k-th largest stay
            s = scores[hit]
            hit = hit[s >= np.partition(s, len(s) - self.k)[len(s) - self.k]]
        if not len(hit):
            return
        n = self.found[q]
        s, i = np.concatenate([self.scores[q, :n], scores[hit]]), np.concatenate([self.ids[q, :n], ids[hit]])
        top = np.lexsort((i, -s))[: self.k]
        self.found[q] = len(top)
        self.scores[q, : len(top)], self.ids[q, : len(top)] = s[top], i[top]

    def rows(self) -> pa.RecordBatch:
        there = np.arange(self.k) < self.found[:, None]
        query = np.repeat(self.query_ids, self.found)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (query, self.ids[there], self.scores[there])], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of greatest integer inner product for each query: rows whose id is divisible by `every`.

    Components become floor(scale * x). Returns query_id, rank, vec_id and score; ties go to the smaller id, fewer rows
    where there are fewer candidates. Null ids or vectors, and vectors that hold null or non-finite components or whose
    width differs from the most common one, take no part; repeated rows are candidates each, but for a query's own id,
    and repeated queries ask once; an empty table gives an empty result. Only id and vector are read, so other columns
    may clash. Products are exact as long as they fit 64 bits.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).cast("array<long>").alias("v"))
    counts = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    common = counts.orderBy(F.desc("n"), "width").limit(1).collect()
    if not common:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    rows = rows.where(F.size("v") == common[0]["width"])
    asked = rows.where(F.col("vec_id") % every == 0)
    squares = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for b in batches:
            length = lengths(_matrix(b.column(0), b.num_rows)) if b.num_rows else np.zeros(0)
            for x, y in zip(bucket_of(length).tolist(), length.tolist(), strict=True):
                most[x] = max(most.get(x, 0.0), y)
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.float64())], ["bucket", "longest"])

    # A row for each bucket: as many as powers of RATIO lie between the shortest and the longest vector.
    longest = {x["bucket"]: x["longest"] for x in rows.select("v").mapInArrow(greatest, "bucket long, longest double").groupBy("bucket").agg(F.max("longest").alias("longest")).collect()}
    heads = rows.orderBy(squares.desc(), "vec_id").limit(LONGEST).toArrow()
    head_ids, heads = heads.column(0).to_numpy(), _matrix(heads.column(1).combine_chunks(), heads.num_rows)
    blocks = max(1, -(-common[0]["q"] // QUERIES))
    found = None
    for block in range(blocks):  # a bounded block of the stated queries against all rows, one after the other
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).distinct().orderBy("vec_id").toArrow()
        query_ids, queries = part.column(0).to_numpy(), _matrix(part.column(1).combine_chunks(), part.num_rows)
        first = Search(query_ids, queries, k)
        if len(query_ids):
            first.add(head_ids, heads, longest)
        told = vectors.sparkSession.sparkContext.broadcast((query_ids, queries, first.threshold()))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            query_ids, queries, floor = told.value
            search = Search(query_ids, queries, k, floor)
            for b in batches:
                if b.num_rows and len(query_ids):
                    search.add(b.column(0).to_numpy(), _matrix(b.column(1), b.num_rows), longest)
            yield search.rows()

        some = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        some = some.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        some = written(some, "topk")
        found = some if found is None else found.unionByName(some)
    return found
