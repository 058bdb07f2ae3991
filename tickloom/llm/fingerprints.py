"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs where its own bytes say so: after line ends, after sentences and after every fourth word or so, by a hash of
the bytes before; what stays the same between two versions is cut the same. A table adds each paragraph's digest to three
cells; one version's cells minus the other's hold only the paragraphs that differ, and peeling reads them off cells that hold one
alone. A fingerprint is a small table; where two versions differ by more than it can tell, tables of both are made larger until
they can. Likeness is 1 - differing / all paragraphs of both.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import whole
from tickloom.llm.wordhash import mixed

#: Cells of a fingerprint; a multiple of three.
CELLS = 24
#: Tables grow by this factor after a failure.
LARGER = 4
#: Bytes of a paragraph at most.
MOST_BYTES = 256
#: One blank in so many ends a paragraph within a sentence. A power of two.
ONE_IN = 4
#: Characters of texts handled at once, and bytes hashed at once.
CHUNK = 1 << 20
BLOCK = 1 << 19
#: Rows between two splitters, splitters at most, and draws for each.
ROWS, MOST_RANGES, DRAWS = 512, 1 << 18, 8

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CHECK = np.uint64(0xD1B54A32D192ED03)
_LOW = np.uint64(0xFFFFFFFF)
#: A value for each byte at each place of a paragraph.
_VALUES = mixed((np.arange(256 * MOST_BYTES, dtype=np.uint64) + np.uint64(1)) * _FACTOR)
_ENDERS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def _starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where paragraphs start. begins: where texts do, ascending; a text's cuts depend on its own bytes alone."""
    blank = np.flatnonzero(data == 0x20)
    into = blank - begins[np.searchsorted(begins, blank, "right") - 1]
    before = np.zeros(len(blank), np.uint64)
    for j in range(1, 5):
        before = (before << np.uint64(8)) | np.where(into >= j, data[blank - j], 0).astype(np.uint64)
    ends = _ENDERS[(before >> np.uint64(24)).astype(np.int64)] | (mixed(before * _FACTOR) % np.uint64(ONE_IN) == 0)
    starts = np.concatenate([begins, np.flatnonzero(data == 0x0A) + 1, blank[ends] + 1])
    starts = np.unique(starts[starts < len(data)])
    # Long ones are cut again.
    more = (np.diff(np.append(starts, len(data))) - 1) // MOST_BYTES
    place = np.arange(len(starts) + int(more.sum())) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    return np.repeat(starts, more + 1) + MOST_BYTES * place


def _digests(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    ends = np.append(starts[1:], len(data))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        length = ends[at:to] - starts[at:to]
        place = np.arange(high - low) - np.repeat(starts[at:to] - low, length)
        values = _VALUES[(place << 8) | data[low:high]]
        out[at:to] = mixed(np.add.reduceat(values, starts[at:to] - low) + length.astype(np.uint64) * _CHECK)
        at = to
    return out


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of all paragraphs, in order of the texts; a repeated paragraph's digest bears its number in the text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    there = np.flatnonzero(sizes)
    starts = _starts(data, begins[there])
    digest = _digests(data, starts)
    text = there[np.searchsorted(begins[there], starts, "right") - 1]
    order = np.lexsort((digest, text))
    text, digest = text[order], digest[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])
    number = np.arange(len(text)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(text))))
    return text, np.where(number > 0, mixed(digest + number.astype(np.uint64) * _FACTOR), digest)


def _check(digest: np.ndarray) -> np.ndarray:
    return mixed(digest ^ _CHECK) & _LOW


def _places(digest: np.ndarray, size: int) -> np.ndarray:
    """Three cells of each digest, one in each third of a table; unrelated ones for each size."""
    third = np.uint64(size // 3)
    seeds = np.arange(3 * size, 3 * size + 3, dtype=np.uint64) * _FACTOR
    return np.stack([mixed(digest + seed) % third + np.uint64(j) * third for j, seed in enumerate(seeds)]).astype(np.int64)


class Tables:
    """Tables of one size, one for each of `n` texts: counts, sums of digests and sums of their checks, to 64 and 32 bits."""

    def __init__(self, n: int, size: int) -> None:
        self.n, self.size = n, size
        self.count = np.zeros(n * size, np.int64)
        self.digest = np.zeros(n * size, np.uint64)
        self.check = np.zeros(n * size, np.uint64)

    def add(self, text: np.ndarray, digest: np.ndarray, sign: int | np.ndarray = 1) -> np.ndarray:
        """Adds digests, or with a sign of -1 takes them away; returns the cells."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), digest.shape)
        at, times = (text * self.size + _places(digest, self.size)).ravel(), sign.astype(np.uint64)
        np.add.at(self.count, at, np.tile(sign, 3))
        np.add.at(self.digest, at, np.tile(digest * times, 3))
        np.add.at(self.check, at, np.tile(_check(digest) * times, 3))
        return at

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.n, self.size)
        out.count, out.digest, out.check = self.count - other.count, self.digest - other.digest, self.check - other.check
        return out

    def rows(self, which: np.ndarray) -> Tables:
        out = Tables(len(which), self.size)
        for c in ("count", "digest", "check"):
            setattr(out, c, getattr(self, c).reshape(self.n, self.size)[which].ravel())
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, digest, sign) of what the tables hold, and for each table whether that is all of it. Empties the tables."""
        found: list[tuple[np.ndarray, ...]] = []
        look = np.arange(self.n * self.size)
        for _ in range(64 + 4 * self.size):
            one = look[np.abs(self.count[look]) == 1]
            sign = self.count[one]
            digest = self.digest[one] * sign.astype(np.uint64)
            pure = _check(digest) == (self.check[one] * sign.astype(np.uint64)) & _LOW
            text, digest, sign = one[pure] // self.size, digest[pure], sign[pure]
            if not len(text):
                break
            order = np.lexsort((digest, text))
            text, digest, sign = text[order], digest[order], sign[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])
            text, digest, sign = text[new], digest[new], sign[new]
            found.append((text, digest, sign))
            look = np.unique(self.add(text, digest, -sign))
        left = ((self.count != 0) | (self.digest != 0) | (self.check & _LOW != 0)).reshape(self.n, self.size).any(1)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return *(tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else empty), ~left

    def strings(self, n_paragraphs: np.ndarray) -> list[str]:
        """The tables as texts: the number of paragraphs and all cells."""
        parts = [n_paragraphs.astype("<i8").reshape(self.n, 1), self.count.astype("<i4").reshape(self.n, self.size), self.digest.astype("<u8").reshape(self.n, self.size), (self.check & _LOW).astype("<u4").reshape(self.n, self.size)]
        rows = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(self.n, -1) for p in parts], axis=1) if self.n else np.zeros((0, 0), np.uint8)
        return [base64.b64encode(r.tobytes()).decode() for r in rows]


def read_fingerprint(fingerprint: str) -> tuple[int, Tables]:
    """The number of paragraphs and the table of a fingerprint."""
    raw = base64.b64decode(fingerprint)
    size = (len(raw) - 8) // 16
    out = Tables(1, size)
    out.count = np.frombuffer(raw, "<i4", size, 8).astype(np.int64)
    out.digest = np.frombuffer(raw, "<u8", size, 8 + 4 * size).astype(np.uint64)
    out.check = np.frombuffer(raw, "<u4", size, 8 + 12 * size).astype(np.uint64)
    return int(np.frombuffer(raw, "<i8", 1)[0]), out


def likeness(one: str, other: str) -> float | None:
    """The likeness of two texts by their fingerprints alone; None where they differ by more than these can tell."""
    (n, a), (m, b) = read_fingerprint(one), read_fingerprint(other)
    text, _, _, whole_ = a.minus(b).peel()
    return None if not whole_[0] else 1.0 - len(text) / (n + m) if n + m else 1.0


class Versions:
    """Paragraphs of texts and their fingerprints, and what differs between some of them."""

    def __init__(self, texts: list[bytes]) -> None:
        self.text, self.digest = paragraphs(texts)
        self.n = np.bincount(self.text, minlength=len(texts))
        self.bounds = np.append(0, np.cumsum(self.n))
        self.tables = Tables(len(texts), CELLS)
        self.tables.add(self.text, self.digest)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in which, digest) of the paragraphs of some texts."""
        n = self.n[which]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[which], n)
        return np.repeat(np.arange(len(which)), n), self.digest[at]

    def differing(self, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, digest, sign) of the paragraphs that only old[pair] (sign 1) or only new[pair] (-1) has, and each pair's cells.

        First from the fingerprints; for pairs that these can't tell, from larger and larger tables of both texts.
        """
        table = self.tables.rows(old).minus(self.tables.rows(new))
        cells, pairs, found = np.full(len(old), CELLS), np.arange(len(old)), []
        while True:
            pair, digest, sign, done = table.peel()
            keep = done[pair]
            found.append((pairs[pair[keep]], digest[keep], sign[keep]))
            pairs = pairs[~done]
            if not len(pairs):
                return *(np.concatenate(x) for x in zip(*found, strict=True)), cells
            size = table.size * LARGER
            table = Tables(len(pairs), size)
            table.add(*self.of(old[pairs]))
            table.add(*self.of(new[pairs]), -1)
            cells[pairs] = size

    def near(self, old: np.ndarray, new: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The likeness of each pair, from the pairs of the differing paragraphs."""
        both = self.n[old] + self.n[new]
        return 1.0 - np.bincount(pair, minlength=len(old)) / np.maximum(both, 1)


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first code points of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDITS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    + [("n_paragraphs", pa.int64()), ("n_lost", pa.int64()), ("n_gained", pa.int64()), ("cells", pa.int64())]
)
EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, n_lost long, n_gained long, cells long"


def _of_edits(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Of rows (doc_id, text, the following text)."""
    n = len(rows)
    changed = [edited(t, f).encode() for _, t, f in rows]
    # A row's following text mostly is the next row's text.
    texts, following = [t.encode() for _, t, _ in rows], []
    for k, (_, _, f) in enumerate(rows):
        if k + 1 < n and rows[k + 1][1] is f:
            following.append(k + 1)
        else:
            following.append(len(texts))
            texts.append(f.encode())
    versions = Versions([*texts, *changed])
    own, new = np.arange(n), np.arange(n) + len(texts)
    fingerprints = versions.tables.strings(versions.n)
    pair, _, sign, cells = versions.differing(own, new)
    other = np.array(following)
    with_next, _, _, _ = versions.differing(own, other)
    columns = [
        [r[0] for r in rows],
        [len(r[1]) for r in rows],
        [hashlib.sha256(t).hexdigest() for t in changed],
        fingerprints[:n],
        fingerprints[len(texts) :],
        versions.near(own, new, pair),
        versions.near(own, other, with_next),
        versions.n[:n],
        np.bincount(pair[sign > 0], minlength=n),
        np.bincount(pair[sign < 0], minlength=n),
        cells,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDITS, strict=True)], schema=_EDITS)


def _packed(null: np.ndarray, inverse: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    """Keys as byte strings that sort like (null, inverse, text_hash)."""
    sign = np.uint64(1 << 63)
    parts = [null.astype(np.uint8).reshape(-1, 1)]
    parts += [(x.view(np.uint64) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8) for x in (inverse, text_hash)]
    return np.ascontiguousarray(np.concatenate(parts, axis=1)).view("S17").ravel()


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """stretch, guest, null, inverse, text_hash, doc_id and text: every row in a stretch of the order by descending id.

    Rows stand by id, null last, and then by a hash of the text; the row after the last is the first. Splitters are rows of
    the table, drawn by hash, and each is the first of its stretch; as a guest (1) it also ends the stretch before. So
    each row's following one is in its stretch, and texts move once. Rows alike in id and text stay in one stretch.
    """
    doc_id, text = F.col(id_col).cast("long"), whole(text_col)
    rows = docs.select(doc_id.isNull().alias("null"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).alias("inverse"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    key = F.struct("null", "inverse", "text_hash")
    n = rows.count()
    every = max(1, n // min(DRAWS * (n // ROWS + 1), DRAWS * MOST_RANGES))
    drawn = F.when(F.pmod(F.xxhash64("null", "inverse", "text_hash"), F.lit(every)) == 0, key)
    drawn = rows.groupBy(drawn.alias("drawn")).agg(F.min(key).alias("low")).select("low.*", F.col("drawn").isNotNull().alias("drawn")).toArrow()
    keys = _packed(*(drawn.column(k).to_numpy() for k in range(3)))
    some = np.sort(keys[drawn.column(3).to_numpy()])[::DRAWS]
    # The first row of all is a splitter.
    splitters = np.unique(np.concatenate([some, np.sort(keys)[:1]]))
    told = docs.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = told.value
        for b in batches:
            if not b.num_rows:
                continue
            packed = _packed(*(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            stretch = np.searchsorted(splitters, packed, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(stretch), pa.array(np.zeros(len(stretch), np.int64)), *b.columns], ["stretch", "guest", *b.schema.names])
            first = np.flatnonzero(splitters[stretch] == packed)
            if len(first):
                guests = b.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array((stretch[first] - 1) % len(splitters)), pa.array(np.ones(len(first), np.int64)), *guests.columns], ["stretch", "guest", *b.schema.names])

    dealt = rows.mapInArrow(run, "stretch long, guest long, null boolean, inverse long, text_hash long, text string")
    dealt = dealt.repartition("stretch").sortWithinPartitions("stretch", "guest", "null", "inverse", "text_hash")
    return dealt.withColumn("doc_id", F.when(~F.col("null"), F.bitwise_not("inverse")))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is taken from the row that follows by descending id.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, and of
    the edit n_lost and n_gained paragraphs and the cells of the table that told them. A null text is an empty one, which
    has no paragraphs and is like another such one. Null ids come last, rows of one id go by a hash of their texts, repeated
    rows are rows each, one row alone is followed by itself, and an empty table gives an empty result. Other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, str]] = []
        weight = 0
        before: tuple[int, int, int | None, str] | None = None
        for b in batches:
            stretches, guests, ids = (b.column(k).to_pylist() for k in range(3))
            for k, (stretch, guest, doc_id) in enumerate(zip(stretches, guests, ids, strict=True)):
                if guest and before is not None and before[1] and before[0] == stretch:
                    continue  # one guest is enough
                text = b.column(3)[k].as_py()
                if before is not None and not before[1]:
                    if before[0] != stretch:
                        raise RuntimeError("a stretch of rows lost the one that follows it; the input must be the same whenever it is read")
                    held.append((before[2], before[3], text))
                    weight += len(before[3]) + 64
                before = (stretch, guest, doc_id, text)
                if weight >= CHUNK:
                    yield _of_edits(held)
                    held, weight = [], 0
        if before is not None and not before[1]:
            raise RuntimeError("a stretch of rows lost the one that follows it; the input must be the same whenever it is read")
        if held:
            yield _of_edits(held)

    return with_following(docs, id_col, text_col).select("stretch", "guest", "doc_id", "text").mapInArrow(run, EDITS)


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs and fingerprint of every row; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                v = Versions(part.column(1).cast(pa.large_binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v.n.astype(np.int64)), pa.array(v.tables.strings(v.n), pa.string())], ["doc_id", "n_paragraphs", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, n_paragraphs long, fingerprint string")


def compare_versions(pairs: DataFrame, id_col: str = "doc_id", old_col: str = "old", new_col: str = "new") -> DataFrame:
    """What differs between two versions in a row: doc_id, near, lost and gained (digests of paragraphs) and cells.

    Null versions are empty ones, a null id stays null, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                n = part.num_rows
                v = Versions([x for k in (1, 2) for x in part.column(k).cast(pa.large_binary()).to_pylist()])
                old = np.arange(n)
                pair, digest, sign, cells = v.differing(old, old + n)
                order = np.lexsort((digest, pair))
                lists = []
                for side in (1, -1):
                    hit = order[sign[order] == side]
                    lists.append(pa.ListArray.from_arrays(np.searchsorted(pair[hit], np.arange(n + 1)).astype(np.int32), digest[hit].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v.near(old, old + n, pair)), *lists, pa.array(cells)], ["doc_id", "near", "lost", "gained", "cells"])

    rows = pairs.select(F.col(id_col).cast("long").alias("doc_id"), whole(old_col).alias("old"), whole(new_col).alias("new"))
    return rows.mapInArrow(run, "doc_id long, near double, lost array<long>, gained array<long>, cells long")
