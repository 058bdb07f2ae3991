"""Words of whole texts as 64-bit hashes, with numpy on Arrow's buffers: no object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once.
BLOCK = 1 << 19
_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Places in a word whose values are looked up; those of later places are computed.
PLACES = 256


def _values(key: np.ndarray) -> np.ndarray:
    """The value of a byte at a place of its word, key = 256 * place + byte."""
    return mixed((key.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR))


_EXACT = _values(np.arange(256 * PLACES))
_FOLDED = _EXACT.reshape(PLACES, 256).copy()
_FOLDED[:, ord("A") : ord("Z") + 1] = _FOLDED[:, ord("a") : ord("z") + 1]
_FOLDED = _FOLDED.ravel()
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def hashed(data: np.ndarray, starts_of: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data (bytes), A-Z like a-z unless exact, and each word's start. starts_of: where a text begins.

    A word's hash is the mixed sum of values that each byte has at its place: the values are unrelated, so no pattern of
    letters makes sums meet.
    """
    n = len(data)
    blank = _BLANK[data]
    begins, ends = ~blank, ~blank
    begins[1:] &= blank[:-1]
    ends[:-1] &= blank[1:]
    cut = starts_of[(starts_of > 0) & (starts_of < n)]
    begins[cut] |= ~blank[cut]
    ends[cut - 1] |= ~blank[cut - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(first):
        return np.zeros(0, np.uint64), first
    origin = np.zeros(n, np.int64)
    origin[first] = np.diff(first, prepend=0)
    key = ((np.arange(n) - np.cumsum(origin)) << 8) | data
    values = (_EXACT if exact else _FOLDED)[np.minimum(key, 256 * PLACES - 1)]
    late = np.flatnonzero((key >= 256 * PLACES) & ~blank)
    if len(late):
        values[late] = _values(key[late] if exact else (key[late] & ~255) | _FOLD[data[late]])
    values[blank] = 0
    return mixed(np.add.reduceat(values, first) + (last - first + 1).astype(np.uint64)), first


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, row after the last, bytes, where each row's text begins) of blocks of a column without nulls, in order.

    A text longer than BLOCK comes as several blocks of that one row, cut at blanks.
    """
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        start, to = int(offsets[row]), row + 1
        while to < len(column) and offsets[to + 1] - start <= BLOCK:
            to += 1
        stop = int(offsets[to])
        if stop - start <= BLOCK:
            yield row, to, data[start:stop], offsets[row:to] - start
        while stop - start > BLOCK:
            upto = min(stop, start + BLOCK)
            while upto < stop:
                blanks = np.flatnonzero(_BLANK[data[start:upto]])
                if len(blanks):
                    upto = start + int(blanks[-1]) + 1
                    break
                upto = min(stop, upto + BLOCK)
            yield row, to, data[start:upto], np.zeros(1, np.int64)
            start = upto
            if stop - start <= BLOCK:
                yield row, to, data[start:stop], np.zeros(1, np.int64)
        row = to


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text of a column without nulls, in order."""
    held: list[np.ndarray] = []
    last = -1
    for row, to, data, starts in blocks(column):
        h, first = hashed(data, starts)
        if to - row > 1:
            bounds = [*np.searchsorted(first, starts).tolist(), len(h)]
            parts = [h[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
        else:
            parts = [h]
        for k, part in enumerate(parts, row):
            if k != last:
                if last >= 0:
                    yield last, np.concatenate(held) if len(held) > 1 else held[0]
                held, last = [], k
            held.append(part)
    if last >= 0:
        yield last, np.concatenate(held) if len(held) > 1 else held[0]


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; of the whole sequence where there are fewer; none without words."""
    n = len(h)
    if not n:
        return h
    runs = max(1, n - size + 1)
    out = np.full(runs, np.uint64(min(n, size)))
    for j in range(min(n, size)):
        out = mixed(out * np.uint64(_FACTOR) + h[j : j + runs])
    return out
