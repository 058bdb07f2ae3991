"""Middles of what came before, row by row: the median and the median deviation of a symbol's last rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def middle(rising: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each row's first n numbers, which rise."""
    at = lambda k: np.take_along_axis(rising, np.maximum(k, 0)[:, None], 1)[:, 0]
    return (at((n - 1) // 2) + at(n // 2)) / 2


def middles(x: np.ndarray, there: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row, of the `width` rows before it that are of its symbol: how many are there, their median, and the median deviation from it.

    place: how many rows of the symbol came before.
    """
    padded = np.concatenate([np.full(width, np.nan), np.where(there, x, np.nan)])
    block = np.lib.stride_tricks.sliding_window_view(padded, width)[:-1].copy()
    block[np.arange(width) < width - place[:, None]] = np.nan
    seen = np.concatenate([[0], np.cumsum(there)])
    rows = np.arange(len(x))
    n = seen[rows] - seen[rows - np.minimum(place, width)]
    block.sort(axis=1)
    median = middle(block, n)
    np.abs(np.subtract(block, median[:, None], out=block), out=block)
    block.sort(axis=1)
    return n, median, middle(block, n)


def trailing_middles(rows: DataFrame, key: str, order: str, values: list[str], width: int) -> DataFrame:
    """rows and, for each of values, n_, median_ and mad_ of the `width` rows before by `order` among those alike in key; nulls don't count.

    Rows come sorted, so a task holds a batch and the `width` rows before it.
    """
    names = [f"{part}_{v}" for v in values for part in ("n", "median", "mad")]
    kinds = [f"{part}_{v} {kind}" for v in values for part, kind in (("n", "int"), ("median", "double"), ("mad", "double"))]
    rows = rows.select(*[F.col(c).cast("double").alias(c) if c in values else F.col(c) for c in rows.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last, places = [(np.zeros(0), np.zeros(0, bool))] * len(values), pa.nulls(0), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            prior = pa.concat_arrays([last if len(last) else keys.slice(0, 1), keys.slice(0, len(keys) - 1)])
            other = pc.coalesce(pc.not_equal(keys, prior), pc.xor(pc.is_null(keys), pc.is_null(prior)))
            at = np.arange(len(keys))
            start = np.maximum.accumulate(np.where(other.to_numpy(zero_copy_only=False), at, -1))
            place = np.where(start >= 0, at - start, at + (places[-1] + 1 if len(places) else 0))
            k, out = len(before[0][0]), []
            places = np.concatenate([places, place])[-width:]
            for j, v in enumerate(values):
                c = batch.column(batch.schema.get_field_index(v))
                x = np.concatenate([before[j][0], c.to_numpy(zero_copy_only=False)])
                there = np.concatenate([before[j][1], c.is_valid().to_numpy(zero_copy_only=False)])
                before[j] = x[-width:], there[-width:]
                with np.errstate(invalid="ignore"):
                    n, median, mad = (y[k:] for y in middles(x, there, np.concatenate([np.zeros(k, np.int64), place]), width))
                out += [pa.array(n, pa.int32()), pa.array(median, mask=n == 0), pa.array(mad, mask=n == 0)]
            last = keys.slice(len(keys) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])

    kept = [f"`{c}` {t}" for c, t in rows.dtypes]
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, ", ".join(kept + kinds))
