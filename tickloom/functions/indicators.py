"""Full series of the recursive indicators, by keys and in an order of the caller's choice.

A group is one instrument's bars (of a session, or of its history): Spark deals groups over the cluster and numpy runs the
recursions within one. Windows that frames express are better written as such (operators/indicators.py).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Series = np.ndarray


def seeded(x: Series, p: int, weight: float) -> Series:
    """From the mean of the first p values on, weight * value + (1 - weight) * previous; missing where a value is, and after."""
    out = np.full(len(x), np.nan)
    if len(x) >= p and np.isfinite(x[:p]).all():
        out[p - 1] = x[:p].mean()
        for i in range(p, len(x)):
            out[i] = weight * x[i] + (1 - weight) * out[i - 1]
    return out


def ema(x: Series, p: int) -> Series:
    return seeded(x, p, 2 / (p + 1))


def rma(x: Series, p: int) -> Series:
    """Wilder's average."""
    return seeded(x, p, 1 / p)


def plain_ema(x: Series, p: int) -> Series:
    """Without a seed: from the first value on."""
    out = np.array(x, float)
    for i in range(1, len(x)):
        out[i] = out[i - 1] + 2 / (p + 1) * (x[i] - out[i - 1])
    return out


def after(x: Series, of: Callable[[Series], Series]) -> Series:
    """of the values from the first that isn't missing on."""
    there = np.flatnonzero(np.isfinite(x))
    out = np.full(len(x), np.nan)
    if len(there):
        out[there[0] :] = of(x[there[0] :])
    return out


def true_range(high: Series, low: Series, close: Series) -> Series:
    before = np.concatenate([close[:1], close[:-1]])
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before))) if len(close) else close


def rsi(close: Series, p: int) -> Series:
    d = np.diff(close, prepend=np.nan)
    up, down = after(np.maximum(d, 0), lambda x: rma(x, p)), after(np.maximum(-d, 0), lambda x: rma(x, p))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + up / down)
    return np.where(down == 0, np.where(up == 0, 50, 100), out) + 0 * up


def macd(close: Series, fast: int, slow: int, signal: int) -> tuple[Series, Series, Series]:
    line = ema(close, fast) - ema(close, slow)
    of_line = after(line, lambda x: ema(x, signal))
    return line, of_line, line - of_line


def adx(high: Series, low: Series, close: Series, p: int) -> tuple[Series, Series, Series]:
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    atr = rma(true_range(high, low, close), p)
    with np.errstate(divide="ignore", invalid="ignore"):
        plus, minus = (100 * rma(x, p) / np.where(atr == 0, np.nan, atr) for x in (plus, minus))
        apart = 100 * np.abs(plus - minus) / np.where(plus + minus == 0, np.nan, plus + minus)
    return after(apart, lambda x: rma(x, p)), plus, minus


def supertrend(high: Series, low: Series, close: Series, p: int, factor: float) -> tuple[Series, Series]:
    """Bands around the middle that only tighten until the close crosses them; the direction starts upwards."""
    atr, middle = rma(true_range(high, low, close), p), (high + low) / 2
    upper, lower = middle + factor * atr, middle - factor * atr
    line, way = np.full(len(close), np.nan), np.full(len(close), np.nan)
    for i in np.flatnonzero(np.isfinite(atr)):
        if i == p - 1:
            way[i] = 1
        else:
            if not (upper[i] < upper[i - 1] or close[i - 1] > upper[i - 1]):
                upper[i] = upper[i - 1]
            if not (lower[i] > lower[i - 1] or close[i - 1] < lower[i - 1]):
                lower[i] = lower[i - 1]
            way[i] = (1 if close[i] > upper[i] else -1) if way[i - 1] == -1 else (-1 if close[i] < lower[i] else 1)
        line[i] = lower[i] if way[i] == 1 else upper[i]
    return line, way


#: Settings by name.
PERIODS = {"rma": 14, "ema_fast": 9, "ema_slow": 20, "atr": 14, "rsi": 14, "macd_fast": 12, "macd_slow": 26, "macd_signal": 9, "adx": 14, "keltner": 20, "keltner_atr": 10, "keltner_factor": 2.0, "trend": 10, "trend_factor": 3.0}
NAMES = (
    "rma", "ema_fast", "ema_slow", "ema_plain", "true_range", "atr", "natr", "rsi", "macd_line", "macd_signal", "macd_histogram", "adx", "plus_di", "minus_di",
    "keltner_middle", "keltner_upper", "keltner_lower", "supertrend", "supertrend_direction",
)


def of_group(high: Series, low: Series, close: Series, s: dict[str, float]) -> dict[str, Series]:
    with np.errstate(divide="ignore", invalid="ignore"):
        atr = rma(true_range(high, low, close), s["atr"])
        natr = 100 * atr / np.where(close == 0, np.nan, close)
    line, signal, histogram = macd(close, s["macd_fast"], s["macd_slow"], s["macd_signal"])
    strength, plus, minus = adx(high, low, close, s["adx"])
    middle, width = ema(close, s["keltner"]), s["keltner_factor"] * rma(true_range(high, low, close), s["keltner_atr"])
    trend, way = supertrend(high, low, close, s["trend"], s["trend_factor"])
    values = (
        rma(close, s["rma"]), ema(close, s["ema_fast"]), ema(close, s["ema_slow"]), plain_ema(close, s["ema_slow"]), true_range(high, low, close), atr, natr, rsi(close, s["rsi"]), line, signal, histogram,
        strength, plus, minus, middle, middle + width, middle - width, trend, way,
    )
    return dict(zip(NAMES, values, strict=True))


def indicator_series(bars: DataFrame, keys: list[str], order: list[str], names: tuple[str, ...] = NAMES, high: str = "high", low: str = "low", close: str = "close", **settings: float) -> DataFrame:
    """keys, order and the named indicators at every bar, null where there are too few before it.

    A missing price ends a recursion for the rest of its group, as it says that the series has a gap.
    """
    said = PERIODS | settings
    columns = [*keys, *order]
    schema = ", ".join([*[f"{c} {t}" for c, t in bars.select(*columns).dtypes], *[f"{n} double" for n in names]])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        made = of_group(*(rows[c].to_numpy(float) for c in (high, low, close)), said)
        return rows[columns].assign(**{n: pd.Series(np.round(made[n], 6), index=rows.index).astype(object).where(lambda x: x.notna(), None) for n in names})

    return bars.select(*columns, high, low, close).groupBy(*keys).applyInPandas(one, schema)
