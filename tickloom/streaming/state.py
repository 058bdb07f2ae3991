"""Ticks judged one by one with a state per symbol and session: cumulative volume, the forming bar and the last trade.

The session is part of the key, so nothing carries over to the next one. The same step runs over a stream and a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.streaming.keyed import day_end

OUT = "symbol string, session_date date, event_id bigint, minute bigint, price double, verdict string, delta bigint"
KEPT = "volume bigint, minute bigint, traded bigint, total bigint, size bigint, price double"
NONE = (None, None, None, None, None, None)


def judge(state: tuple, traded: int, total: int, size: int, price: float, width: int, opens: int) -> tuple[tuple, str, int | None]:
    """(state, verdict, volume of the trade) of one tick; opens: seconds of the day at which trading begins.

    A tick of an earlier bar is dropped; its volume shows in the next trade's, which counts from the last total taken.
    """
    volume, minute, *last = state
    if total == 0 and not volume:
        return (0, minute, *last), "no_trade_today", None
    if traded % 86400 < opens:
        if volume is not None and total < volume:
            return state, "volume_regressed", None
        return (total, minute, *last), "pre_open", None
    bar = traded // width
    if minute is not None and bar < minute:
        if volume is None or total == volume:
            return (total, minute, *last), "repeated_last_trade", None
        return state, "late", None
    if volume is not None and total < volume:
        return state, "volume_regressed", None
    key = [traded, total, size, price]
    if key == last:
        return (total, bar, *last), "duplicate", None
    return (total, bar, *key), "trade", total - (total if volume is None else volume)


def _judged(key: tuple, rows: pd.DataFrame, state: tuple, width: int, opens: int) -> tuple[pd.DataFrame, tuple]:
    rows, verdicts, deltas = rows.sort_values(["received", "event_id"]), [], []
    for traded, total, size, price in zip(rows.traded.tolist(), rows.total.tolist(), rows["size"].tolist(), rows.price.tolist(), strict=True):
        state, verdict, delta = judge(state, traded, total, size, price, width, opens)
        verdicts.append(verdict)
        deltas.append(delta)
    out = pd.DataFrame({"symbol": key[0], "session_date": key[1], "event_id": rows.event_id, "minute": rows.traded // width, "price": rows.price})
    return out.assign(verdict=verdicts, delta=pd.array(deltas, "Int64")), state


def judged_stream(ticks: DataFrame, width: int = 60, opens: int = 0, grace: str = "1 hour") -> DataFrame:
    """ticks: symbol, session_date, event_id, received, traded (seconds), total, size, price.

    A session's state goes when the watermark, on the time of receipt, has passed the session's date; what comes later than that is dropped.
    """

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        out, new = _judged(key, rows, state.get if state.exists else NONE, width, opens)
        state.update(new)
        state.setTimeoutTimestamp(max(1000 * day_end(key[1]), state.getCurrentWatermarkMs() + 1))
        yield out

    held = ticks.withColumn("_event", F.col("received").cast("timestamp")).withWatermark("_event", grace)
    return held.groupBy("symbol", "session_date").applyInPandasWithState(step, OUT, KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def judged_batch(ticks: DataFrame, width: int = 60, opens: int = 0) -> DataFrame:
    return ticks.groupBy("symbol", "session_date").applyInPandas(lambda key, rows: _judged(key, rows, NONE, width, opens)[0], OUT)
