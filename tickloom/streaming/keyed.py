"""Operators with a state for each key, which a timer on event time closes: what the watermark has passed is said and forgotten.

An operator is a fold over a key's rows in order of time, and what it says when its time is over. It runs the same over a batch, so a
stream can be held against the rows that it has read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Rows = list[tuple]


@dataclass(frozen=True)
class Keyed:
    """keys, order and at (seconds) are columns; out and state are schemas, a state is a tuple.

    fold(key, state or None, row) -> (state, rows to say); ends(key, state) -> the second at which it closes; close(key, state) -> rows to say then.
    """

    keys: tuple[str, ...]
    columns: tuple[str, ...]
    out: str
    state: str
    fold: Callable[[tuple, tuple | None, tuple], tuple[tuple, Rows]]
    ends: Callable[[tuple, tuple], int]
    close: Callable[[tuple, tuple], Rows] = lambda key, state: []

    def rows(self, parts: Iterable[pd.DataFrame]) -> Rows:
        """A key's rows in order of time. Keys are many and their rows few, so these are tuples: a frame costs more than its rows."""
        return self.ordered([row for part in parts for row in zip(*(part[c].tolist() for c in ("_at", *self.columns)), strict=True)])

    @staticmethod
    def ordered(rows: Rows) -> Rows:
        return sorted(rows, key=lambda row: [(v is None or v != v, 0 if v is None or v != v else v) for v in row]) if len(rows) > 1 else rows

    def run(self, key: tuple, state: tuple | None, rows: Rows) -> tuple[tuple | None, Rows]:
        said: Rows = []
        for row in rows:
            at, row = row[0], row[1:]
            if state is not None and at >= self.ends(key, state):  # the timer would have come before
                said += self.close(key, state)
                state = None
            state, more = self.fold(key, state, (at, *row))
            said += more
        return state, said

    def frame(self, key: tuple, said: Rows) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in said], columns=[c.strip().split(" ")[0] for c in self.out.split(",")], dtype=object)

    def _rows(self, rows: DataFrame, at: str) -> DataFrame:
        moment = F.col(at).cast("timestamp")
        return rows.select(*self.keys, moment.alias("_event"), F.unix_seconds(moment).alias("_at"), *self.columns)

    def stream(self, rows: DataFrame, at: str, grace: str) -> DataFrame:
        """Rows are folded as they come, a batch's in order of time; later ones than the watermark are dropped."""

        def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                said = self.close(key, state.get)
                state.remove()
            else:
                new, said = self.run(key, state.get if state.exists else None, self.rows(parts))
                state.update(new)
                state.setTimeoutTimestamp(max(1000 * self.ends(key, new), state.getCurrentWatermarkMs() + 1))
            if said:
                yield self.frame(key, said)

        held = self._rows(rows, at).withWatermark("_event", grace)
        return held.groupBy(*self.keys).applyInPandasWithState(step, self.out, self.state, "append", GroupStateTimeout.EventTimeTimeout)

    def bucketed(self, rows: DataFrame, at: str, grace: str, buckets: int = 1024) -> DataFrame:
        """The same as stream for very many keys with few rows: a state is that of all keys of a bucket, so Spark calls once for many of them.

        A bucket holds its rows of one batch; more rows want more buckets.
        """
        wide = len(self.keys)

        def step(_: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            held = pickle.loads(bytes(state.get[0])) if state.exists else {}
            mark, said, seen = state.getCurrentWatermarkMs(), [], {}
            if not state.hasTimedOut:
                for part in parts:
                    for row in zip(*(part[c].tolist() for c in (*self.keys, "_at", *self.columns)), strict=True):
                        seen.setdefault(row[:wide], []).append(row[wide:])
            for key, some in seen.items():
                held[key], more = self.run(key, held.get(key), self.ordered(some))
                said += [(*key, *r) for r in more]
            for key in [k for k, s in held.items() if k not in seen and 1000 * self.ends(k, s) < mark]:
                said += [(*key, *r) for r in self.close(key, held.pop(key))]
            if held:
                state.update((pickle.dumps(held),))
                state.setTimeoutTimestamp(max(min(1000 * self.ends(k, s) for k, s in held.items()), mark + 1))
            elif state.exists:
                state.remove()
            if said:
                yield self.frame((), said)

        dealt = self._rows(rows, at).withColumn("_bucket", F.pmod(F.hash(*self.keys), F.lit(buckets))).withWatermark("_event", grace)
        return dealt.groupBy("_bucket").applyInPandasWithState(step, self.out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)

    def batch(self, rows: DataFrame, at: str, grace_seconds: int) -> DataFrame:
        """The same over all rows at once, closed up to the latest row less the grace."""
        told = self._rows(rows, at)
        latest = told.agg(F.max(F.unix_millis("_event")).alias("ms")).head()["ms"]
        mark = (latest or 0) - 1000 * grace_seconds

        def step(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
            state, said = self.run(key, None, self.rows([some]))
            if 1000 * self.ends(key, state) < mark:
                said = said + self.close(key, state)
            return self.frame(key, said)

        return told.groupBy(*self.keys).applyInPandas(step, self.out)


def day_end(day: object) -> int:
    """The second after a session's date, UTC."""
    return int(pd.Timestamp(day).timestamp()) + 86400


def cooldown(seconds: int = 900) -> Keyed:
    """subject, moment, severity of events that fire: none within the cooldown of the last that did, unless it is more severe."""

    def fold(key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, Rows]:
        at, severity = row
        if state is None or severity > state[1]:
            return (at, severity), [(at, severity)]
        return state, []

    return Keyed(("subject",), ("severity",), "subject string, moment long, severity int", "moment long, severity int", fold, lambda key, s: s[0] + seconds)


def buildup(idle: int = 40 * 86400) -> Keyed:
    """What price and open interest say against the reading before: long or short built up, unwound or covered."""
    names = {(1, 1): "LONG_BUILDUP", (-1, 1): "SHORT_BUILDUP", (-1, -1): "LONG_UNWINDING", (1, -1): "SHORT_COVERING"}
    sign = lambda a, b: (a > b) - (a < b)

    def fold(key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, Rows]:
        at, price, oi = row
        said = "UNKNOWN" if state is None else names.get((sign(price, state[1]), sign(oi, state[2])), "NEUTRAL")
        return (at, price, oi), [(at, said)]

    return Keyed(("underlying",), ("price", "oi"), "underlying string, moment long, buildup string", "at long, price double, oi double", fold, lambda key, s: s[0] + idle)


def sampler() -> Keyed:
    """Of a counter's readings in a session the largest step and the sum of steps, said when the session is over; a counter that fell began anew."""

    def fold(key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, Rows]:
        _, counter = row
        last, most, total, n = state or (0, 0, 0, 0)
        step = counter - last if counter >= last else counter
        return (counter, max(most, step), total + step, n + 1), []

    return Keyed(("session_date",), ("counter",), "session_date date, most long, total long, n long", "last long, most long, total long, n long", fold, lambda key, s: day_end(key[0]), lambda key, s: [(s[1], s[2], s[3])])


def pending(buckets: int = 10) -> Keyed:
    """How many rows of a session came for one of the last buckets, and how many too late; said when the session is over."""

    def fold(key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, Rows]:
        _, bucket, now = row
        latest, kept, dropped = state or (now, 0, 0)
        latest = max(latest, now)
        late = bucket < latest - buckets
        return (latest, kept + (not late), dropped + late), []

    return Keyed(("session_date",), ("bucket", "now"), "session_date date, kept long, dropped long", "now long, kept long, dropped long", fold, lambda key, s: day_end(key[0]), lambda key, s: [s[1:]])


def backfilled() -> Keyed:
    """A session's bars, said when it is over: history's where there is one, else the live ones, each with where it is from."""

    def fold(key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, Rows]:
        _, slot, close, source = row
        slots, closes, live, history = state or ([], [], [], [])
        slots, closes, live, history = list(slots), list(closes), list(live), list(history)
        if slot not in slots:
            for x, v in ((slots, slot), (closes, close), (live, False), (history, False)):
                x.append(v)
        k = slots.index(slot)
        if source == "history" or not history[k]:
            closes[k] = close
        live[k], history[k] = live[k] or source == "live", history[k] or source == "history"
        return (slots, closes, live, history), []

    def close(key: tuple, s: tuple) -> Rows:
        return [(int(slot), float(v), "LIVE" if not h else "REPLACED" if w else "FILLED") for slot, v, w, h in zip(*s, strict=True)]

    state = "slots array<int>, closes array<double>, live array<boolean>, history array<boolean>"
    return Keyed(("symbol", "session_date"), ("slot", "close", "source"), "symbol string, session_date date, slot int, close double, origin string", state, fold, lambda key, s: day_end(key[1]), close)


def freshness(seconds: int = 86400) -> Keyed:
    """When a subject became fresh, by whichever source, and when it went stale: so many seconds without a receipt."""

    def fold(key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, Rows]:
        return (row[0],), [(row[0], "FRESH")] if state is None else []

    return Keyed(("subject",), (), "subject string, moment long, status string", "at long", fold, lambda key, s: s[0] + seconds, lambda key, s: [(s[0] + seconds, "STALE")])


def sessions(ticks: DataFrame, gap: str, grace: str = "3 seconds") -> DataFrame:
    """Runs of a user's ticks without a gap, each said once the watermark has passed its end."""
    some = ticks.withWatermark("ts", grace).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return some.select("user_id", F.col("first").cast("timestamp_ntz").alias("session_start"), F.col("last").cast("timestamp_ntz").alias("last_tick"), "n")
