import datetime as dt

from tickloom.streaming import replay
from tickloom.streaming import ticks as t

START = dt.datetime(2026, 1, 5, 10, 0, 0)


def arrive(spark, folder, k, rows):
    """A file of ticks (seconds from START, symbol, price, size)."""
    rows = [(s, START + dt.timedelta(seconds=x), p, f'{{"k": {n}}}') for x, s, p, n in rows]
    spark.createDataFrame(rows, "event_type string, ts timestamp, value double, props string").coalesce(1).write.parquet(f"{folder}/{k}")


def test_bars_close_once_and_late_ticks_are_dropped(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "out")
    stream = lambda: t.closed_bars(t.tick_stream(spark, f"{folder}/*", "*.parquet"))
    arrive(spark, folder, 0, [(1, "a", 10.0, 1), (50, "a", 12.0, 2), (20, "b", 5.0, 1), (70, "a", 11.0, 4)])
    first = {(r.symbol, r.close, r.volume) for r in replay.followed(stream(), lambda x: x, path).collect()}
    assert first == {("a", 12.0, 3), ("b", 5.0, 1)}
    # One tick of the closed minute comes too late; the second minute closes.
    arrive(spark, folder, 1, [(30, "a", 99.0, 50), (200, "a", 13.0, 1)])
    rows = replay.followed(stream(), lambda x: x, path).collect()
    assert sorted((r.symbol, r.open, r.high, r.low, r.close, r.volume, r.n) for r in rows) == [
        ("a", 10.0, 12.0, 10.0, 12.0, 3, 2), ("a", 11.0, 11.0, 11.0, 11.0, 4, 1), ("b", 5.0, 5.0, 5.0, 5.0, 1, 1),
    ]
    # Nothing new: nothing is done twice.
    assert replay.followed(stream(), lambda x: x, path).count() == 3
