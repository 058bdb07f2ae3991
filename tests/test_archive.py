"""Readers and writers on hand-made files: torn blocks, fuller days, conflicts, wrong lists."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.functions import indicators, registry, response
from tickloom.sources import archive, sinks
from tickloom.sources.log import Log
from tickloom.streaming import state


def test_blocks_end_at_the_last_marker(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\nx,1\ny,2\n#END 5 2\nk,v\nz,3\n#END 6 1\nw,4\nhalf")
    (tmp_path / "b.csv").write_text("k,v\nnever,9\n")
    got = archive.blocks(spark, str(tmp_path), ("k", "v")).orderBy("position").select("k", "v").collect()
    assert [tuple(r) for r in got] == [("x", "1"), ("y", "2"), ("z", "3")]


def test_a_fuller_day_stays(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = lambda n, day: spark.createDataFrame([(day, k) for k in range(n)], "session_date string, k int")
    said = [sinks.write_days(x, root).collect() for x in (rows(5, "2024-01-02"), rows(3, "2024-01-02"), rows(4, "2024-01-03"), rows(5, "2024-01-02"))]
    assert [r[0].written for r in said] == [True, False, True, True]
    assert {(str(r.session_date), r["count"]) for r in Log(spark, root).table().groupBy("session_date").count().collect()} == {("2024-01-02", 5), ("2024-01-03", 4)}


def test_decisions_are_written_once(spark, tmp_path):
    root = str(tmp_path / "decisions")
    one = spark.createDataFrame([("d1", "h1"), ("d2", "h2")], "day string, digest string")
    assert sinks.save_once(one, root, "day", "digest").count() == 2
    assert sinks.save_once(one, root, "day", "digest").count() == 0
    with pytest.raises(PySparkException):
        sinks.save_once(spark.createDataFrame([("d1", "other")], "day string, digest string"), root, "day", "digest").count()


def test_events_are_added_once(spark, tmp_path):
    root = str(tmp_path / "events")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "event_id string, x int")
    assert sinks.add_new(rows, root, "event_id").count() == 2
    assert sinks.add_new(rows, root, "event_id").count() == 0
    assert Log(spark, root).table().count() == 2


def test_wrong_lists_are_errors(spark):
    lists = spark.createDataFrame([("NSE", "EQUITY", ["a", " A "])], "exchange string, instrument string, symbols array<string>")
    with pytest.raises(PySparkException):
        archive.universe(lists).collect()
    assert [r.symbol for r in archive.universe(lists.withColumn("symbols", F.array(F.lit("b "), F.lit("c")))).collect()] == ["B", "C"]
    master = spark.createDataFrame([("NSE", "EQUITY", "A", "7", 1)], "exchange string, instrument string, trading_symbol string, security_id string, position int")
    assert archive.master_ids(master, spark.createDataFrame([("a",)], "symbol string")).collect()[0].security_id == "7"
    with pytest.raises(PySparkException):
        archive.master_ids(master, spark.createDataFrame([("b",)], "symbol string")).collect()


def test_arrays_of_different_lengths_are_an_error(spark):
    kind = ", ".join(f"{c} array<string>" for c in ("timestamp", *archive.FIELDS))
    with pytest.raises(PySparkException):
        archive.array_candles(spark.createDataFrame([(["60"], ["1"], ["1"], ["1"], ["1"], [])], kind)).collect()


def test_ticks_in_a_stream_are_judged_as_in_a_batch(spark, tmp_path):
    rows = [("a", "2024-01-02", k, 1000 + 60 * k, 1000 + 60 * (k - 5 * (k % 7 == 3)), 10 * k - 13 * (k % 5 == 4), 1, float(k % 3)) for k in range(60)]
    kind = "symbol string, session_date date, event_id bigint, received bigint, traded bigint, total bigint, size bigint, price double"
    ticks = spark.createDataFrame(rows, kind.replace("session_date date", "session_date string")).withColumn("session_date", F.to_date("session_date"))
    ticks.coalesce(1).write.parquet(f"{tmp_path}/t/part1.parquet")
    from tickloom.streaming import replay

    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/t/part1.parquet")
    got = sorted(map(str, replay.replayed(state.judged_stream(stream, 60)).collect()))
    assert got == sorted(map(str, state.judged_batch(ticks, 60).collect()))
    verdicts = {r.verdict for r in state.judged_batch(ticks, 60).collect()}
    assert {"trade", "late", "volume_regressed"} <= verdicts
    # What late ticks carry shows in the next trade: the volumes add up to the last total taken.
    total = state.judged_batch(ticks, 60).agg(F.sum("delta")).head()[0]
    assert total == max(r[5] for r in rows)


def test_indicator_settings_and_gaps(spark):
    bars = spark.createDataFrame([("x", k, 10.0 + k, 9.0 + k, None if k == 30 else 9.5 + k) for k in range(40)], "s string, k int, high double, low double, close double")
    got = [r.ema_fast for r in indicators.indicator_series(bars, ["s"], ["k"], ("ema_fast",), ema_fast=3).orderBy("k").collect()]
    assert got[:2] == [None, None] and got[2] == 10.5 and got[29] is not None and got[30:] == [None] * 10


def test_clusters_follow_the_running_mean(spark):
    points = spark.createDataFrame([("x", k, p) for k, p in enumerate((100.0, 101.0, 102.2, 110.0))], "s string, k int, p double")
    got = registry.clusters(points, "s", "k", "p", 1.5).orderBy("price").collect()
    assert [(round(r.price, 3), r.n, r.last) for r in got] == [(100.5, 2, 1), (102.2, 1, 2), (110.0, 1, 3)]


def test_response_finds_planted_lags(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    m = rng.normal(size=400)
    rows = [(s, k, float(a * m[k] + b * m[k - 1] + 0.01 * rng.normal()), float(m[k]), float(m[k - 1])) for s, a, b in (("x", 0.6, 0.4), ("y", 1.0, 0.0)) for k in range(1, 400)]
    got = {r.s: r for r in response.fitted(spark.createDataFrame(rows, "s string, k int, y double, m0 double, m1 double"), "s", "y", ["m0", "m1"], 1e-3).collect()}
    assert abs(got["x"].m0 - 0.6) < 0.01 and abs(got["x"].m1 - 0.4) < 0.01 and abs(got["y"].m1) < 0.01 and got["x"].sigma < 0.02
