"""Tests of what the third round's findings named, on small tables against the registered SQL."""

import datetime as dt
import math
import random

import duckdb
import pytest

from tickloom.functions import market_state
from tickloom.functions.trailing import trailing_middles
from tickloom.plans import catalog, dialect, market_states
from tickloom.plans.dialect import spelled
from tickloom.sources import archive
from tickloom.streaming import keyed

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(rows):
    """Rows of (user, day, hour, price) as events, each of size 5."""
    return [(k, dt.datetime(2024, 1, 1 + d, h, 0, 0, k % 1000), u, ("click", "view", "error")[k % 3], float(p), '{"k": 5}') for k, (u, d, h, p) in enumerate(rows)]


@pytest.fixture
def agrees(spark, same, tmp_path):
    """Asks whether a query over events equals its SQL, and returns Spark's rows."""

    def ask(name, rows):
        spark.createDataFrame(events(rows), EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        got = catalog.queries()[name](spark, str(tmp_path)).toPandas()
        con = duckdb.connect()
        con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = con.execute(catalog.oracle_sql()[name]).df()
        assert same(got) == same(want)
        return got

    return ask


@pytest.mark.parametrize("name", ["win_03", "win_04", "win_21", "win_24", "eng_10"])
def test_prices_of_zero_are_no_error(agrees, name):
    prices = {(1, 3): 0.0, (2, 5): 0.0}
    agrees(name, [(u, d, h, prices.get((u, d), 10 + (7 * u + 3 * d + h) % 11)) for u in range(4) for d in range(14) for h in (1, 2, 4, 9)])
    if name in ("win_03", "win_04", "eng_10"):
        agrees(name, [(u, 0, h, 0.0 if h == 6 else 5 + h) for u in range(3) for h in range(14)])


def test_outcomes_down_to_zero_are_infinite(agrees):
    rows = [(u, d, h, 0.0 if (u, d, h) == (1, 1, 14) else 10 + (5 * u + d + h) % 7) for u in range(12) for d in range(3) for h in range(24)]
    got = agrees("eng_24", rows)
    assert (got["mae"] == -math.inf).sum() > 0


@pytest.mark.parametrize("name", ["eng_14", "eng_15"])
def test_market_states_after_a_price_of_zero_are_no_numbers(agrees, name):
    zeros = {(1, 3, 14), (4, 6, 9), (5, 6, 9), (5, 6, 10), (0, 7, 0), (2, 7, 23)}
    got = agrees(name, [(u, d, h, 0.0 if (u, d, h) in zeros else 10 + (7 * u * u + 3 * d * d + 5 * h * h + u * d * h) % 23 + (24 * d + h) / 1e3) for u in range(12) for d in range(9) for h in range(24)])
    if name == "eng_14":
        at = got[(got["session_date"].astype(str) == "2024-01-04") & (got["slot"] == 16)]
        assert at["stocks"].item() == 12 and at["breadth_window"].item() > 0 and math.isnan(at["mean_correlation"].item())


def test_returns_that_cancel_are_added_slot_by_slot(spark):
    rng = random.Random(3)
    ways = [[rng.randint(1000, 9999) / 100 for _ in range(8)] for _ in range(200)]
    rows = [(dt.date(2024, 1, 1), k, i, k % 3, math.log(p / (way[k - 1] if k else way[7])), 1.0, 0.0) for i, way in enumerate(ways) for k, p in enumerate(way)]
    panel = spark.createDataFrame(rows, "session_date date, slot int, symbol int, sector int, r double, value double, market double")
    at = market_state.market_states(panel, market_state.Sizes(window=8, stocks=5)).where("slot = 7").first()
    moved = [0.0] * len(ways)
    for r in rows:
        moved[r[2]] += r[4]
    assert at.breadth_window == at.breadth_session == sum(m > 0 for m in moved) / len(ways)
    assert [market_states.c_ln(x) for x in (1.1, 0.0, -1.0, math.inf, None)][:2] == [math.log(1.1), -math.inf]


def test_a_stock_that_moves_evenly_has_no_correlation_and_is_no_error(agrees):
    agrees("eng_04", [(u, d, 3, 10.0 + d if u % 7 == 0 else 10 + (13 * u * u + 7 * d * d + 5 * u * d + u * d * d) % 17) for u in range(16) for d in range(14)])


def test_equal_values_are_placed_by_symbol(spark):
    daily = [(1, 0.1, 1), (1, 0.2, 1), (1, 0.3, 1), (2, 0.3, 1), (2, 0.2, 1), (2, 0.1, 1), (3, 0.2, 1), (3, 0.1, 1), (3, 0.3, 1)]
    for rows in (daily, daily[::-1]):
        frame = spark.createDataFrame(rows, "symbol long, close double, volume long").selectExpr("*", "close as open").coalesce(1)
        got = catalog.operators()["agg_46"](daily=frame).collect()
        assert sorted((r.place, r.symbol) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_candles_of_a_price_of_zero_are_counted(agrees):
    agrees("src_12", [(0, 0, h, 0.0 if h in (1, 6) else 10 + h) for h in range(24) for _ in range(3)])


def test_no_frame_of_a_ranking_is_made_anew_for_every_row():
    for name in ("eng_26", "bkt_09", "eng_42"):
        assert "unbounded following" not in spelled(catalog.operators()[name].sql, 0)


def test_the_middle_sorts_once(spark):
    text = spelled("@middle(x)", 0)
    assert text.count("sort_array") == 1
    rows = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in rows.selectExpr(text).collect()] == [2.0, 2.5, None, None]


def test_middles_of_days_before_are_found_in_one_pass(spark):
    rng = random.Random(5)
    cells = [None if k == 3 else k for k in range(6) for _ in range(11)]
    rows = [(k, d % 11, rng.choice([None, math.inf, math.nan, 1.0, 2.0, 3.5, 7.0, -4.0, 9.25])) for d, k in enumerate(cells)]
    frame = spark.createDataFrame(rows, "symbol int, day int, x double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {(r.symbol, r.day): (r.n_x, r.median_x, r.mad_x) for r in trailing_middles(frame, "symbol", "day", ["x"], 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    frame.createOrReplaceTempView("trailing_rows")
    text = "with g as (select symbol, day, @gathered(x) over (partition by symbol order by day rows between 4 preceding and 1 preceding) as past from trailing_rows), m as (select g.*, @middle(past) as m from g) select symbol, day, @length(past) as n, m, @middle(@deviations(past, m)) as mad from m"
    want = {(r.symbol, r.day): (r.n, r.m, r.mad) for r in spark.sql(spelled(text, 0)).collect()}
    assert len(got) == 66 and {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}


@pytest.mark.parametrize("name", ["eng_06", "eng_08", "eng_20"])
def test_no_list_of_days_before_is_made_for_every_day(agrees, spark, name, tmp_path):
    agrees(name, [(u, d, h, 10 + (7 * u * u + 3 * d * d + 5 * h + u * d * d) % 23 * (1 + (u + d) % 9 // 8 * 6)) for u in range(9) for d in range(20) for h in (1, 5, 9)])
    plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_tasks_of_dealt_rows_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(dialect, "TASK_ROWS", 100)
    rows = spark.range(1000).selectExpr("id as l_partkey")
    assert dialect.dealt(rows, "l_partkey").rdd.getNumPartitions() == 10
    assert all(catalog.operators()[name].dealt for name in ("agg_42", "str_07", "eng_19"))


def test_flat_feed_items_are_read_as_parsed_ones(spark):
    flat = "<item><title> A b </title><link>http://x/1</link><guid>g1</guid><title>second</title></item>"
    others = "<item><title>R &amp; D</title><link><![CDATA[http://x/2]]></link></item>\n<item>\n<title><b>T</b>x</title><pubDate>some day</pubDate></item><item></item>"
    rows = archive.feed_items(spark.createDataFrame([(f"<rss>{flat}{others}</rss>",)], "xml string"), "news", "F").collect()
    assert [(r.id, r.headline, r.url, r.published_at_raw) for r in rows] == [
        ("g1", "A b", "http://x/1", None), ("http://x/2", "R & D", "http://x/2", None), ("Tx", "Tx", "", "some day"), ("", "", "", None),
    ]


def test_states_by_bucket_say_what_states_by_key_do(spark, tmp_path):
    kind = "subject string, at timestamp, severity int"
    parts = [[(f"s{k % 9}", dt.datetime(2024, 1, 1, 2 * n + k % 2, (7 * k) % 60), k % 4) for k in range(30)] for n in range(3)]
    operator, path = keyed.cooldown(1800), str(tmp_path)
    stream = lambda: operator.bucketed(spark.readStream.schema(kind).parquet(f"{path}/in/*"), "at", "60 seconds", 3)
    for n, rows in enumerate(parts):  # a stop between two parts: states are read again
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{path}/in/{n}")
        stream().writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows", format="parquet").awaitTermination()
    whole = operator.batch(spark.createDataFrame([r for rows in parts for r in rows], kind), "at", 60)
    assert sorted(map(str, spark.read.parquet(f"{path}/rows").collect())) == sorted(map(str, whole.collect()))
