"""Stateful streams against the same operators over a batch, file after file; states that go; and replays against steps on cut data."""

import datetime as dt

import pytest

from tests.test_selection import DAY0, SCALE, a_market, tables
from tickloom.operators.steps import step_sql
from tickloom.plans.dialect import Operator
from tickloom.streaming import keyed, state

START = int(dt.datetime(2026, 1, 5, tzinfo=dt.timezone.utc).timestamp())

CASES = {
    "cooldown": (keyed.cooldown(600), "subject string, severity int", lambda k: (f"s{k % 3}", 1 + k * 7 % 3)),
    "buildup": (keyed.buildup(7200), "underlying string, price double, oi double", lambda k: (f"u{k % 2}", float(k * 37 % 11), float(k * 53 % 7))),
    "sampler": (keyed.sampler(), "session_date date, counter long", lambda k: (None, 5 * k % 90)),
    "pending": (keyed.pending(4), "session_date date, bucket int, now int", lambda k: (None, k - 9 * (k % 5 == 2), k)),
    "backfilled": (keyed.backfilled(), "symbol string, session_date date, slot int, close double, source string", lambda k: ("a", None, k % 13, float(k), "history" if k % 3 == 1 else "live")),
    "freshness": (keyed.freshness(5000), "subject string", lambda k: (f"s{k * k % 4}",)),
}


def run_once(stream, path):
    """All that is there goes through; (rows of the sink, rows of state left)."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/rows", format="parquet")
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return left[-1] if left else None


@pytest.mark.parametrize("name", CASES)
def test_a_stream_says_what_the_batch_says_of_each_prefix(spark, tmp_path, name):
    operator, kind, row = CASES[name]
    kind, path, rows = f"at timestamp, {kind}", str(tmp_path), []
    stream = lambda: operator.stream(spark.readStream.schema(kind).parquet(f"{path}/in/*"), "at", "60 seconds")

    def arrive(part, some):
        spark.createDataFrame(some, kind).coalesce(1).write.parquet(f"{path}/in/{part}")
        rows.extend(some)

    def one(k, seconds):
        at = dt.datetime.fromtimestamp(START + seconds, dt.timezone.utc)
        return (at, *(at.date() if v is None else v for v in row(k)))

    for part in range(3):  # a day and a half in three files, each in order of time after the one before
        arrive(part, [one(k, 1800 * k) for k in range(24 * part, 24 * part + 24)])
        left = run_once(stream(), path)
        got = sorted(map(str, spark.read.parquet(f"{path}/rows").collect()))
        assert got == sorted(map(str, operator.batch(spark.createDataFrame(rows, kind), "at", 60).collect())), part
        assert left <= 4
    arrive(9, [one(500, 1800 * 20_000)])
    assert run_once(stream(), path) == 1  # all but the state of the last row has gone
    assert sorted(map(str, spark.read.parquet(f"{path}/rows").collect())) == sorted(map(str, operator.batch(spark.createDataFrame(rows, kind), "at", 60).collect()))
    assert len(got) > 0 or name in ("sampler", "pending", "backfilled")


def test_a_finished_session_leaves_no_state(spark, tmp_path):
    kind = "symbol string, session_date date, event_id bigint, received bigint, traded bigint, total bigint, size bigint, price double"
    path, day = str(tmp_path), dt.date(2026, 1, 5)
    stream = lambda: state.judged_stream(spark.readStream.schema(kind).parquet(f"{path}/in/*"), 60)
    rows = [("a", day, k, START + 60 * k, START + 60 * k, k, 1, 1.0) for k in range(1, 50)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{path}/in/0")
    assert run_once(stream(), path) == 1
    spark.createDataFrame([("b", day + dt.timedelta(5), 99, START + 5 * 86400, START + 5 * 86400, 1, 1, 1.0)], kind).write.parquet(f"{path}/in/1")
    assert run_once(stream(), path) == 1 and spark.read.parquet(f"{path}/rows").count() == 50


def test_sessions_of_a_user_end_with_a_gap(spark, tmp_path):
    rows = [(1, dt.datetime(2026, 1, 5, 0, m)) for m in (0, 5, 9, 30, 31)] + [(2, dt.datetime(2026, 1, 5, 3, 0))]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    run_once(keyed.sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in"), "10 minutes"), str(tmp_path))
    assert sorted((r.session_start.minute, r.last_tick.minute, r.n) for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == [(0, 9, 3), (30, 31, 2)]


def test_a_replay_is_the_step_on_data_cut_at_each_slot(spark):
    bars, facts, index = a_market(3, days=4, symbols=5)
    day = DAY0 + dt.timedelta(3)
    with_ = {"least": 6, "least_today": 3, "unusual": 1.5, "extreme": 2.5, "complete": 0.2}

    def run(slot, upto=99):
        cut = lambda d, t: d < day or d == day and t <= upto
        some = ([b for b in bars if cut(b[1], b[2])], [f for f in facts if cut(f[0], f[3])], [i for i in index if cut(i[1], i[2])])
        rows = Operator("s", step_sql(SCALE, slot, **with_))(**tables(spark, *some, symbols=5)).collect()
        return {(r.session_date, r.symbol, r.slot, r.measure): r.asDict() for r in rows}

    whole = run(None)
    assert {"HISTORICAL", "INTRADAY", "INSUFFICIENT"} == {r["tier"] for r in whole.values()} and any(r["event_id"] for r in whole.values())
    for slot in range(SCALE.slots):
        part = run(slot, slot)
        assert len(part) == 4 * 5 * 4 and all(whole[k] == v for k, v in part.items() if k[0] == day), slot
