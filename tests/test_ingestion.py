"""Versioned tables under two writers and crashes, binary streams, gzip chains, blocks, and history fetched with failures."""

import gzip
import json
import os

import numpy as np
import pytest

from tickloom.sources import archive, binary_stream, bootstrap, files, sinks
from tickloom.sources.log import Conflict, Log


def test_of_two_writers_of_a_version_one_is_told(spark, tmp_path):
    one, two = Log(spark, str(tmp_path)), Log(spark, str(tmp_path))
    assert one.commit(0, {"a": {"path": "x"}}) == 1
    with pytest.raises(Conflict):
        two.commit(0, {"b": {"path": "y"}})
    assert two.snapshot() == (1, {"a": {"path": "x"}})
    assert two.commit(1, {"b": {"path": "y"}}) == 2 and one.commit(2, {"c": {"path": "z"}}, whole=True) == 3
    assert two.snapshot() == (3, {"c": {"path": "z"}})
    assert sorted(x for x in os.listdir(f"{tmp_path}/_log") if not x.startswith(".")) == [f"{k:020d}.json" for k in (1, 2, 3)]


def test_a_log_names_the_whole_table_now_and_then(spark, tmp_path, monkeypatch):
    from tickloom.sources import log

    monkeypatch.setattr(log, "WHOLE", 3)
    x = Log(spark, str(tmp_path))
    for k in range(7):
        x.commit(k, {str(k % 5): {"path": str(k)}})
    assert x._read(6)["whole"] and not x._read(7)["whole"]
    for k in range(1, 6):
        os.remove(f"{tmp_path}/_log/{k:020d}.json")
    assert x.snapshot() == (7, {"0": {"path": "5"}, "1": {"path": "6"}, "2": {"path": "2"}, "3": {"path": "3"}, "4": {"path": "4"}})


def test_two_writers_of_one_key_leave_one_row(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    written, root, between = Log.written, str(tmp_path), []

    def slow(self, df, by=None):
        path = written(self, df, by)
        if not between:  # another writer comes in between this one's look and its version
            between.append(1)
            assert sinks.add_new(spark.createDataFrame([(2, "other"), (3, "c")], "id long, v string"), root, "id").count() == 2
        return path

    monkeypatch.setattr(Log, "written", slow)
    assert [tuple(r) for r in sinks.add_new(rows, root, "id").collect()] == [(1, "a")]
    assert sorted(map(tuple, Log(spark, root).table().collect())) == [(1, "a"), (2, "other"), (3, "c")]
    assert len(Log(spark, root).orphans()) == 1


def test_a_crash_leaves_the_old_table_or_the_new_one(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/day"
    old, new = (spark.createDataFrame([(v,)], "v string") for v in ("old", "new"))
    sinks._replaced(old, root)
    for name in ("written", "commit", "_put"):
        real = getattr(Log, name)
        for when in ("before", "after"):

            def broken(self, *args, real=real, when=when, **kw):
                if when == "after":
                    real(self, *args, **kw)
                raise KeyboardInterrupt

            monkeypatch.setattr(Log, name, broken)
            with pytest.raises(KeyboardInterrupt):
                sinks._replaced(new, root)
            monkeypatch.setattr(Log, name, real)
            now = [r.v for r in Log(spark, root).table().collect()]
            assert now == (["new"] if when == "after" and name != "written" else ["old"])
            sinks._replaced(old, root)
    assert [r.v for r in Log(spark, root).table().collect()] == ["old"]


def test_days_are_counted_in_the_log(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02", k) for k in range(3)] + [("2024-01-03", 9)], "session_date string, k int")
    assert {tuple(r) for r in sinks.write_days(rows, str(tmp_path)).collect()} == {("2024-01-02", 3, True), ("2024-01-03", 1, True)}
    assert {tuple(r) for r in sinks.write_days(rows.where("k != 1"), str(tmp_path)).collect()} == {("2024-01-02", 2, False), ("2024-01-03", 1, True)}
    assert Log(spark, str(tmp_path)).table().count() == 4


def test_a_derived_table_is_made_once_for_its_settings_and_inputs(spark, tmp_path):
    made, table = [], spark.createDataFrame([(1, 2.0), (2, 3.0)], "a int, b double")

    def ask(t, settings="s"):
        return sorted(map(tuple, sinks.derived([t], settings, str(tmp_path), lambda: made.append(1) or t.selectExpr("sum(b) as b")).collect()))

    assert ask(table) == ask(table.repartition(2)) == [(5.0,)] and len(made) == 1
    assert ask(table, "other") == [(5.0,)] and len(made) == 2
    assert ask(table.where("a = 1")) == [(2.0,)] and ask(table) == [(5.0,)] and len(made) == 3


def member(lines):
    return gzip.compress("\n".join(lines).encode() + b"\n", mtime=0)


def test_a_torn_last_member_is_left_out_and_other_damage_is_an_error(spark, tmp_path):
    columns = ("a", "b")
    good = member(["a,b", '1,"x,y"', "2,z"]) + member(["3,w"])
    torn = member(["a,b", "4,v"]) + member([f"{k},{k * k}" for k in range(500)])[:-40]
    for name, data in (("one", good), ("two", torn)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv.gz").write_bytes(data)
    assert sorted(map(tuple, archive.chain_files(spark, f"{tmp_path}/one", columns).collect())) == [("1", "x,y"), ("2", "z"), ("3", "w")]
    assert [tuple(r) for r in archive.chain_files(spark, f"{tmp_path}/two", columns).collect()] == [("4", "v")]
    for bad in (good[:30] + b"\x00\xff\x00" + good[33:], member(["a,b", "1,2,3"]), b"no gzip at all"):
        (tmp_path / "one" / "f.csv.gz").write_bytes(bad)
        with pytest.raises(Exception, match="broken member|fields instead of"):
            archive.chain_files(spark, f"{tmp_path}/one", columns).collect()


def test_blocks_of_a_file_in_many_parts(spark, tmp_path):
    lines = []
    for k in range(200):
        lines += ["a,b", *[f"{k},{j}" for j in range(20)], f"{archive.END} {k} 20"]
    (tmp_path / "f.txt").write_text("\n".join([*lines, "a,b", "900,1", "90"]))
    (tmp_path / "g.txt").write_text("a,b\n1,2\n")  # no block of it is complete
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = archive.blocks(spark, str(tmp_path), ("a", "b"))
        assert rows.rdd.getNumPartitions() > 3
        assert sorted((int(r.a), int(r.b)) for r in rows.collect()) == [(k, j) for k in range(200) for j in range(20)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def stream_rows(day, n):
    t = day * 86400 - 19800 + 9 * 3600 + 60 * np.arange(n)
    return np.column_stack([t, *(np.arange(n) + k for k in range(4)), np.full(n, day)]).astype(float)


def test_binary_streams(spark, tmp_path):
    three = [(f"I{k}", "EQ", f"S{k % 2}", "OK" if k else "PART", np.vstack([stream_rows(d, 10 + k) for d in (19000, 19001, 19005)])) for k in range(3)]
    data = b"".join(binary_stream.encoded(iter(three), 1, block=7))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.stream").write_bytes(data)
    want = sorted((name, kind, sector, status, int((r[0] + 19800) // 86400), *map(float, r)) for name, kind, sector, status, rows in three for r in rows)
    got = binary_stream.read_stream(spark, f"{tmp_path}/s")
    assert sorted(map(tuple, got.collect())) == want
    # A filter chooses instruments and days, and blocks of others aren't read.
    some = got.where("instrument = 'I1' and day >= 19005")
    assert sorted(map(tuple, some.collect())) == [r for r in want if r[0] == "I1" and r[4] >= 19005]
    reader = binary_stream.StreamReader({"path": f"{tmp_path}/s"})
    whole = len(reader.chosen())
    left = list(reader.pushFilters([binary_stream.EqualTo(("instrument",), "I1"), binary_stream.GreaterThanOrEqual(("day",), 19005)]))
    assert len(left) == 1 and whole == sum(-(-3 * (10 + k) // 7) for k in range(3)) and len(reader.chosen()) == 2
    assert reader.read(reader.partitions()[0]).__next__().column(4).to_pylist()[-1] == 19005
    assert binary_stream.read_stream(spark, f"{tmp_path}/s", rowsPerPartition=20).rdd.getNumPartitions() > 3
    # gzip, and torn at any place: whole instruments stay.
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.stream").write_bytes(gzip.compress(data))
    assert sorted(map(tuple, binary_stream.read_stream(spark, f"{tmp_path}/z").collect())) == want
    done = [data.index(b"\n", data.index(f"DONE I{k}".encode())) + 1 for k in range(3)]
    for cut in (5, 40, done[0] - 30, done[0] + 2, done[0] + 200, done[1] - 3, done[2] - 9, len(data) - 2):
        (tmp_path / "s" / "a.stream").write_bytes(data[:cut])
        _, there = binary_stream.index(f"{tmp_path}/s/a.stream")
        assert [x.name for x in there] == [f"I{k}" for k in range(len(there))]
        assert len(there) == sum(cut >= d for d in done)
    (tmp_path / "s" / "a.stream").write_bytes(data[: done[0] + 200])
    with pytest.raises(EOFError):
        binary_stream.index(f"{tmp_path}/s/a.stream", "fail")


def test_history_is_fetched_once_whatever_fails(spark, tmp_path, monkeypatch):
    days = [f"2024-01-{d:02d}" for d in range(1, 11)]
    calendar, symbols = spark.createDataFrame([(d,) for d in days], "session_date string"), spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    calls, broken = f"{tmp_path}/calls", f"{tmp_path}/broken"
    os.makedirs(calls)

    def fetch(symbol, first, last):
        if os.path.exists(broken) and symbol == "C" and first > "2024-01-05":
            raise OSError("the line is dead")
        with open(f"{calls}/{symbol}-{first}-{os.getpid()}-{os.urandom(4).hex()}", "w"):
            pass
        return [(d, m, 1.0, 2.0, 0.5, 1.5, float(m)) for d in days if first <= d <= last for m in range(3)]

    def run(name):
        return bootstrap.Bootstrap(spark, f"{tmp_path}/{name}", f"{tmp_path}/{name}/archive", span_days=3, workers=2)

    def table(x):
        return sorted(map(tuple, Log(spark, x.archive).table().select("session_date", "symbol", "minute", "open", "volume").collect()))

    calm = run("calm")
    assert calm.run(calendar, symbols, 8, fetch).count() == 8
    asked = len(os.listdir(calls))
    assert asked == 6 and len(table(calm)) == 8 * 3 * 3 and calm.run(calendar, symbols, 8, fetch) is None and len(os.listdir(calls)) == asked
    for f in os.listdir(calls):
        os.remove(f"{calls}/{f}")
    x = run("rough")
    open(broken, "w").close()
    with pytest.raises(Exception, match="the line is dead"):  # fails within the fetch
        x.run(calendar, symbols, 8, fetch)
    os.remove(broken)
    requests = x.plan(calendar, symbols, 8)
    fetched = x.status(requests)["fetched"]
    assert 0 < fetched < asked and not Log(spark, x.archive).snapshot()[1]
    with pytest.raises(RuntimeError, match="no answer"):
        x.assemble(requests, days)
    real = bootstrap.write_days
    for stage in ("before", "after"):  # fails before and after days are written

        def write(rows, root, stage=stage):
            if stage == "after":
                real(rows, root)
            raise KeyboardInterrupt

        monkeypatch.setattr(bootstrap, "write_days", write)
        with pytest.raises(KeyboardInterrupt):
            run("rough").run(calendar, symbols, 8, fetch)
    monkeypatch.setattr(bootstrap, "write_days", real)
    assert run("rough").run(calendar, symbols, 8, fetch) is None  # the days were there already
    names = [f.rsplit("-", 2)[0] for f in os.listdir(calls)]
    assert table(x) == table(calm) and len(names) == len(set(names)) == asked
    assert run("rough").run(calendar, symbols, 10, fetch).count() == 2
    assert json.loads(gzip.decompress(files.read(files.listed(f"{tmp_path}/rough/answers")[0][0])).splitlines()[0])["symbol"] in "ABC"
