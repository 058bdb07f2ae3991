"""Tests of what the fourth round's findings named, on small tables against the registered SQL."""

import math
import random

import duckdb
import pytest

from tests.test_findings_r03 import EVENTS, agrees, events  # noqa: F401
from tickloom.plans import catalog


@pytest.fixture
def repeats(spark, same, tmp_path):
    """Asks whether a query over whole events equals its SQL with one thread (with more, DuckDB's own order changes), and returns Spark's rows."""

    def ask(name, rows):
        spark.createDataFrame(rows, EVENTS).orderBy("ts").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        got = catalog.queries()[name](spark, str(tmp_path)).toPandas()
        con = duckdb.connect(config={"threads": 1})
        con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
        assert same(got) == same(con.execute(catalog.oracle_sql()[name]).df())
        return got

    return ask


@pytest.mark.parametrize("odd", [math.inf, -math.inf, math.nan, 1e25])
def test_values_beyond_decimals_have_their_place(agrees, odd):  # noqa: F811
    got = agrees("agg_46", [(u, d, 3, odd if (u, d) == (2, 1) else 10.0 + u) for u in range(5) for d in range(3)])
    assert got.set_index("symbol")["place"][2] == (5 if odd == -math.inf else 1)


def test_values_below_eight_decimals_have_their_place(agrees):  # noqa: F811
    got = agrees("agg_46", [(u, d, 3, (1 + u) * 1e-12) for u in range(5) for d in range(3)])
    assert sorted(zip(got["place"], got["symbol"])) == [(5 - u, u) for u in reversed(range(5))]


def test_sums_that_cancel_are_added_in_the_order_of_days(repeats):
    rng = random.Random(7)
    rows, signs = [], {}
    for u in range(150):
        moves = [(rng.randint(1, 900000), rng.randint(1, 900000)) for _ in range(4)]
        back = sum(b - a for a, b in moves)
        moves.append((max(back, 0) + 1, max(-back, 0) + 1))
        x = 0.0
        for k, (a, b) in enumerate(moves):
            rows += [(u, 7 * k, 1, a / 100), (u, 7 * k, 9, b / 100)]
            x += b / 100 - a / 100
        signs[u] = x > 0
    assert 20 < sum(signs.values()) < 130
    got = repeats("bkt_17", events(rows))
    assert {r.symbol: r.good == 1 for r in got.itertuples()} == signs
    assert {r.symbol: r.verdict == "UNPROVEN" for r in got.itertuples()} == signs


def test_a_missing_symbol_is_last_among_equal_ones(agrees):  # noqa: F811
    got = agrees("agg_46", [(u, d, 3, 10.0) for u in (1, None, 0) for d in range(3)])
    assert got.sort_values("place")["symbol"].tolist()[:2] == [0, 1]


@pytest.mark.parametrize("name", ["agg_46", "bkt_17"])
def test_missing_prices_of_a_day_are_passed_over(repeats, name):
    rows = events([(u, d, h, 10 + (7 * u + 5 * d + 3 * h) % 11 + h / 10) for u in range(6) for d in range(12) for h in (1, 5, 9)])
    repeats(name, [(*r[:4], None if (r[2], r[1].day, r[1].hour) in {(2, 4, 9), (3, 5, 1), (4, 6, 1), (4, 6, 5), (4, 6, 9)} else r[4], r[5]) for r in rows])
