"""State matrix, expectation and selector against plain Python and numpy, poisoned futures, and a reconstruction that is ended and goes on."""

import datetime
import math
import statistics as st

import numpy as np
import pytest

from tickloom.functions import selector as s
from tickloom.operators.expectation import expectation_sql
from tickloom.operators.matrix import COLUMNS, Scale, matrix_sql
from tickloom.plans import selection
from tickloom.plans.dialect import Operator

SCALE = Scale(slots=14, short=2, middle=4, long=6, far=9, opening=3, stale=2, least=4, least_signs=2, peers=3, lookback=3, crore="1e4")
DECISION = 10
DAY0 = datetime.date(2024, 1, 1)


def a_market(seed=0, days=5, symbols=7):
    rng = np.random.default_rng(seed)
    bars, facts, index = [], [], []
    for d in range(days):
        day = DAY0 + datetime.timedelta(d)
        for p in (1, 2):
            level = 100.0
            for t in range(SCALE.slots):
                o, level = level, level * math.exp(rng.normal(0, 0.01))
                if not (p == 1 and (d == 2 or rng.random() < 0.2)):
                    index.append((p, day, t, o, level))
        for k in range(symbols):
            price = 50.0 + 10 * k
            if d == 1 and k == 3:
                continue
            for t in range(SCALE.slots):
                o = price * math.exp(rng.normal(0, 0.005))
                price = o * math.exp(rng.normal(0, 0.01)) if not k == 5 else o
                if rng.random() < 0.75:
                    high, low = (max(o, price) * 1.002, min(o, price) * 0.998) if k != 5 else (price, price)
                    bars.append((k, day, t, price if k == 5 else o, high, low, price, int(rng.integers(0, 500))))
            facts += [(day, k, "previous_close", 0, 50.0 + 9 * k)] * (k != 4) + [(day, k, "spread_bps", int(rng.integers(0, 14)), float(rng.normal())) for _ in range(1)]
            facts += [(day, k, "today_open", 2, 51.0 + 10 * k)] * (k == 2) + [(day, k, "depth5", 3, 1.0), (day, k, "depth5", 9, 2.0), (day, k, "depth5", 12, 3.0)]
        facts += [(day, None, "nifty_atm_iv", 4, 0.1 + d), (day, None, "nifty_atm_iv", 12, 9.0), (day, None, "market_state_code", 11, 2.0)]
    return bars, facts, index


KINDS = {
    "bars": "symbol int, session_date date, slot int, open double, high double, low double, close double, volume long",
    "facts": "session_date date, symbol int, name string, known_slot int, value double",
    "index_bars": "priority int, session_date date, slot int, open double, close double",
}


def tables(spark, bars, facts, index, symbols=7):
    universe = spark.createDataFrame([(k, k % 2 if k != 6 else None) for k in range(symbols)], "symbol int, sector int")
    return {"bars": spark.createDataFrame(bars, KINDS["bars"]), "facts": spark.createDataFrame(facts, KINDS["facts"]), "index_bars": spark.createDataFrame(index, KINDS["index_bars"]), "universe": universe}


def plain_matrix(bars, facts, index, decision, symbols=7):
    """Cell by cell, as the columns are defined."""
    c, out = SCALE, {}
    days = sorted({b[1] for b in bars})
    at = {(b[0], b[1], b[2]): b for b in bars}
    m = decision + 1

    def path(k, day, upto):
        return [at.get((k, day, t)) for t in range(upto)]

    def returns(p):
        r = []
        for t, b in enumerate(p):
            before = b[3] if b and t == 0 else (p[t - 1][6] if t and p[t - 1] else None)
            r.append(math.log(b[6] / before) if b and before else None)
        return r

    def known(day, k, name):
        f = [(x[3], x[4]) for x in facts if x[0] == day and x[1] == k and x[2] == name and x[3] <= decision]
        return max(f)[1] if f else None

    def some(xs):
        return [x for x in xs if x is not None]

    for d, day in enumerate(days):
        for k in range(symbols):
            v = dict.fromkeys(COLUMNS)
            out[k, day] = v
            p = path(k, day, m)
            r, there = returns(p), [t for t, b in enumerate(p) if b]
            filled, last = [], None
            for b in p:
                last = b[6] if b else last
                filled.append(last)
            v["bars_present"], v["completeness"] = len(there), len(there) / m
            v["activity"] = v["completeness"]
            v["last_bar_age_min"] = decision - there[-1] if there else None
            v["stale"] = 0 if there and decision - there[-1] < c.stale else 1
            v["ltp"], v["prev_close"] = filled[-1], known(day, k, "previous_close")
            v["open"] = known(day, k, "today_open") or (p[there[0]][3] if there else None)
            if v["open"] and v["prev_close"]:
                v["gap_pct"] = (v["open"] / v["prev_close"] - 1) * 100
            if v["ltp"] and v["prev_close"]:
                v["ret_prev_close_pct"] = (v["ltp"] / v["prev_close"] - 1) * 100
            if there:
                v["ret_open_pct"] = (v["ltp"] / v["open"] - 1) * 100
                v["day_high"], v["day_low"] = max(b[4] for b in p if b), min(b[5] for b in p if b)
                v["range_pct"] = (v["day_high"] - v["day_low"]) / v["open"] * 100
                v["volume_session"] = sum(b[7] for b in p if b)
            v["turnover_session_cr"] = sum(b[7] * b[6] / 1e4 for b in p if b)
            v["ret_1m"] = r[-1]
            back = lambda n, e=m - 1: math.log(filled[e] / filled[e - n]) if e - n >= 0 and filled[e - n] and filled[e] else None  # noqa: B023, E731
            v["ret_5m"], v["ret_10m"], v["ret_15m"], v["ret_30m"] = back(2), back(4), back(6), back(9)
            if back(2) is not None and back(2, m - 3) is not None:
                v["accel_5m"] = back(2) - back(2, m - 3)
            signs = [np.sign(x) for x in some(r[-4:]) if x]
            if len(signs) >= 2:
                v["persistence_10m"] = sum(x == np.sign(v["ret_10m"] or 0) for x in signs) / len(signs)
            recent, prior = (sum(b[7] for b in q if b) for q in (p[-2:], p[-4:-2]))
            v["volume_accel"] = recent / prior if prior else None
            pairs = [(abs(x), math.log(1 + b[7])) for x, b in zip(r[-6:], p[-6:], strict=True) if x is not None]
            if len(pairs) >= 4 and min(np.std(pairs, axis=0)) > 1e-9:
                v["pv_corr_15m"] = float(np.corrcoef(np.array(pairs).T)[0, 1])
            opening = some(p[:3])
            if opening:
                v["or_high"], v["or_low"] = max(b[4] for b in opening), min(b[5] for b in opening)
                if v["or_high"] > v["or_low"]:
                    v["or_position"] = (v["ltp"] - v["or_low"]) / (v["or_high"] - v["or_low"])
                v["breakout_state"] = 1 if v["ltp"] > v["or_high"] else -1 if v["ltp"] < v["or_low"] else 0
            rs = some(r)
            if len(rs) >= 4:
                v["rvol_session"] = st.stdev(rs)
                traded = [abs(x) / (b[7] * b[6] / 1e4) for x, b in zip(r, p, strict=True) if x is not None and b[7] > 0]
                v["illiquidity"] = st.mean(traded) if traded else None
            if len(some(r[-6:])) >= 4:
                v["rvol_15m"] = st.stdev(some(r[-6:]))
            if there and v["day_high"] > v["day_low"]:
                v["range_position"] = (v["ltp"] - v["day_low"]) / (v["day_high"] - v["day_low"])
            if v["rvol_session"]:
                v["range_vs_vol"] = (v["day_high"] - v["day_low"]) / v["open"] / (v["rvol_session"] * math.sqrt(m))
                v["vol_expansion"] = v["rvol_15m"] / v["rvol_session"] if v["rvol_15m"] is not None else None
            v["frozen"] = int(all(b and b[4] == b[5] for b in p[-4:]))
            v["_open"] = math.log(v["ltp"] / v["open"]) if there else None
            trend = [v["ret_5m"], v["ret_15m"], v["_open"]]
            if None not in trend:
                v["trend_state"] = 1 if min(trend) > 0 else -1 if max(trend) < 0 else 0
            for name in ("spread_bps", "depth5", "response_gap", "imbalance1"):
                v[name] = known(day, k, name)
            v["nifty_atm_iv"], v["market_state_code"] = known(day, None, "nifty_atm_iv"), known(day, None, "market_state_code")
            earlier = days[max(0, d - c.lookback) : d]
            v["history_sessions"] = len(earlier)
            volumes, sizes = [], []
            for e in earlier:
                if any((k, e, t) in at for t in range(c.slots)):
                    q = path(k, e, m)
                    volumes.append(sum(b[7] for b in q if b))
                    a = [abs(x) for x in returns(q) if x is not None]
                    sizes += [st.mean(a)] if a else []
            if volumes and st.median(volumes) > 0 and there:
                v["rel_volume"] = v["volume_session"] / st.median(volumes)
            if sizes and rs and st.median(sizes) > 0:
                v["vol_ratio"] = st.mean(map(abs, rs)) / st.median(sizes)
        day_rows = {k: out[k, day] for k in range(symbols)}
        opens = {k: v["_open"] for k, v in day_rows.items() if v["_open"] is not None}
        market = market_15 = None
        for q in (1, 2):
            b = {x[2]: x for x in index if x[0] == q and x[1] == day and x[2] <= decision}
            if b and market is None:
                market = math.log(b[max(b)][4] / b[min(b)][3])
                market_15 = math.log(b[decision][4] / b[decision - 6][4]) if decision in b and decision - 6 in b else None
        for k, v in day_rows.items():
            v["market_ret_open"], v["breadth"], v["dispersion"] = market, st.mean(x > 0 for x in opens.values()), st.stdev(opens.values())
            if v["_open"] is not None:
                v["rel_market_open"] = v["_open"] - market
            if v["ret_15m"] is not None and market_15 is not None:
                v["rel_market_15m"] = v["ret_15m"] - market_15
            peers = [x for j, x in opens.items() if k != 6 and j != 6 and j % 2 == k % 2]
            if len(peers) >= 3:
                v["sector_ret_open"], v["sector_breadth"] = st.mean(peers), st.mean(x > 0 for x in peers)
                if v["_open"] is not None:
                    v["rel_sector_open"] = v["_open"] - (sum(peers) - v["_open"]) / (len(peers) - 1)
            for name, x in (("pct_ret_open", "_open"), ("pct_rel_volume", "rel_volume")):
                all_ = [w[x] for w in day_rows.values() if w[x] is not None]
                if v[x] is not None:
                    v[name] = (sum(y < v[x] for y in all_) + (sum(y == v[x] for y in all_) + 1) / 2 - 0.5) / len(all_)
    return out


def rows_of(df, decision=DECISION):
    return {(r["symbol"], r["session_date"]): r.asDict() for r in df.where(f"slot = {decision}").collect()}


def test_matrix_is_as_its_columns_are_defined(spark):
    data = a_market()
    got = rows_of(Operator("m", matrix_sql(SCALE, DECISION))(**tables(spark, *data)))
    want = plain_matrix(*data, DECISION)
    assert got.keys() == want.keys() and len(COLUMNS) == 61
    for key, v in want.items():
        for c in COLUMNS:
            a, b = got[key][c], v[c]
            assert (a is None) == (b is None), (key, c, a, b)
            assert a is None or abs(float(a) - float(b)) < 1e-9 * max(1, abs(float(b))), (key, c, a, b)
    assert sum(v[c] is not None for v in want.values() for c in COLUMNS) > 0.6 * len(want) * len(COLUMNS)


def test_matrix_knows_nothing_of_later_bars_facts_and_sessions(spark):
    bars, facts, index = a_market(1)
    day = DAY0 + datetime.timedelta(3)
    late = lambda d, t: d > day or d == day and t > DECISION
    poisoned = (
        [(*b[:3], *(1000.0 * x for x in b[3:7]), b[7] * 1000) if late(b[1], b[2]) else b for b in bars],
        [(*f[:4], f[4] * 1000) if late(f[0], f[3]) else f for f in facts],
        [(*i[:3], 1000 * i[3], 1000 * i[4]) if late(i[1], i[2]) else i for i in index],
    )
    whole, other = (rows_of(Operator("m", matrix_sql(SCALE, upto))(**tables(spark, *data))) for data, upto in (((bars, facts, index), DECISION), (poisoned, None)))
    for key, row in whole.items():
        if key[1] <= day:
            assert row == other[key], key
    assert any(whole[k] != other[k] for k in whole if k[1] > day)


def test_walk_forward_equals_a_refit(spark):
    rng = np.random.default_rng(0)
    xs, days = [f"x{k}" for k in range(4)], [DAY0 + datetime.timedelta(d) for d in range(12)]
    rows = [(d, *map(float, rng.normal(size=4)), float(rng.normal())) for d in days for _ in range(20) if d != days[4]]
    df = spark.createDataFrame(rows, "session_date date, x0 double, x1 double, x2 double, x3 double, y double").repartition(3)
    fits = s.walk_forward(s.daily_sums(df, "session_date", xs, "y"), spark.createDataFrame([(d,) for d in days], "session_date date"), "session_date", 6, 5, 3, 50, 7.0)
    got = {r.session_date: r for r in fits.collect()}
    for j, d in enumerate(days):
        train = np.array([r[1:] for r in rows if r[0] in days[max(0, j - 5) : j]])
        assert got[d].train_rows == len(train) and got[d].train_days in (min(j, 5), None if j == 0 else min(j, 5))
        if j < 3 or len(train) < 50:
            assert got[d].coef is None
            continue
        x = np.column_stack([np.ones(len(train)), train[:, :4]])
        want = np.linalg.solve(x.T @ x + 7.0 * np.diag([0, 1, 1, 1, 1]), x.T @ train[:, 4])
        assert np.abs(np.array(got[d].coef) - want).max() < 1e-8


def test_logistic_finds_planted_chances_and_stays_finite():
    rng = np.random.default_rng(2)
    x = rng.normal(size=20_000)
    a, b = s.logistic(x, (rng.random(20_000) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))).astype(float))
    assert abs(a - 0.3) < 0.06 and abs(b - 1.2) < 0.06
    for y in ((x > 0).astype(float), np.ones(20_000)):
        assert np.isfinite(s.logistic(x, y)).all()
    assert s.logistic(np.zeros(0), np.zeros(0)) == (0.0, 0.0)


def test_outcomes_by_hand(spark):
    bars = [(1, DAY0, t, 10.0 + t, h, low, c, 1) for t, h, low, c in ((2, 13.0, 11.0, 12.0), (4, 20.0, 13.0, 16.0), (5, 20.0, 7.0, 15.0), (8, 30.0, 14.0, 18.0))]
    df = spark.createDataFrame([*bars, (2, DAY0, 7, 5.0, 6.0, 4.0, 5.0, 1)], KINDS["bars"])
    got = {(r.symbol, r.horizon): r for r in Operator("o", s.outcomes_sql(2, (1, 2, 3, 9), 3))(bars=df).collect()}
    assert set(got) == {(1, h) for h in (2, 3, 9)}  # the entry is at slot 4; symbol 2 has none in time
    r = got[1, 3]
    assert (r.entry, r.exit, r.t_mfe, r.t_mae) == (14.0, 15.0, 2, 3) and abs(r.mfe - math.log(20 / 14)) < 1e-12 and abs(r.mae - math.log(7 / 14)) < 1e-12
    assert got[1, 9].t_mfe == 6 and abs(got[1, 9].forward - math.log(18 / 14)) < 1e-12 and got[1, 2].exit == 16.0


def test_expectation_by_hand(spark):
    legs = [("N", DAY0, 2, DAY0 + datetime.timedelta(3), 100.0, k, side, iv, delta, bid, ask, last, oi, before) for k, side, iv, delta, bid, ask, last, oi, before in (
        (100.0, "CE", 16.0, 0.5, 3.9, 4.1, 9.0, 10.0, 8.0), (100.0, "PE", 0.2, -0.5, None, 3.0, 2.0, 30.0, None),
        (103.0, "CE", 14.0, 0.27, 1.0, 1.2, 1.1, 5.0, 5.0), (97.0, "PE", 0.22, -0.24, 1.0, 1.2, 1.1, 6.0, 1.0), (110.0, "CE", None, 0.02, None, None, None, None, None),
    )]
    returns = [("N", DAY0 + datetime.timedelta(d), t, 0.01 * (1 + (t < 2) * d)) for d in (-2, -1, 0) for t in range(6)]
    futures = [("N", DAY0, t, 100.5 + 0.1 * t, 100.0) for t in range(4)]
    kinds = "underlying string, session_date date, slot int, expiry date, spot double, strike double, side string, iv double, delta double, bid double, ask double, last_price double, oi double, previous_oi double"
    named = {"legs": spark.createDataFrame(legs, kinds), "returns": spark.createDataFrame(returns, "underlying string, session_date date, slot int, r double"), "futures": spark.createDataFrame(futures, "underlying string, session_date date, slot int, price double, spot double")}
    df = Operator("e", expectation_sql(slots=6, oldest=2, least_basis=3))(**named)
    got = {(r.session_date, r.slot): r for r in df.collect()}
    now = got[DAY0, 3]
    assert got[DAY0, 1].snapshot_slot is None and got[DAY0, 1].note == "no snapshot by then" and got[DAY0, 1].atm_iv is None
    assert (now.snapshot_slot, now.snapshot_age, now.atm_strike, now.strikes_with_iv, now.stale_snapshot) == (2, 1, 100.0, 4, False)
    assert now.atm_iv == pytest.approx(0.18) and now.straddle == pytest.approx(6.0) and now.atm_spread_share is None and now.skew == pytest.approx(0.22 - 0.14) and now.skew_method == "risk_reversal_25d"
    assert (now.put_call_oi, now.ce_oi_change, now.pe_oi_change) == (pytest.approx(36 / 15), pytest.approx(2.0), pytest.approx(35.0))
    assert now.realised_var == pytest.approx(4e-4) and now.budget_consumed == pytest.approx(4e-4 / (0.18**2 / 252)) and now.tail_z == pytest.approx(0.01 / (0.18 / math.sqrt(252 * 6)))
    shares = [sum(x * x for x in day[:4]) / sum(x * x for x in day) for day in ([-0.01, -0.01, 0.01, 0.01, 0.01, 0.01], [0.0, 0.0, 0.01, 0.01, 0.01, 0.01])]
    assert now.profile_sessions == 2 and now.expected_share == pytest.approx(st.mean(shares)) and now.expected_share_low == pytest.approx(np.quantile(shares, 0.1)) and now.budget_ratio == pytest.approx(now.budget_consumed / st.mean(shares))
    assert now.basis_bps == pytest.approx(80.0) and now.basis_z == pytest.approx((80 - 60) / np.std([50, 60, 70])) and got[DAY0, 1].basis_z is None
    assert now.days_to_expiry == pytest.approx(3 + 2 / 6) and now.implied_sd_to_expiry_pct == pytest.approx(6.0 / math.sqrt(2 / math.pi), rel=1e-9)
    old = got[DAY0, 5]
    assert (old.snapshot_age, old.stale_snapshot, old.atm_iv, old.straddle, old.budget_ratio) == (3, True, None, None, None) and old.realised_var is not None
    kept = {(r.session_date, r.slot): r for r in Operator("e", expectation_sql(slots=6, oldest=2, least_basis=3, keep_stale=True))(**named).collect()}
    assert kept[DAY0, 5].stale_snapshot and kept[DAY0, 5].atm_iv == pytest.approx(0.18)


def test_reconstruction_goes_on_after_a_failure_and_makes_changed_days_only(spark, tmp_path, monkeypatch):
    from tickloom.functions import reconstruction as r

    days = [DAY0 + datetime.timedelta(d) for d in range(9)]
    rng = np.random.default_rng(4)
    data = [(d, k, float(rng.normal()), float(rng.normal())) for d in days for k in range(6)]
    asked = []

    def run(rows, root, fail=None):
        table = spark.createDataFrame(rows, "session_date date, symbol int, x double, y double")
        keys = r.day_keys([table], 3)

        def rows_of(first, days_):
            asked.append(("rows", tuple(days_)))
            return table.where(f"session_date >= '{first}'")

        def stage(name, f):
            def made(*args):
                if fail == name:
                    raise KeyboardInterrupt
                return f(*args)

            return made

        sums_of = stage("sums", lambda t: t.select("session_date").distinct().join(s.daily_sums(t, "session_date", ["x"], "y"), "session_date", "left"))
        scored_of = stage("scored", lambda t, sums: s.predicted(t, s.walk_forward(sums, sums.select("session_date"), "session_date", 3, 3, 1, 1, 1.0), "session_date", ["x"]))
        decided_of = stage("decisions", lambda t: t.selectExpr("session_date", "symbol", "round(prediction, 9) as prediction"))
        out = r.reconstructed(spark, root, keys, 0, 3, rows_of, sums_of, scored_of, decided_of)
        return sorted((str(x.session_date), x.symbol, x.prediction) for x in out.collect())

    calm = run(data, f"{tmp_path}/calm")
    assert len(calm) == 54
    for name in ("sums", "scored", "decisions"):
        with pytest.raises(KeyboardInterrupt):
            run(data, f"{tmp_path}/rough", name)
    asked.clear()
    assert run(data, f"{tmp_path}/rough") == calm and not asked
    assert run(data[:30], f"{tmp_path}/grown") == [x for x in calm if x[0] <= str(days[4])]
    asked.clear()
    assert run(data, f"{tmp_path}/grown") == calm and asked == [("rows", tuple(map(str, days[5:])))]
    changed = [(*x[:2], x[2] + 1, x[3]) if x[0] == days[2] else x for x in data]
    asked.clear()
    assert run(changed, f"{tmp_path}/grown") == run(changed, f"{tmp_path}/fresh") != calm
    assert asked[0] == ("rows", tuple(map(str, days[2:6])))  # the day and the three that look back on it


def test_a_decision_learns_from_earlier_sessions_only(spark):
    rules = s.Rules(window=6, least_days=2, least_rows=6, history=8, compare_days=2, calibration_days=2, first_picks=2, least_ic=3, completeness=0.0, age=99, price=0.0, turnover=0.0)
    rng = np.random.default_rng(8)
    days = [DAY0 + datetime.timedelta(d) for d in range(8)]
    base = [(d, k, k % 2, "STRICT", True, 0, *map(float, rng.normal(0, 0.01, 3)), *([float(rng.normal())] * 1), float(rng.normal()), 1, *map(float, rng.normal(size=48))) for d in days for k in range(6)]
    names = "session_date date, symbol int, sector int, tier string, eligible boolean, stale int, forward double, mfe double, mae double, target double, signed_v1 double, direction_v1 int, " + ", ".join(f"{c} double" for c in (*selection.T, *selection.P))
    later = [(*x[:6], *(-50 * v for v in x[6:10]), *x[10:]) if x[0] >= days[5] else x for x in base]

    def decided(rows):
        scored = selection.scored_rows(spark.createDataFrame(rows, names), rules)
        return {r.session_date: r.asDict() for r in selection.decided(scored, rules).collect()}

    one, two = decided(base), decided(later)
    assert len(one) == 8 and all(one[d] == two[d] for d in days[:6]) and any(one[d] != two[d] for d in days[6:])
