"""Technical indicators that frames express, per symbol and session. The recursive ones are in functions/indicators.py."""

from __future__ import annotations

from tickloom.operators.windows import DAY, K, before, last, strict
from tickloom.plans.dialect import Operator

B20 = f"{strict('avg({})', 'close', 20, last(20))}"
TP = "(high + low + close) / 3e0"

OPERATORS = [
    Operator("ind_01", f"select {K}, round({strict('avg({})', 'close', 20, last(20))}, 6) as sma_20 from {{grid}}"),
    Operator("ind_04", f"select {K}, round(greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)), 6) as true_range from {{grid}} window w as ({DAY})"),
    Operator("ind_08", f"select {K}, round(sum({TP} * volume) over w / nullif(sum(volume) over w, 0), 6) as vwap from {{grid}} window w as ({DAY} rows between unbounded preceding and current row)"),
    Operator("ind_09", f"select {K}, round(case when count(close) over w = 20 then sum(close * volume) over w / nullif(sum(volume) over w, 0) end, 6) as vwma_20 from {{grid}} window w as ({DAY} rows between 19 preceding and current row)"),
    Operator(
        "ind_10",
        f"""with b as (select {K}, close, case when count(close) over w = 20 then avg(close) over w end as m, case when count(close) over w = 20 then stddev_pop(close) over w end as s
          from {{grid}} window w as ({DAY} rows between 19 preceding and current row))
        select {K}, round(m, 6) as bb_middle, round(m + 2 * s, 6) as bb_upper, round(m - 2 * s, 6) as bb_lower, round(4 * s / nullif(m, 0), 6) as bb_width, round((close - (m - 2 * s)) / nullif(4 * s, 0), 4) as percent_b from b""",
    ),
    Operator(
        "ind_11",
        f"""with h as (select {K}, close, {strict('max({})', 'high', 14, last(14))} as hh, {strict('min({})', 'low', 14, last(14))} as ll from {{grid}}),
        k as (select {K}, 100 * (close - ll) / nullif(hh - ll, 0) as raw_k from h),
        s as (select {K}, raw_k, {strict('avg({})', 'raw_k', 3, last(3))} as k from k)
        select {K}, round(raw_k, 6) as stoch_raw_k, round(k, 6) as stoch_k, round({strict('avg({})', 'k', 3, last(3))}, 6) as stoch_d from s""",
    ),
    Operator("ind_13", f"select {K}, round(100 * (close / nullif(lag(close, 12) over w, 0) - 1), 6) as roc_12, round(close - lag(close, 10) over w, 6) as momentum_10 from {{grid}} window w as ({DAY})"),
    Operator(
        "ind_14",
        f"""with h as (select {K}, close, {strict('max({})', 'high', 14, last(14))} as hh, {strict('min({})', 'low', 14, last(14))} as ll from {{grid}})
        select {K}, round(-100 * (hh - close) / nullif(hh - ll, 0), 6) + 0e0 as williams_r_14 from h""",
    ),
    Operator(
        "ind_16",
        f"""with d as (select {K}, volume, close - lag(close) over w as d, close from {{grid}} window w as ({DAY}))
        select {K}, case when close is not null then cast(sum(case when d > 0 then volume when d < 0 then -volume else 0 end) over ({DAY} rows between unbounded preceding and current row) as bigint) end as obv from d""",
    ),
    Operator(
        "ind_17",
        f"""with m as (select {K}, volume, ((close - low) - (high - close)) / nullif(high - low, 0) * volume as mv from {{grid}})
        select {K}, round(case when count(mv) over w = 20 then sum(mv) over w / nullif(sum(volume) over w, 0) end, 6) as cmf_20 from m window w as ({DAY} rows between 19 preceding and current row)""",
    ),
    Operator(
        "ind_18",
        f"""with t as (select {K}, {TP} as tp, volume from {{grid}}), d as (select {K}, tp * volume as flow, tp - lag(tp) over w as d from t window w as ({DAY})),
        s as (select {K}, case when count(d) over w = 14 then sum(case when d > 0 then flow else 0 end) over w end as up, case when count(d) over w = 14 then sum(case when d < 0 then flow else 0 end) over w end as down
          from d window w as ({DAY} rows between 13 preceding and current row))
        select {K}, round(case when down = 0 and up > 0 then 100 when down = 0 then 50 else 100 - 100 / (1 + up / down) end, 6) as mfi_14 from s""",
    ),
    Operator("ind_19", f"select {K}, round(case when count(volume) over w = 20 then volume / nullif(avg(volume) over w, 0) end, 6) as rvol_20 from {{grid}} window w as ({DAY} rows between 20 preceding and 1 preceding)"),
    Operator(
        "ind_20",
        f"""with d as (select {K}, {strict('max({})', 'high', 20, before(20))} as u, {strict('min({})', 'low', 20, before(20))} as l from {{grid}})
        select {K}, u as donchian_upper, l as donchian_lower, round((u + l) / 2, 6) as donchian_middle from d""",
    ),
    Operator("ind_23", "select symbol, session_date, count(close) as bars, count(close) >= 20 and count(case when slot = 23 then close end) > 0 as ready from {grid} group by symbol, session_date"),
    Operator(
        "ind_24",
        """with d as (select symbol, session_date, max_by(close, slot) as ltp, min_by(open, slot) as day_open from {bars} group by symbol, session_date)
        select symbol, session_date, ltp, round(100 * (ltp / nullif(lag(ltp) over w, 0) - 1), 6) as vs_previous, round(100 * (ltp / nullif(day_open, 0) - 1), 6) as vs_open from d window w as (partition by symbol order by session_date)""",
    ),
    Operator("ind_25", "select symbol, count(*) as bars, case when count(*) < 400 then 'INSUFFICIENT_DATA' else 'OK' end as status from {bars} group by symbol"),
]
