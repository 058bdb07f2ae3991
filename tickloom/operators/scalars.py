"""Scalar functions over rows: clocks, calendars, classes, buckets, names and hashes."""

from __future__ import annotations

from tickloom.plans.dialect import Operator

OPERATORS = [
    Operator("fn_01", "select event_id, @in_zone(ts) || ' IST' as stamp from {ticks}"),
    Operator("fn_02", "select distinct slot, slot * 60 as minute_of_day, lpad(cast(slot as varchar(2)), 2, '0') || ':00' as label from {ticks}"),
    Operator("fn_03", "select distinct session_date, cast(@iso_week(session_date) as int) as iso_week, cast(floor((@days(session_date) + 3) / 7e0) as bigint) as week_id, @weekday(session_date) as weekday from {ticks}"),
    Operator("fn_05", "select o_orderkey, case when o_orderdate < timestamp '1996-01-01 00:00:00' then 75 when o_orderdate < timestamp '1999-01-01 00:00:00' then 50 else 25 end as lot_size from {orders}"),
    Operator("fn_07", "select p_partkey, @replaced(upper(p_name), '[^A-Z0-9]', '') as normal from {part}"),
    Operator("fn_08", "select p_partkey from {part} where p_brand like 'Brand#1%' and not p_brand like 'Brand#12%'"),
    Operator("fn_09", "select event_id, round(ln(case when price > 0 then price end), 6) as logged, round(sqrt(price), 6) as root, cast(sign(price - 50) as double) as side, greatest(least(price, 80e0), 20e0) as clipped from {ticks}"),
    Operator("fn_10", "select event_id, case when price < 10 then 0 when price < 50 then 1 else 2 end as bucket3 from {ticks}"),
    Operator("fn_11", "select c.underlying, c.strike, c.side, case when abs(c.strike - s.spot) < 5e-1 then 'ATM' when (c.side = 'CE' and c.strike < s.spot) or (c.side = 'PE' and c.strike > s.spot) then 'ITM' else 'OTM' end as moneyness from {chain} c join {spots} s on s.underlying = c.underlying"),
    Operator("fn_12", "with d as (select underlying, session_date, oi - lag(oi) over w as d_oi, price - lag(price) over w as d_price from {snapshots} window w as (partition by underlying order by session_date)) select underlying, session_date, case when d_oi > 0 and d_price > 0 then 'LONG_BUILDUP' when d_oi > 0 and d_price < 0 then 'SHORT_BUILDUP' when d_oi < 0 and d_price > 0 then 'SHORT_COVERING' when d_oi < 0 and d_price < 0 then 'LONG_UNWINDING' else 'UNKNOWN' end as buildup from d"),
    Operator("fn_13", "with z as (select symbol, session_date, round((volume - avg(volume) over w) / nullif(stddev_pop(volume) over w, 0), 9) as z from {daily} window w as (partition by symbol order by session_date rows between unbounded preceding and 1 preceding)) select symbol, session_date, case when abs(z) >= 5 then 'EXTREME' when abs(z) >= 3 then 'UNUSUAL' else 'NORMAL' end as class from z"),
    Operator("fn_14", "select event_id, case when price / 20 < 15e-1 then 'LOW' when price / 20 < 25e-1 then 'MEDIUM' else 'HIGH' end as severity from {ticks}"),
    Operator("fn_17", "select underlying, strike, side, round(case when iv > 3 then iv / 100 else iv end, 6) as iv from {chain}"),
    Operator("fn_18", "with s as (select c.underlying, c.strike, c.iv as ce, p.iv as pe from {chain} c join {chain} p on p.underlying = c.underlying and p.strike = c.strike and p.side = 'PE' where c.side = 'CE') select underlying, strike, round(ce + pe, 6) as straddle, round((ce + pe) * strike * sqrt(1 / 252e0), 6) as implied_sd from s"),
    Operator("fn_20", "select symbol, session_date, slot, case when abs(close - open) < 1 then 2 when close - open > 20 then 4 when close > open then 3 when open - close > 20 then 0 else 1 end as candle_class from {bars}"),
    Operator("fn_21", "with c as (select symbol, session_date, slot, case when close - open > 20 then 4 when close > open then 3 when open - close > 20 then 0 else 1 end as c from {bars}) select symbol, session_date, slot, lag(c, 2) over w * 25 + lag(c) over w * 5 + c as motif from c window w as (partition by symbol, session_date order by slot)"),
    Operator("fn_22", "with c as (select symbol, session_date, slot, case when close > open then 'U' when close < open then 'D' else 'F' end as c from {bars}) select symbol, session_date, slot, lag(c, 2) over w || lag(c) over w || c as motif from c window w as (partition by symbol, session_date order by slot)"),
    Operator("fn_23", "select event_id, 'evt_' || substr(@digest(symbol || '|' || cast(session_date as varchar(10)) || '|' || cast(event_id as varchar(20))), 1, 16) as id from {ticks}"),
    Operator("fn_25", "select sector, @digest(@listed(lpad(cast(symbol as varchar(20)), 8, '0'))) as fingerprint from (select distinct sector, symbol from {daily}) x group by sector"),
    Operator("fn_26", "select event_id, coalesce(@json_int(props, last_price), @json_int(props, k)) as k from {events}"),
    Operator("fn_27", "select event_id, case when not @try_double(value_) in (cast('NaN' as double), cast('Infinity' as double), cast('-Infinity' as double)) then @try_double(value_) end as number_ from (select event_id, case event_id % 5 when 0 then cast(size as varchar(20)) when 1 then 'NaN' when 2 then 'true' when 3 then ' 1e2 ' else '' end as value_ from {ticks}) x"),
    Operator("fn_35", "select symbol, round(stddev_samp(close) / sqrt(count(*)), 6) as se, round(2486e-3 * stddev_samp(close) / sqrt(count(*)), 6) as detectable from {daily} group by symbol having count(*) > 1"),
    Operator("fn_38", "select count(distinct symbol) as instruments, count(distinct symbol) * 2 as requests, round(count(distinct symbol) * 2 / 120e0, 4) as minutes, count(*) * 48 as bytes_ from {daily}"),
]
