"""Joins: grid alignment, dimension lookups, as-of and range joins, nearest neighbours, self-joins and anti-joins."""

from __future__ import annotations

from tickloom.operators.windows import DAY, K
from tickloom.plans.dialect import Operator

OPERATORS = [
    Operator("jon_01", f"select {K}, open, high, low, close, volume from {{grid}}"),
    Operator("jon_02", "select a.symbol, a.session_date, b.close as market_close from {daily} a left join (select session_date, close from {daily} where symbol = 3) b on b.session_date = a.session_date"),
    Operator("jon_03", "select c.c_custkey as symbol, d.session_date, d.close from {customer} c left join {daily} d on d.symbol = c.c_custkey and d.session_date = date '2024-01-10'"),
    Operator("jon_04", "select u.symbol, d.close from (select c_custkey as symbol from {customer} union select symbol from {daily}) u left join {daily} d on d.symbol = u.symbol and d.session_date = date '2024-01-05'"),
    Operator("jon_05", f"with ref as (select symbol, session_date, max_by(close, slot) as close from {{bars}} group by symbol, session_date), p as (select symbol, session_date, lag(close) over (partition by symbol order by session_date) as previous_close from ref) select b.symbol, b.session_date, b.slot, round(b.close - p.previous_close, 6) as change from {{bars}} b left join p on p.symbol = b.symbol and p.session_date = b.session_date"),
    Operator("jon_06", "select c.c_custkey, coalesce(case when r.r_name = 'ASIA' then null else r.r_name end, 'OTHER') as sector from {customer} c left join {nation} n on n.n_nationkey = c.c_nationkey left join {region} r on r.r_regionkey = n.n_regionkey"),
    Operator("jon_07", "select b.symbol, b.session_date, b.slot, round(b.close - m.level, 6) as spread from {bars} b join {market} m on m.session_date = b.session_date and m.slot = b.slot"),
    Operator("jon_08", "with s as (select sector, session_date, avg(close) as level from {daily} group by sector, session_date) select d.symbol, d.session_date, round(d.close - s.level, 6) as spread from {daily} d join s on s.sector = d.sector and s.session_date = d.session_date"),
    Operator("jon_09", "with s as (select sector, session_date, avg(close) as level from {daily} group by sector, session_date) select a.session_date, a.sector as sector_a, b.sector as sector_b, round(a.level - b.level, 6) as spread from s a join s b on a.session_date = b.session_date and a.sector < b.sector"),
    Operator(
        "jon_10",
        """with u as (select symbol as k, ts, 0 as side, price as v, event_id from {ticks} where symbol = 'click' union all select 'click' as k, ts, 1 as side, cast(null as double) as v, event_id from {ticks} where symbol = 'view'),
        f as (select *, @last_known(v) over (partition by k order by ts, side rows between unbounded preceding and current row) as known from u)
        select event_id, known from f where side = 1""",
    ),
    Operator(
        "jon_11",
        """with u as (select o_custkey as k, o_orderdate as ts, 0 as side, o_totalprice as v, o_orderkey as id from {orders} where o_orderstatus = 'F' union all select o_custkey, o_orderdate, 1, cast(null as double), o_orderkey from {orders} where o_orderstatus = 'O'),
        f as (select *, @last_known(v) over (partition by k order by ts, side, id rows between unbounded preceding and current row) as known from u)
        select id, known from f where side = 1""",
    ),
    Operator("jon_12", "select c.underlying, c.strike, c.oi as ce_oi, p.oi as pe_oi from {chain} c join {chain} p on p.underlying = c.underlying and p.strike = c.strike and p.side = 'PE' where c.side = 'CE'"),
    Operator("jon_14", "select d.symbol, d.session_date, d.close, e.n_events, v.n_view from {daily} d left join (select user_id, session_date, count(*) as n_events from {ticks} group by user_id, session_date) e on e.user_id = d.symbol and e.session_date = d.session_date left join (select user_id, session_date, count(*) as n_view from {ticks} where symbol = 'view' group by user_id, session_date) v on v.user_id = d.symbol and v.session_date = d.session_date"),
    Operator("jon_16", "select c.c_custkey from {customer} c left join {daily} d on d.symbol = c.c_custkey where d.symbol is null"),
    # The calendar is the days on which half of all symbols traded.
    Operator("jon_17", "with c as (select session_date from {daily} group by session_date having count(*) >= (select count(distinct symbol) / 2e0 from {daily})), s as (select distinct symbol from {daily}) select 'missing' as kind, s.symbol, c.session_date from s cross join c left join {daily} d on d.symbol = s.symbol and d.session_date = c.session_date where d.symbol is null union all select 'extra', d.symbol, d.session_date from {daily} d left join c on c.session_date = d.session_date where c.session_date is null"),
    Operator("jon_18", "select l.l_orderkey, l.l_linenumber, p.p_brand, s.s_name from {lineitem} l join {part} p on p.p_partkey = l.l_partkey join {supplier} s on s.s_suppkey = l.l_suppkey where l.l_quantity > 45"),
    Operator("jon_19", "select a.session_date from (select distinct session_date from {daily} where sector = 1) a join (select distinct session_date from {daily} where sector = 2) b on b.session_date = a.session_date"),
    Operator("jon_20", "with picks as (select symbol, session_date, row_number() over (partition by session_date order by volume desc, symbol) as k from {daily}) select p.session_date, p.symbol, round(d.high / nullif(d.open, 0) - 1, 6) as excursion from picks p join {daily} d on d.symbol = p.symbol and d.session_date = p.session_date where p.k = 1"),
    Operator("jon_21", f"select {K}, max(high) over (partition by symbol, session_date order by slot rows between 1 following and 4 following) as window_high from {{grid}}"),
    Operator("jon_22", "with t as (select symbol, session_date, min(slot) as entry from {bars} where close > open group by symbol, session_date) select t.symbol, t.session_date, t.entry, max(b.high) as best, min(b.low) as worst, count(*) as bars from t join {bars} b on b.symbol = t.symbol and b.session_date = t.session_date and b.slot between t.entry and t.entry + 6 group by t.symbol, t.session_date, t.entry"),
    Operator("jon_23", "with f as (select c_custkey as symbol, 0 as node from {customer} where c_custkey < 500 union all select c_custkey, 1 from {customer} where c_custkey >= 500) select f.node, count(*) as expected, count(d.symbol) as present from f left join (select distinct symbol from {daily}) d on d.symbol = f.symbol group by f.node"),
    Operator("jon_24", "with e as (select symbol, session_date, slot, 'UP' as label from {bars} where close > open), c as (select symbol, session_date, slot, 'BUSY' as label from {bars} where volume > 150) select e.label as event, c.label as condition, e.symbol, count(*) as n from e join c on c.symbol = e.symbol and c.session_date = e.session_date and c.slot = e.slot group by e.label, c.label, e.symbol"),
    Operator("jon_25", f"select a.symbol, a.session_date, a.close, b.bars, c.changes from (select symbol, session_date, max_by(close, slot) as close from {{bars}} group by symbol, session_date) a left join (select symbol, session_date, count(close) as bars from {{grid}} group by symbol, session_date) b on b.symbol = a.symbol and b.session_date = a.session_date left join (select symbol, session_date, count(*) filter (where d > 0) as changes from (select {K}, close - lag(close) over w as d from {{grid}} window w as ({DAY})) x group by symbol, session_date) c on c.symbol = a.symbol and c.session_date = a.session_date"),
]
