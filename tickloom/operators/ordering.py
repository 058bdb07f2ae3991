"""Sorting, top-k, deduplication, paging, sharding and set operations."""

from __future__ import annotations

from tickloom.plans.dialect import Operator


def first(table: str, by: str, order: str, columns: str, k: int = 1) -> str:
    part = f"partition by {by} " if by else ""
    return f"with r as (select *, row_number() over ({part}order by {order}) as place from {{{table}}}) select {columns} from r where place <= {k}"


OPERATORS = [
    Operator("srt_01", first("ticks", "symbol, session_date, slot", "case when user_id % 2 = 0 then 0 else 1 end, ts desc", "symbol, session_date, slot, event_id")),
    Operator("srt_02", "select symbol, session_date, slot, max_by(price, ts) as price from {ticks} group by symbol, session_date, slot"),
    Operator("srt_03", "select symbol, session_date, slot, count(*) as n, count(distinct price) > 1 as conflicting from {ticks} group by symbol, session_date, slot having count(*) > 1"),
    Operator("srt_04", first("chain", "underlying, side", "oi desc, strike", "underlying, side, strike, oi, cast(place as int) as place", 3)),
    Operator("srt_05", "with r as (select c.underlying, c.strike, row_number() over (partition by c.underlying order by abs(c.strike - s.spot), c.strike, c.side) as place from {chain} c join {spots} s on s.underlying = c.underlying) select underlying, strike as atm from r where place = 1"),
    Operator("srt_06", "with z as (select symbol, session_date, round((volume - avg(volume) over (partition by symbol)) / nullif(stddev_pop(volume) over (partition by symbol), 0), 6) as z from {daily}) select symbol, session_date, z from z order by abs(z) desc, symbol, session_date limit 25"),
    Operator("srt_07", "select symbol, session_date, volume from {daily} where sector = 3 order by volume desc, symbol, session_date limit 20"),
    Operator("srt_08", "select event_id, symbol from {ticks} order by ts desc, event_id limit 50 offset 100"),
    Operator("srt_09", "select event_id, symbol, session_date from {ticks} where event_id > 500 order by event_id limit 100"),
    Operator("srt_10", first("daily", "session_date", "abs(close - open) desc, symbol", "session_date, symbol")),
    Operator("srt_11", "with r as (select *, row_number() over (partition by session_date order by volume desc, symbol) as place from {daily}) select session_date, symbol, cast(place as int) as place from r where place between 2 and 6"),
    Operator("srt_12", "with l as (select symbol, cast(floor(high / 5) as bigint) as zone, count(*) as touches, max(session_date) as last_touch from {bars} group by symbol, floor(high / 5)), r as (select *, row_number() over (partition by symbol order by touches desc, last_touch desc, zone) as place from l) select symbol, zone, touches, last_touch from r where place <= 4"),
    Operator("srt_13", "with p as (select underlying, spot from {spots}), r as (select c.underlying, c.strike, case when c.strike < p.spot then 'support' else 'resistance' end as kind, row_number() over (partition by c.underlying, c.strike < p.spot order by abs(c.strike - p.spot), c.side) as place from {chain} c join p on p.underlying = c.underlying) select underlying, kind, strike from r where place = 1"),
    Operator("srt_14", "select distinct sector, symbol from {daily} order by sector, symbol"),
    Operator("srt_15", "with q as (select symbol, count(*) as days from {daily} group by symbol) select symbol, days from q order by days, symbol limit 10"),
    Operator("srt_16", "with c as (select session_date, symbol, close - open as contribution, row_number() over (partition by session_date order by abs(close - open) desc, symbol) as place from {daily}) select session_date, symbol, round(contribution, 6) as contribution from c where place <= 5"),
    Operator("srt_17", "with d as (select q.symbol, q.session_date as asked, o.session_date, abs(o.volume - q.volume) as distance from {daily} q join {daily} o on o.symbol = q.symbol and o.session_date < q.session_date), r as (select d.*, row_number() over (partition by symbol, asked order by distance, session_date) as place from d) select symbol, asked, session_date, distance from r where place <= 5"),
    Operator("srt_18", "with o as (select symbol, row_number() over (order by symbol) - 1 as k from (select distinct symbol from {daily}) x) select symbol, cast(floor(k / 45e0) as bigint) as shard from o"),
    Operator("srt_19", "with o as (select symbol, row_number() over (order by symbol) - 1 as k from (select distinct symbol from {daily}) x) select cast(floor(k / 10e0) as bigint) as batch, min(symbol) as first_symbol, count(*) as n from o group by floor(k / 10e0)"),
    Operator("set_01", "select symbol, session_date, slot, close from {bars} where slot < 12 union all select g.symbol, g.session_date, g.slot, g.close from {bars} g left join (select symbol, session_date, slot from {bars} where slot < 12) a on a.symbol = g.symbol and a.session_date = g.session_date and a.slot = g.slot where a.slot is null"),
    # Of each session and the one before it.
    Operator("set_02", "with n as (select session_date, lag(session_date) over (order by session_date) as before from (select distinct session_date from {daily}) x), a as (select n.session_date, d.symbol from n join {daily} d on d.session_date = n.before), b as (select n.session_date, d.symbol from n join {daily} d on d.session_date = n.session_date where n.before is not null) select session_date, symbol from a union select session_date, symbol from b"),
    Operator("set_03", "with n as (select session_date, lag(session_date) over (order by session_date) as before from (select distinct session_date from {daily}) x), a as (select n.session_date, d.symbol from n join {daily} d on d.session_date = n.before), b as (select n.session_date, d.symbol from n join {daily} d on d.session_date = n.session_date where n.before is not null) select session_date, symbol from a intersect select session_date, symbol from b"),
    Operator("set_04", "with n as (select session_date, lag(session_date) over (order by session_date) as before from (select distinct session_date from {daily}) x), a as (select n.session_date, d.symbol from n join {daily} d on d.session_date = n.before), b as (select n.session_date, d.symbol from n join {daily} d on d.session_date = n.session_date where n.before is not null) select session_date, symbol from a except select session_date, symbol from b"),
    Operator("set_05", "with t as (select session_date, symbol from (select session_date, symbol, row_number() over (partition by session_date order by volume desc, symbol) as k from {daily}) x where k <= 15), d as (select session_date, lag(session_date) over (order by session_date) as before_ from (select distinct session_date from t) y) select d.session_date, round(1 - cast(count(p.symbol) as double) / count(*), 6) as turnover from d join t on t.session_date = d.session_date left join t p on p.session_date = d.before_ and p.symbol = t.symbol where d.before_ is not null group by d.session_date"),
    Operator("set_07", "select doc_id as item, lang as published from {documents} where lang = 'en' union all select page_id as item, 'page' as published from {pages}"),
]
