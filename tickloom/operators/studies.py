"""Blocks that put several operators together: chains, levels, views, picks, training records and prepared instruments."""

from __future__ import annotations

from tickloom.operators.statistics import RANKED, TRADES, two_sided
from tickloom.operators.windows import DAY
from tickloom.plans.dialect import Operator

Z = "z as (select symbol, sector, session_date, open, high, low, close, (volume - avg(volume) over w) / nullif(stddev_pop(volume) over w, 0) as vz, close / nullif(open, 0) - 1 as r from {daily} window w as (partition by session_date))"

OPERATORS = [
    Operator(
        "eng_38",
        """with t as (select underlying, sum(case when side = 'CE' then oi end) as call_oi, sum(case when side = 'PE' then oi end) as put_oi, sum(case when side = 'CE' then volume end) as call_volume, sum(case when side = 'PE' then volume end) as put_volume, avg(case when side = 'CE' then iv end) as call_iv, avg(case when side = 'PE' then iv end) as put_iv from {chain} group by underlying),
        k as (select distinct underlying, strike from {chain}), p as (select k.underlying, k.strike, sum(case when c.side = 'CE' then c.oi * greatest(k.strike - c.strike, 0) else c.oi * greatest(c.strike - k.strike, 0) end) as pain from k join {chain} c on c.underlying = k.underlying group by k.underlying, k.strike),
        m as (select underlying, strike as max_pain from (select *, row_number() over (partition by underlying order by round(pain, 2), strike) as k from p) x where k = 1),
        a as (select underlying, strike as atm from (select k.*, row_number() over (partition by k.underlying order by round(abs(k.strike - s.spot), 6), k.strike) as n from k join {spots} s on s.underlying = k.underlying) x where n = 1),
        w as (select underlying, max(case when side = 'CE' then strike end) as call_wall, max(case when side = 'PE' then strike end) as put_wall from (select *, row_number() over (partition by underlying, side order by oi desc, strike) as place from {chain}) x where place = 1 group by underlying)
        select t.underlying, a.atm, m.max_pain, w.call_wall, w.put_wall, round(t.put_oi / nullif(t.call_oi, 0), 6) as pcr_oi, round(t.put_volume / nullif(t.call_volume, 0), 6) as pcr_volume, round(t.call_iv - t.put_iv, 6) + 0e0 as iv_skew
        from t join a on a.underlying = t.underlying join m on m.underlying = t.underlying join w on w.underlying = t.underlying""",
    ),
    Operator(
        "eng_44",
        """with p as (select symbol, session_date, close, lag(high) over w as pdh, lag(low) over w as pdl, lag(close) over w as pdc, row_number() over (partition by symbol order by session_date desc) as k from {daily} window w as (partition by symbol order by session_date)),
        o as (select underlying, max(case when side = 'CE' then strike end) as call_wall, max(case when side = 'PE' then strike end) as put_wall from (select *, row_number() over (partition by underlying, side order by oi desc, strike) as place from {chain}) x where place = 1 group by underlying)
        select p.symbol, p.pdh, p.pdl, round((p.pdh + p.pdl + p.pdc) / 3, 6) as pivot, o.call_wall, o.put_wall from p left join o on o.underlying = p.symbol % 5 where p.k = 1""",
    ),
    Operator(
        "eng_31",
        f"""with l as (select *, row_number() over (partition by symbol order by session_date desc, slot desc) as k, lag(close) over (partition by symbol order by session_date, slot) as pc, first_value(open) over ({DAY} rows between unbounded preceding and current row) as day_open from {{bars}}), n as (select max(session_date) as today from {{bars}})
        select symbol, session_date, slot, close, round(100 * (close / nullif(pc, 0) - 1), 4) + 0e0 as change_pct, round(100 * (close / nullif(day_open, 0) - 1), 4) + 0e0 as since_open_pct, @days(today) - @days(session_date) as age_days from l cross join n where k = 1""",
    ),
    Operator(
        "eng_42",
        f"""with {TRADES}, m as (select cast(symbol as varchar(20)) || ':' || cast(@weekday(session_date) as varchar(3)) as symbol, count(*) as n, avg(x) as mean, avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) as t from t group by symbol, @weekday(session_date) having count(*) > 2),
        p as (select symbol, n, mean, t, {two_sided('t')} as p from m where t is not null), {RANKED}, q as (select k.*, least(min(p * m / k) over (@onward(k)), 1e0) as q from k)
        select symbol as hypothesis, n, round(t, 6) as t, round(q, 6) as q_value, case when q <= 1e-1 and mean > 0 then 'A' when p <= 5e-2 and mean > 0 then 'B' when mean > 0 then 'C' else 'NONE' end as tier from q""",
    ),
    Operator(
        "bkt_23",
        """with d as (select symbol, sector, session_date, close, close / nullif(lag(close) over w, 0) - 1 as r from {daily} window w as (partition by symbol order by session_date)), s as (select sector, session_date, sum(r) as total, count(r) as n from d group by sector, session_date), m as (select session_date, avg(r) as market from d group by session_date),
        x as (select d.*, (s.total - d.r) / nullif(s.n - 1, 0) as sector_r, m.market from d join s on s.sector = d.sector and s.session_date = d.session_date join m on m.session_date = d.session_date)
        select symbol, session_date, round(sector_r, 6) + 0e0 as sector_r, case when count(case when r is not null then market end) over b >= 10 then round(regr_slope(r, market) over b, 4) + 0e0 end as beta, case when count(close) over b < 10 then 'NONE' when close > avg(close) over b then 'UP' else 'DOWN' end as regime from x window b as (partition by symbol order by session_date rows between 15 preceding and 1 preceding)""",
    ),
    Operator(
        "bkt_24",
        """with s as (select @each(0, 9) as symbol from {region} where r_regionkey = 0), m as (select @each(0, 99) as minute), n as (select symbol, minute, (@hash_part('7:' || cast(symbol as varchar(9)) || ':' || cast(minute as varchar(9))) % 2001 - 1000) / 1e4 as step, @hash_part('v:' || cast(symbol as varchar(9)) || ':' || cast(minute as varchar(9))) % 1000 as volume from s cross join m)
        select symbol, minute, round(100 + sum(step + case when symbol = 3 and minute >= 50 then 12e-2 else 0e0 end) over (partition by symbol order by minute rows unbounded preceding), 6) as close, volume from n""",
    ),
    Operator(
        "ind_27",
        """with l as (select symbol, session_date, slot, close, volume, row_number() over (partition by symbol order by session_date desc, slot desc) as k from {bars}), c as (select median(@days(session_date)) as cut from (select distinct session_date from {bars}) x),
        n as (select symbol, @digest(cast(session_date as varchar(10)) || ':' || cast(slot as varchar(3)) || ':' || cast(volume as varchar(20))) as fingerprint from l where k = 1),
        o as (select symbol, session_date, slot, volume, row_number() over (partition by symbol order by session_date desc, slot desc) as k from {bars} cross join c where @days(session_date) <= cut or length(symbol) > 6), p as (select symbol, @digest(cast(session_date as varchar(10)) || ':' || cast(slot as varchar(3)) || ':' || cast(volume as varchar(20))) as fingerprint from o where k = 1)
        select n.symbol, p.fingerprint is null or p.fingerprint != n.fingerprint as recompute from n left join p on p.symbol = n.symbol""",
    ),
]
