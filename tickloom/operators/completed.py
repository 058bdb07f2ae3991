"""Market, level and trade summaries with all their parts."""

from __future__ import annotations

from tickloom.operators.windows import DAY, K, before
from tickloom.plans.dialect import Operator

OPERATORS = [
    Operator(
        "agg_06",
        """with p as (select session_date, symbol, close as ltp, high, low, lag(close) over w as pc, max(high) over h as ph, min(low) over h as pl from {daily} window w as (partition by symbol order by session_date), h as (partition by symbol order by session_date rows between unbounded preceding and 1 preceding)),
        c as (select session_date, count(*) filter (where ltp > pc) as advancing, count(*) filter (where ltp < pc) as declining, count(*) filter (where ltp = pc) as unchanged, count(*) filter (where pc is null) as unknown,
          count(*) filter (where high > ph) as new_highs, count(*) filter (where low < pl) as new_lows from p group by session_date)
        select *, round(cast(advancing as double) / nullif(declining, 0), 4) as ad_ratio from c""",
    ),
    Operator(
        "agg_37",
        """with t as (select symbol, session_date, close - open as x, sum(close - open) over (partition by symbol order by session_date rows unbounded preceding) as c from {daily}),
        d as (select *, greatest(max(c) over (partition by symbol order by session_date rows unbounded preceding), 0) - c as down, case when x < 0 then 0 else 1 end as up_, row_number() over (partition by symbol order by session_date) as i from t),
        l as (select symbol, count(*) as n from (select symbol, i - row_number() over (partition by symbol order by i) as g from d where up_ = 0) x group by symbol, g), r as (select symbol, max(n) as losing_run from l group by symbol)
        select d.symbol, count(*) as trades, round(100 * avg(case when x > 0 then 1e0 else 0e0 end), 4) as win_percent, round(avg(case when x > 0 then x end), 6) as mean_win, round(avg(case when x <= 0 then x end), 6) as mean_loss,
          round(sum(case when x > 0 then x else 0 end) / nullif(-sum(case when x < 0 then x else 0 end), 0), 6) as profit_factor, round(max(down), 4) as drawdown, coalesce(max(r.losing_run), 0) as losing_run from d left join r on r.symbol = d.symbol group by d.symbol""",
    ),
    Operator("jon_13", "with f as (select underlying, session_date, oi, price from {snapshots} where oi is not null and n % 3 != 0) select underlying, session_date, round(oi - lag(oi) over w, 2) + 0e0 as d_oi, round(price - lag(price) over w, 4) + 0e0 as d_price from f window w as (partition by underlying order by session_date)"),
    Operator(
        "jon_15",
        """with k as (select c.underlying, c.strike, min(abs(c.strike - s.spot)) as distance from {chain} c join {spots} s on s.underlying = c.underlying group by c.underlying, c.strike), r as (select *, row_number() over (partition by underlying order by round(distance, 6), strike) as k from k)
        select underlying, strike, side, k from (select c.underlying, c.strike, c.side, cast(r.k as int) as k, row_number() over (partition by c.underlying order by r.k, c.side) as place from r join {chain} c on c.underlying = r.underlying and c.strike = r.strike where r.k <= 30) x where place <= 50""",
    ),
    Operator("win_20", f"select {K}, count(close) over w = 10 and min(case when high = low then 1 else 0 end) over w = 1 as frozen from {{grid}} window w as ({DAY} rows between 9 preceding and current row)"),
    Operator("win_40", "with c as (select underlying, session_date, oi, floor(extract(day from session_date) / 10e0) as contract from {snapshots}) select underlying, session_date, case when contract = lag(contract) over w then round(oi - lag(oi) over w, 2) + 0e0 end as oi_change from c window w as (partition by underlying order by session_date)"),
    Operator(
        "win_42",
        f"""with d as (select {K}, volume, max(high) over ({DAY} rows between unbounded preceding and current row) - min(low) over ({DAY} rows between unbounded preceding and current row) as range_ from {{grid}}),
        u as (select {K}, volume, range_, @pctl(volume, 0.5) over {before(20, 'partition by symbol, slot order by session_date')} as usual, @pctl(range_, 0.5) over {before(20, 'partition by symbol, slot order by session_date')} as usual_range from d)
        select {K}, round(volume / nullif(usual, 0), 6) as relative_volume, round(range_ / nullif(usual_range, 0), 6) as range_ratio from u""",
    ),
    Operator(
        "eng_02",
        """with d as (select symbol, session_date, sector, volume, high, low, close, close / nullif(open, 0) - 1 as r, lag(close) over (partition by symbol order by session_date) as pc from {daily}), s as (select session_date, sector, median(r) as m from d group by session_date, sector),
        t as (select session_date, max(m) - min(m) as sector_spread, count(case when m > 0 then 1 end) as sectors_up from s group by session_date), i as (select session_date, max_by(level, slot) / nullif(min_by(level, slot), 0) - 1 as index_return from {market} group by session_date),
        m as (select session_date, median(r) as market_median, stddev_samp(r) as dispersion, avg(case when r > 0 then 1e0 else 0e0 end) as breadth, cast(count(case when close > pc then 1 end) as double) / nullif(count(case when close < pc then 1 end), 0) as ad_ratio, cast(sum(volume) as bigint) as volume, avg((high - low) / nullif(low, 0)) as mean_range, avg(abs(r)) as mean_move from d group by session_date)
        select m.session_date, round(market_median, 6) as market_median, round(dispersion, 4) as dispersion, round(breadth, 6) as breadth, round(ad_ratio, 6) as ad_ratio, m.volume, round(mean_range, 4) as mean_range, round(mean_move, 4) as mean_move, round(sector_spread, 6) as sector_spread, sectors_up, round(index_return, 6) as index_return
        from m join t on t.session_date = m.session_date join i on i.session_date = m.session_date""",
    ),
    Operator(
        "eng_33",
        """with w as (select symbol, cast(date_trunc('week', session_date) as date) as week, max(high) as h, min(low) as l from {daily} group by symbol, cast(date_trunc('week', session_date) as date)), pw as (select symbol, week, lag(h) over (partition by symbol order by week) as week_high, lag(l) over (partition by symbol order by week) as week_low from w),
        p as (select symbol, session_date, lag(high) over w as pdh, lag(low) over w as pdl, lag(close) over w as pdc, max(high) over m as high_20, min(low) over m as low_20 from {daily} window w as (partition by symbol order by session_date), m as (partition by symbol order by session_date rows between 20 preceding and 1 preceding))
        select p.symbol, p.session_date, pdh, pdl, pdc, round((pdh + pdl + pdc) / 3, 6) as pivot, round((pdh + pdl) / 2, 6) as cpr_bottom, round(2 * (pdh + pdl + pdc) / 3 - (pdh + pdl) / 2, 6) as cpr_top, high_20, low_20, pw.week_high, pw.week_low from p left join pw on pw.symbol = p.symbol and pw.week = cast(date_trunc('week', p.session_date) as date)""",
    ),
    Operator(
        "eng_34",
        f"""with o as (select symbol, session_date, max(high) as or_high, min(low) as or_low from {{bars}} where slot < 3 group by symbol, session_date),
        s as (select {K}, max(high) over s as session_high, min(low) over s as session_low, first_value(open) over s as session_open, sum(close * volume) over s / nullif(sum(volume) over s, 0) as vwap, case when high > lag(high) over w and high > lead(high) over w then high end as swing_high, case when low < lag(low) over w and low < lead(low) over w then low end as swing_low
          from {{bars}} window w as ({DAY}), s as ({DAY} rows between unbounded preceding and current row))
        select s.symbol, s.session_date, s.slot, session_open, session_high, session_low, round(vwap, 6) as vwap, case when s.slot >= 3 then o.or_high end as or_high, case when s.slot >= 3 then o.or_low end as or_low, @last_known(swing_high) over (partition by s.symbol, s.session_date order by s.slot rows between unbounded preceding and 1 preceding) as swing_high,
          @last_known(swing_low) over (partition by s.symbol, s.session_date order by s.slot rows between unbounded preceding and 1 preceding) as swing_low from s left join o on o.symbol = s.symbol and o.session_date = s.session_date""",
    ),
    Operator(
        "eng_37",
        """with r as (select underlying, side, strike, row_number() over (partition by underlying, side order by oi desc, strike) as place from {chain}), k as (select distinct underlying, strike from {chain}),
        p as (select k.underlying, k.strike, sum(case when c.side = 'CE' then c.oi * greatest(k.strike - c.strike, 0) else c.oi * greatest(c.strike - k.strike, 0) end) as pain from k join {chain} c on c.underlying = k.underlying group by k.underlying, k.strike), m as (select underlying, strike as max_pain from (select underlying, strike, row_number() over (partition by underlying order by round(pain, 2), strike) as place from p) x where place = 1)
        select r.underlying, max(case when side = 'CE' then r.strike end) as call_wall, max(case when side = 'PE' then r.strike end) as put_wall, max(m.max_pain) as max_pain from r join m on m.underlying = r.underlying where r.place = 1 group by r.underlying""",
    ),
]
