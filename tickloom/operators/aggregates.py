"""Aggregations: bars, breadth, robust statistics, chains, coverage and trade summaries."""

from __future__ import annotations

from tickloom.plans.dialect import Operator

OPERATORS = [
    Operator("agg_01", "select symbol, session_date, slot, open, high, low, close, volume, n from {bars}"),
    Operator("agg_02", "select symbol, session_date, cast(floor(slot / 5e0) as int) as bucket, min_by(open, slot) as open, max(high) as high, min(low) as low, max_by(close, slot) as close, cast(sum(volume) as bigint) as volume from {bars} group by symbol, session_date, floor(slot / 5e0)"),
    Operator("agg_03", "select symbol, session_date, cast(floor(slot / 5e0) as int) as bucket, count(close) as bars, max(high) as high, min(low) as low from {grid} group by symbol, session_date, floor(slot / 5e0)"),
    Operator(
        "agg_04",
        """with b as (select symbol, session_date, slot - slot % 2 as slot, min_by(open, slot) as open, max(high) as high, min(low) as low, max_by(close, slot) as close from {bars} group by symbol, session_date, slot - slot % 2)
        select symbol, session_date, slot - slot % 6 as bucket, min_by(open, slot) as open, max(high) as high, min(low) as low, max_by(close, slot) as close from b group by symbol, session_date, slot - slot % 6""",
    ),
    Operator(
        "agg_07",
        """with p as (select symbol, sector, session_date, close / nullif(lag(close) over (partition by symbol order by session_date), 0) - 1 as change from {daily})
        select sector, session_date, round(median(change), 6) as median_change, count(*) filter (where change > 0) as up, count(*) filter (where change < 0) as down, count(*) as members, @listed(lpad(cast(symbol as varchar(20)), 8, '0')) as constituents
        from p group by sector, session_date""",
    ),
    Operator("agg_08", "select symbol, session_date, max(high) as high, min(low) as low from {bars} group by symbol, session_date"),
    Operator(
        "agg_09",
        """with p as (select session_date, volume, close, close / nullif(lag(close) over (partition by symbol order by session_date), 0) - 1 as change from {daily})
        select session_date, round(median(change), 6) as middle, round(stddev_samp(change), 6) as dispersion, round(avg(case when change > 0 then 1e0 when change is not null then 0e0 end), 6) as breadth,
          round(avg(case when volume > 100 then 1e0 else 0e0 end), 6) as active, round(sum(close * volume), 2) as turnover from p group by session_date""",
    ),
    Operator("agg_10", "select sector, session_date, round(median(close - open), 6) as middle, count(*) as n from {daily} group by sector, session_date"),
    Operator("agg_11", "select symbol, session_date, case when count(close) over w > 1 then round(((sum(cast(round(close * 100) as bigint)) over w) - round(close * 100)) / ((count(close) over w) - 1e0), 4) end as others_mean from {daily} window w as (partition by session_date, sector)"),
    Operator(
        "agg_12",
        """with r as (select symbol, session_date, sector, close, row_number() over (partition by session_date, sector order by close, symbol) as k, count(*) over (partition by session_date, sector) as n from {daily}),
        pos as (select *, cast(floor((n - 1 + 1) / 2e0) as bigint) as lo, cast(floor((n - 1 + 2) / 2e0) as bigint) as hi from r where n > 1)
        select a.symbol, a.session_date, round((l.close + h.close) / 2, 6) as others_median from pos a
        join r l on l.session_date = a.session_date and l.sector = a.sector and l.k = a.lo + case when a.k <= a.lo then 1 else 0 end
        join r h on h.session_date = a.session_date and h.sector = a.sector and h.k = a.hi + case when a.k <= a.hi then 1 else 0 end""",
    ),
    Operator(
        "agg_13",
        """with m as (select symbol, price, median(price) over (partition by symbol) as m from {ticks})
        select symbol, round(max(m), 6) as middle, round(median(abs(price - m)) * 14826e-4, 6) as scaled_mad from m group by symbol""",
    ),
    Operator(
        "agg_14",
        """with offs as (select cast(o as int) as o from (select @each(-2, 2) as o) x), p as (select b.symbol, b.slot + o as slot, b.close, b.slot as own, b.session_date from {bars} b cross join offs),
        m as (select *, median(close) over (partition by symbol, slot) as m from p where slot between 0 and 23)
        select symbol, slot, round(max(m), 6) as middle, round(median(abs(close - m)) * 14826e-4, 6) as scale, count(distinct case when own = slot then session_date end) as sessions from m group by symbol, slot""",
    ),
    Operator("agg_15", "select symbol, session_date, count(close) as bars, round(avg(close), 6) as mean_close, cast(coalesce(sum(volume), 0) as bigint) as volume, max(high) as high, min(low) as low from {grid} group by symbol, session_date"),
    Operator(
        "agg_16",
        """with c as (select symbol, session_date, slot, coalesce(sum(volume) over (partition by symbol, session_date order by slot rows between unbounded preceding and current row), 0) as total from {grid})
        select symbol, slot, cast(median(total) as double) as usual_total from c group by symbol, slot""",
    ),
    Operator("agg_17", "select symbol, round(@pctl(price, 0.1), 6) as p10, round(@pctl(price, 0.25), 6) as p25, round(@pctl(price, 0.5), 6) as p50, round(@pctl(price, 0.75), 6) as p75, round(@pctl(price, 0.9), 6) as p90, round(avg(price), 6) as mean, count(*) as n from {ticks} group by symbol"),
    Operator(
        "agg_18",
        """with u as (select close, symbol % 2 as side, rank() over (order by close) + (count(*) over (partition by close) - 1) / 2e0 as r from {daily}),
        s as (select sum(case when side = 1 then r end) as ra, count(*) filter (where side = 1) as na, count(*) filter (where side = 0) as nb from u)
        select round((ra - na * (na + 1) / 2e0) / nullif(cast(na as double) * nb, 0), 6) as separation from s""",
    ),
    Operator(
        "agg_19",
        """with v as (select symbol, session_date, volume, count(*) over (partition by symbol) as n, rank() over (partition by symbol order by volume) - 1 as below, count(*) over (partition by symbol, volume) as ties from {daily})
        select symbol, session_date, round((below + 5e-1 * ties) / n, 6) as percentile from v""",
    ),
    Operator(
        "agg_20",
        """with s as (select symbol, session_date, count(close) as present, max(case when close is not null then slot end) as last_slot from {grid} group by symbol, session_date)
        select session_date, count(*) filter (where present = 24) as complete, count(*) filter (where present between 1 and 23) as gaps, count(*) filter (where present = 0) as no_data, round(sum(present) / (count(*) * 24e0), 6) as coverage from s group by session_date""",
    ),
    Operator("agg_21", "select session_date, count(*) - count(distinct ts) as duplicates, count(*) filter (where price <= 0) as invalid, count(*) filter (where slot < 9 or slot > 15) as outside_session, count(*) as n from {ticks} group by session_date"),
    Operator(
        "agg_23",
        """with s as (select symbol, session_date, count(close) as present, count(*) filter (where volume = 0) as quiet from {grid} group by symbol, session_date)
        select symbol, round(@pctl(present, 0.5), 4) as middle, min(present) as least, max(present) as most, cast(sum(quiet) as bigint) as zero_volume, round(avg(present) / 24, 6) as coverage from s group by symbol""",
    ),
    Operator(
        "agg_24",
        """with c as (select underlying, sum(case when side = 'CE' then oi else 0 end) as ce_oi, sum(case when side = 'PE' then oi else 0 end) as pe_oi, sum(case when side = 'CE' then volume else 0 end) as ce_v,
          sum(case when side = 'PE' then volume else 0 end) as pe_v, avg(case when side = 'CE' then iv end) as ce_iv, avg(case when side = 'PE' then iv end) as pe_iv from {chain} group by underlying)
        select underlying, round(ce_oi, 2) as ce_oi, round(pe_oi, 2) as pe_oi, round(pe_oi / nullif(ce_oi, 0), 6) as pcr_oi, round(pe_v / nullif(ce_v, 0), 6) as pcr_volume, round(pe_iv - ce_iv, 6) as iv_skew from c""",
    ),
    Operator(
        "agg_25",
        """with k as (select distinct underlying, strike as settle from {chain}), p as (select k.underlying, k.settle,
          round(sum(case when c.side = 'CE' then c.oi * greatest(k.settle - c.strike, 0e0) else c.oi * greatest(c.strike - k.settle, 0e0) end), 2) as pay from k join {chain} c on c.underlying = k.underlying group by k.underlying, k.settle),
        r as (select *, row_number() over (partition by underlying order by pay, settle) as place from p)
        select underlying, settle as max_pain, pay from r where place = 1""",
    ),
    Operator("agg_26", "select security, count(*) filter (where quantity is null) as missing, count(*) - count(distinct side || cast(level as varchar(5))) as repeated, max(case when side = 'bid' and level = 1 then price end) > max(case when side = 'ask' and level = 1 then price end) as crossed from {book} group by security"),
    Operator(
        "agg_27",
        """with v as (select symbol, session_date, slot, r * r as v, sum(r * r) over (partition by symbol, session_date order by slot rows between unbounded preceding and current row) as used, sum(r * r) over (partition by symbol, session_date) as total from {returns})
        select symbol, slot, round(@pctl(used / nullif(total, 0), 0.25), 6) as q25, round(@pctl(used / nullif(total, 0), 0.5), 6) as q50, round(@pctl(used / nullif(total, 0), 0.75), 6) as q75 from v group by symbol, slot""",
    ),
    Operator("agg_28", "select symbol, session_date, case when count(*) >= 10 then round(@corr(abs(r), ln(volume)), 6) end as correlation from {returns} where r is not null and volume > 0 group by symbol, session_date"),
    Operator(
        "agg_29",
        """with d as (select symbol, session_date, slot, close - lag(close) over w as d from {bars} window w as (partition by symbol, session_date order by slot)), e as (select *, lag(d) over (partition by symbol, session_date order by slot) as e from d),
        c as (select symbol, count(*) as n, covar_samp(d, e) as c from e where d is not null and e is not null group by symbol)
        select symbol, case when n >= 10 then round(2 * sqrt(greatest(-c, 0e0)), 6) end as roll_spread from c""",
    ),
    Operator(
        "agg_31",
        """with p as (select session_date, volume as x, close - open as y from {daily}), r as (select session_date, rank() over (partition by session_date order by x) + (count(*) over (partition by session_date, x) - 1) / 2e0 as rx,
          rank() over (partition by session_date order by y) + (count(*) over (partition by session_date, y) - 1) / 2e0 as ry from p)
        select session_date, round(@corr(rx, ry), 6) + 0e0 as ic, count(*) as n from r group by session_date""",
    ),
    Operator(
        "agg_33",
        """with x as (select sector, cast(floor((@days(session_date) + 3) / 7e0) as bigint) as week, close - open as x from {daily}), m as (select *, avg(x) over (partition by sector) as m from x),
        g as (select sector, week, sum(x - m) as s, count(*) as n, max(m) as m from m group by sector, week), c as (select sector, max(m) as mean, sum(s * s) as ss, count(*) as g, sum(n) as n from g group by sector)
        select sector, round(mean, 6) as mean, round(sqrt(ss * g / (g - 1e0)) / n, 6) as se, round(mean / nullif(sqrt(ss * g / (g - 1e0)) / n, 0), 6) as t from c where g > 1""",
    ),
    Operator(
        "agg_34",
        """with g as (select sector, count(*) as n, avg(close) as m, var_pop(close) * count(*) as ss from {daily} group by sector), t as (select sum(n) as nn, sum(n * m) / sum(n) as mm, count(*) as k, sum(ss) as within_, sum(n * n) as n2 from g),
        b as (select max(t.nn) as nn, max(t.k) as k, max(t.within_) as within_, max(t.n2) as n2, sum(g.n * (g.m - t.mm) * (g.m - t.mm)) as between_ from t cross join g)
        select round(((between_ / (k - 1)) - within_ / (nn - k)) / ((between_ / (k - 1)) + ((nn - cast(n2 as double) / nn) / (k - 1) - 1) * within_ / (nn - k)), 6) as icc from b""",
    ),
    Operator(
        "agg_35",
        """with c as (select symbol, count(*) as n, cast(count(*) filter (where close > open) as double) / count(*) as p from {daily} group by symbol)
        select symbol, n, round((p + 3841459e-6 / (2 * n) - 1959964e-6 * sqrt(p * (1 - p) / n + 3841459e-6 / (4e0 * n * n))) / (1 + 3841459e-6 / n), 6) as low, round((p + 3841459e-6 / (2 * n) + 1959964e-6 * sqrt(p * (1 - p) / n + 3841459e-6 / (4e0 * n * n))) / (1 + 3841459e-6 / n), 6) as high from c""",
    ),
    Operator(
        "agg_36",
        """with c as (select symbol, session_date, sum(close - open) over (partition by symbol order by session_date rows between unbounded preceding and current row) as c from {daily}),
        p as (select symbol, c, greatest(max(c) over (partition by symbol order by session_date rows between unbounded preceding and current row), 0e0) as peak from c)
        select symbol, round(max(peak - c), 6) as drawdown from p group by symbol""",
    ),
    Operator(
        "agg_38",
        """with d as (select sector, cast(symbol % 3 as int) as model, case when close > open then 'UP' else 'DOWN' end as state, close - open as x from {daily})
        select sector, model, state, count(*) as n, round(avg(x), 6) as mean from d group by grouping sets ((sector), (model), (state))""",
    ),
    Operator("agg_39", "select sector, symbol, count(*) as n, round(avg(close - open), 6) as mean from {daily} group by rollup (sector, symbol)"),
    Operator(
        "agg_40",
        """with z as (select sector, (volume - avg(volume) over (partition by symbol)) / nullif(stddev_pop(volume) over (partition by symbol), 0) as z from {daily})
        select sector, count(*) filter (where abs(z) < 15e-1) as normal, count(*) filter (where abs(z) >= 15e-1 and abs(z) < 2) as unusual, count(*) filter (where abs(z) >= 2) as extreme from z group by sector""",
    ),
    Operator(
        "agg_41",
        """with p as (select session_date, abs(close - open) as c, row_number() over (partition by session_date order by abs(close - open) desc, symbol) as k from {daily})
        select session_date, round(sum(case when k <= 10 then c end) / nullif(sum(c), 0), 6) as concentration from p group by session_date""",
    ),
    Operator("agg_43", "with g as (select user_id, @seconds(ts) - lag(@seconds(ts)) over (partition by user_id order by ts) as gap from {ticks}) select user_id, cast(median(gap) as double) as middle_gap, count(*) filter (where gap <= 3600) >= 5 as supported from g group by user_id"),
    Operator("agg_44", "select symbol, case when count(*) >= 5 then round(regr_slope(close - open, cast(volume as double)), 9) end as impact from {bars} group by symbol"),
    Operator(
        "agg_45",
        """with b as (select symbol, case when price < 10 then 10 when price < 25 then 25 when price < 50 then 50 when price < 100 then 100 else 1000 end as bound from {ticks}), h as (select symbol, bound, count(*) as n from b group by symbol, bound),
        c as (select symbol, bound, sum(n) over (partition by symbol order by bound) as upto, sum(n) over (partition by symbol) as total from h)
        select symbol, min(case when upto >= 5e-1 * total then bound end) as p50, min(case when upto >= 9e-1 * total then bound end) as p90, min(case when upto >= 99e-2 * total then bound end) as p99 from c group by symbol""",
    ),
    Operator("agg_46", "select symbol, cast(row_number() over (order by @exact_sum(volume * coalesce(close, open)) desc, @nulls_last(symbol)) as int) as place, round(@exact_sum(volume * coalesce(close, open)), 2) as value from {daily} group by symbol"),
    Operator(
        "agg_47",
        """with d as (select symbol, open, close, high, low, lag(close) over (partition by symbol order by session_date) as pc from {daily})
        select symbol, round(avg(case when open > pc then case when low <= pc then 1e0 else 0e0 end when open < pc then case when high >= pc then 1e0 else 0e0 end end), 6) as gap_fill, round(avg(case when close > open then 1e0 else 0e0 end), 6) as up_days from d group by symbol""",
    ),
    Operator(
        "agg_48",
        """with d as (select cast(date_trunc('month', session_date) as date) as window_start, sector, close - open as x from {daily})
        select window_start, sector, count(*) as n, round(avg(x), 6) as mean from d group by grouping sets ((window_start), (sector), ())""",
    ),
    Operator("agg_49", "select session_date, n from (select session_date, count(*) as n from {ticks} group by session_date) x order by n desc, session_date limit 10"),
    Operator("agg_50", "select round(avg(case when open is null then 1e0 else 0e0 end), 6) as open_missing, round(avg(case when close is null then 1e0 else 0e0 end), 6) as close_missing, round(avg(case when volume is null then 1e0 else 0e0 end), 6) as volume_missing from {grid}"),
    Operator("agg_51", "select count(*) as n, count(distinct session_date) as sessions, max(session_date) as latest from {ticks}"),
    Operator(
        "agg_52",
        """with s as (select session_date, row_number() over (order by session_date desc) as k from (select distinct session_date from {ticks}) x), c as (select t.symbol, count(*) as n from {ticks} t join s on s.session_date = t.session_date where s.k between 2 and 6 group by t.symbol)
        select symbol, n as prior_occurrences from c""",
    ),
    Operator(
        "agg_53",
        """with p as (select sector, cast(floor((@days(session_date) + 3) / 7e0) as bigint) as week, avg(close - open) as m from {daily} group by sector, floor((@days(session_date) + 3) / 7e0))
        select sector, cast(greatest(count(*) filter (where m > 0), count(*) filter (where m < 0)) as bigint) as agree, count(*) as periods from p group by sector""",
    ),
    Operator(
        "agg_54",
        """with s as (select symbol, session_date, case when close > open then 1 when close < open then -1 end as s from {daily})
        select symbol, session_date, case when count(s) over w >= 5 then round(cast(abs(sum(s) over w) as double) / count(s) over w, 6) end as agreement from s window w as (partition by symbol order by session_date rows between 9 preceding and current row)""",
    ),
    Operator("agg_55", "select symbol, session_date, case when count(close) over w >= 10 then round(sum(close - open) over w / nullif(stddev_samp(close - open) over w * sqrt(count(close) over w), 0), 6) end as drift_z from {daily} window w as (partition by symbol order by session_date rows between 20 preceding and 1 preceding)"),
    Operator("agg_56", "select sector, count(distinct symbol) as symbols, count(*) filter (where volume > 100) as active, count(*) as n from {daily} group by sector"),
    Operator("agg_57", "select cast(extract(year from session_date) as int) as year_, count(distinct session_date) as sessions, count(distinct case when @weekday(session_date) < 5 then session_date end) as weekdays from {ticks} group by extract(year from session_date)"),
    Operator(
        "agg_58",
        """with s as (select symbol, session_date, case when count(close) = 24 then 'KEPT' when count(close) >= 22 then 'KEPT_FILLED' else 'EXCLUDED' end as status from {grid} group by symbol, session_date)
        select symbol, count(*) filter (where status = 'KEPT') as kept, count(*) filter (where status = 'KEPT_FILLED') as filled, count(*) filter (where status = 'EXCLUDED') as excluded from s group by symbol""",
    ),
    Operator(
        "agg_59",
        """with t as (select symbol, avg(close - open) / nullif(stddev_samp(close - open) / sqrt(count(*)), 0) as t from {daily} group by symbol having count(*) > 2)
        select count(*) as n, count(*) filter (where abs(t) >= 1) as t1, count(*) filter (where abs(t) >= 2) as t2, count(*) filter (where abs(t) >= 3) as t3 from t""",
    ),
    Operator("agg_60", "select session_date, count(*) as with_bar, round(stddev_pop(close / nullif(open, 0) - 1) * 10000, 4) as dispersion_bps, round(avg(case when close > open then 1e0 else 0e0 end), 6) as breadth from {daily} group by session_date"),
]
