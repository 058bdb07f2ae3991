"""Tests and studies over days and trades: p-values, false discoveries, walk-forward windows, similarity and libraries of states."""

from __future__ import annotations

import hashlib

from tickloom.operators.windows import DAY
from tickloom.plans.dialect import Operator

#: Coefficients of a rational approximation of the complementary error function, good to seven digits.
ERFC = ("0.17087277", "-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223")


def two_sided(t: str) -> str:
    """SQL of the two-sided normal p-value of t."""
    x = f"(abs({t}) / sqrt(2e0))"
    u = f"(1 / (1 + 5e-1 * {x}))"
    power = f"{ERFC[0]}e0"
    for c in ERFC[1:]:
        power = f"({c}e0 + {u} * {power})"
    return f"({u} * exp(-{x} * {x} + {power}))"


#: The digest under which a definition was frozen.
DEFINED = hashlib.sha256(b"close > open").hexdigest()
#: Trades: a day of a symbol, its result, and its week.
TRADES = "t as (select symbol, sector, session_date, cast(floor((@days(session_date) + 3) / 7e0) as bigint) as week, close - open as x from {daily})"


def per_symbol(mean: str = "avg(x)") -> str:
    """SQL of a symbol's number of trades, mean and t."""
    return f"m as (select symbol, count(*) as n, {mean} as mean, avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) as t from t group by symbol having count(*) > 2)"


T = per_symbol()
P = f"p as (select symbol, n, mean, t, {two_sided('t')} as p from m where t is not null)"
RANKED = "k as (select p.*, row_number() over (order by p, symbol) as k, count(*) over () as m from p)"

#: Conditions and events of a bar; an event's outcome is the move of the three bars after it.
CONDITIONS = {
    "above_vwap": "close > vwap", "below_vwap": "close < vwap", "upper_half": "close > (day_high + day_low) / 2", "lower_half": "close <= (day_high + day_low) / 2", "rising": "close > pc", "falling": "close < pc",
    "heavy": "volume > usual", "light": "volume <= usual", "morning": "slot < 8", "midday": "slot >= 8 and slot < 16", "evening": "slot >= 16", "gap_up": "day_open > last_close", "gap_down": "day_open < last_close",
}
EVENTS = {
    "new_high": "high > ph", "new_low": "low < pl", "break_high": "close > ph", "break_low": "close < pl", "up_bar": "close > open", "down_bar": "close < open", "inside": "high < phigh and low > plow", "outside": "high > phigh and low < plow",
    "two_up": "close > pc and pc > ppc", "two_down": "close < pc and pc < ppc", "reversal_up": "close > pc and pc < ppc", "reversal_down": "close < pc and pc > ppc", "wide": "high - low > 2 * (phigh - plow)", "narrow": "2 * (high - low) < phigh - plow",
}
STATES = f"""b as (select *, sum(close * volume) over s / nullif(sum(volume) over s, 0) as vwap, max(high) over s as day_high, min(low) over s as day_low, first_value(open) over s as day_open, lag(close) over w as pc, lag(close, 2) over w as ppc, lag(high) over w as phigh, lag(low) over w as plow,
  max(high) over p as ph, min(low) over p as pl, avg(volume) over p as usual, (lead(close, 3) over w) - close as outcome, lag(close) over (partition by symbol order by session_date, slot) as before_ from {{bars}}
  window w as ({DAY}), s as ({DAY} rows between unbounded preceding and current row), p as ({DAY} rows between 5 preceding and 1 preceding)),
a as (select b.*, first_value(before_) over ({DAY} rows between unbounded preceding and current row) as last_close from b)"""
LONG = " union all ".join(f"select symbol, session_date, slot, '{k}' as state from a where {v}" for k, v in CONDITIONS.items())
HAPPENED = " union all ".join(f"select symbol, session_date, slot, outcome, '{k}' as event from a where {v}" for k, v in EVENTS.items())

OPERATORS = [
    Operator("agg_32", f"with {TRADES}, {T} select symbol, n, round(mean, 6) as mean, round(t, 6) as t, round({two_sided('t')}, 6) as p from m"),
    Operator(
        "eng_26",
        f"""with {TRADES}, {T}, {P}, {RANKED}
        select symbol, round(p, 6) as p, round(least(min(p * m / k) over (@onward(k)), 1e0), 6) as q_value, round(least(max(p * (m - k + 1)) over (order by k rows between unbounded preceding and current row), 1e0), 6) as holm from k""",
    ),
    Operator(
        "bkt_17",
        f"""with {TRADES}, {per_symbol("@avg_along(x, session_date)")}, {P}, {RANKED}, h as (select k.*, least(max(p * (m - k + 1)) over (order by k rows between unbounded preceding and current row), 1e0) as holm from k),
        y as (select symbol, count(*) as halves, count(case when s > 0 then 1 end) as good from (select symbol, @weekday(session_date) as half_, @sum_along(x, session_date) as s from t group by symbol, @weekday(session_date)) z group by symbol)
        select h.symbol, round(h.holm, 6) as holm, y.good, y.halves, case when h.n < 5 then 'INSUFFICIENT' when h.holm <= 5e-2 and h.mean > 0 and 2 * y.good > y.halves then 'CONFIRMED' when h.mean <= 0 then 'REJECTED' else 'UNPROVEN' end as verdict from h join y on y.symbol = h.symbol""",
    ),
    Operator(
        "bkt_10",
        f"""with {TRADES}, c as (select *, sum(x) over (partition by symbol order by session_date) as c from t), d as (select symbol, session_date, x, week, c, greatest(max(c) over (partition by symbol order by session_date rows between unbounded preceding and current row), 0) - c as down from c)
        select symbol, week, count(*) as n, round(avg(x), 6) as mean, round(avg(case when x > 0 then 1e0 else 0e0 end), 6) as win, round(max(down), 4) as drawdown from d group by symbol, week""",
    ),
    Operator(
        "bkt_09",
        f"""with {TRADES}, s as (select min(session_date) as d0, @days(max(session_date)) - @days(min(session_date)) + 1 as days_ from t), k as (select @each(0, 10) as k),
        w as (select k.k, s.d0, k.k * s.days_ / 17e0 as a, (k.k + 6) * s.days_ / 17e0 as b, (k.k + 7) * s.days_ / 17e0 as c from k cross join s),
        r as (select w.k, t.symbol, t.x, case when @days(t.session_date) - @days(w.d0) < w.b then 'train' else 'test' end as part from w join t on @days(t.session_date) - @days(w.d0) >= w.a and @days(t.session_date) - @days(w.d0) < w.c),
        m as (select k as window_, symbol, count(case when part = 'train' then x end) as n, avg(case when part = 'train' then x end) / nullif(stddev_samp(case when part = 'train' then x end) / sqrt(nullif(cast(count(case when part = 'train' then x end) as double), 0)), 0) as t, avg(case when part = 'test' then x end) as out_of_sample from r group by k, symbol),
        p as (select m.*, {two_sided('t')} as p from m where n > 2 and t is not null), q as (select p.*, row_number() over (partition by window_ order by p, symbol) as place, count(*) over (partition by window_) as tests from p)
        select window_, symbol, n, round(t, 4) as t, round(least(min(p * tests / place) over (partition by window_ @onward(place)), 1e0), 6) as q_value, round(out_of_sample, 6) as out_of_sample from q""",
    ),
    Operator(
        "bkt_20",
        f"""with {TRADES}, s as (select min(session_date) as a, max(session_date) as b from t), r as (select t.symbol, 2 * (@days(t.session_date) - @days(s.a)) < @days(s.b) - @days(s.a) as discovery, t.x, t.x - 7e-2 as net from t cross join s)
        select symbol, discovery, count(*) as n, round(avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0), 6) as t, round(avg(net), 6) as net from r group by symbol, discovery""",
    ),
    Operator(
        "bkt_05",
        f"""with {STATES}, c as ({LONG}), e as ({HAPPENED}) select e.event, c.state, count(*) as n, count(e.outcome) as outcomes, round(avg(e.outcome), 6) as mean, round(avg(case when e.outcome > 0 then 1e0 when e.outcome is not null then 0e0 end), 6) as win
        from e join c on c.symbol = e.symbol and c.session_date = e.session_date and c.slot = e.slot group by e.event, c.state""",
    ),
    Operator(
        "bkt_07",
        f"""with {STATES}, e as ({HAPPENED}), g as (select e.event, e.symbol, e.outcome, cast(floor((@days(e.session_date) + 3) / 7e0) as bigint) as week from e where outcome is not null), base as (select avg(outcome) as base from a),
        f as (select event, week, sum(outcome - base) as s from g cross join base group by event, week), k as (select event, sqrt(sum(s * s)) as se, count(*) as weeks from f group by event),
        m as (select event, count(*) as n, avg(outcome) as mean, avg(case when outcome > 0 then 1e0 else 0e0 end) as win, max(outcome) as best, min(outcome) as worst from g group by event)
        select m.event, m.n, k.weeks, round(m.mean - base, 6) as edge, round(m.n * (m.mean - base) / nullif(k.se, 0), 6) as clustered_t, round(m.win, 6) as win, round(m.best, 6) as mfe, round(m.worst, 6) as mae from m join k on k.event = m.event cross join base""",
    ),
    Operator(
        "bkt_18",
        f"""with {STATES}, o as (select symbol, session_date, max(high) as top, min(low) as bottom from {{bars}} where slot < 4 group by symbol, session_date), d as (select symbol, session_date, lag(high) over w as pdh, lag(low) over w as pdl from (select symbol, session_date, max(high) as high, min(low) as low from {{bars}} group by symbol, session_date) x window w as (partition by symbol order by session_date)),
        x as (select a.*, o.top, o.bottom, d.pdh, d.pdl from a left join o on o.symbol = a.symbol and o.session_date = a.session_date left join d on d.symbol = a.symbol and d.session_date = a.session_date),
        s as (select 'ORB' as pattern, symbol, session_date, slot, case when close > top then 1 else -1 end as side from x where slot >= 4 and (close > top or close < bottom)
          union all select 'ORB_TRAP', symbol, session_date, slot, case when pc > top then -1 else 1 end from x where slot >= 5 and ((pc > top and close <= top) or (pc < bottom and close >= bottom))
          union all select 'GAP_FADE', symbol, session_date, slot, case when day_open > last_close then -1 else 1 end from x where slot < 4 and last_close > 0 and abs(day_open / last_close - 1) >= 2e-1 and (close - day_open) * (day_open - last_close) < 0
          union all select 'GAP_GO', symbol, session_date, slot, case when day_open > last_close then 1 else -1 end from x where slot < 4 and last_close > 0 and abs(day_open / last_close - 1) >= 2e-1 and (close - day_open) * (day_open - last_close) > 0
          union all select 'PDHL', symbol, session_date, slot, case when close > pdh then 1 else -1 end from x where close > pdh or close < pdl
          union all select 'HOUR1', symbol, session_date, slot, case when close > day_open then 1 else -1 end from x where slot = 3 and close != day_open
          union all select 'LATE', symbol, session_date, slot, case when close > vwap then 1 else -1 end from x where slot >= 20 and close != vwap)
        select pattern, symbol, session_date, min(slot) as slot, min_by(side, slot) as side from s group by pattern, symbol, session_date""",
    ),
    Operator(
        "bkt_19",
        f"""with {STATES}, c as (select 'SLOT' as family, cast(slot as varchar(9)) as context, outcome, session_date from a union all select 'DOW', cast(@weekday(session_date) as varchar(9)), outcome, session_date from a union all select 'DOWSLOT', cast(@weekday(session_date) * 100 + slot as varchar(9)), outcome, session_date from a
          union all select 'MOTIF', case when close > open then 'U' else 'D' end || case when pc > ppc then 'U' else 'D' end, outcome, session_date from a where ppc is not null union all select 'OPEN', case when day_open > last_close then 'UP' else 'DOWN' end, outcome, session_date from a where slot < 2 and last_close is not null
          union all select 'HOUR1', case when close > day_open then 'UP' else 'DOWN' end, outcome, session_date from a where slot = 3)
        select family, context, count(*) as n, round(avg(outcome), 6) as mean, round(avg(outcome) / nullif(stddev_samp(outcome) / sqrt(count(*)), 0), 4) as t from c where outcome is not null group by family, context""",
    ),
    Operator(
        "bkt_06",
        f"""with {STATES}, e as ({HAPPENED}), c as ({LONG}) select 'EVENT' as family, event as hypothesis, count(*) as n from e group by event union all select 'STATE', state, count(*) from c group by state union all select 'SLOT', cast(slot as varchar(9)), count(*) from a group by slot
        union all select 'DOWSLOT', cast(@weekday(session_date) * 100 + slot as varchar(9)), count(*) from a group by @weekday(session_date) * 100 + slot
        union all select 'CANDLE', cast(case when abs(close - open) < 1 then 2 when close - open > 20 then 4 when close > open then 3 when open - close > 20 then 0 else 1 end as varchar(9)), count(*) from a group by case when abs(close - open) < 1 then 2 when close - open > 20 then 4 when close > open then 3 when open - close > 20 then 0 else 1 end
        union all select 'MOTIF', case when close > open then 'U' else 'D' end || case when pc > ppc then 'U' else 'D' end, count(*) from a where ppc is not null group by case when close > open then 'U' else 'D' end || case when pc > ppc then 'U' else 'D' end
        union all select 'OPEN', case when day_open > last_close then 'UP' else 'DOWN' end, count(*) from a where slot < 2 and last_close is not null group by case when day_open > last_close then 'UP' else 'DOWN' end""",
    ),
    Operator(
        "eng_32",
        """with c as (select median(@days(session_date)) as cut from (select distinct session_date from {daily}) x), a as (select symbol, session_date, close, avg(close) over w as mean, lag(close) over (partition by symbol order by session_date) as r, row_number() over (partition by symbol order by session_date) as k from {daily} window w as (partition by symbol order by session_date rows between 5 preceding and current row)),
        p as (select symbol, session_date, case when @days(session_date) > cut then close * 37e-1 else close end as close from {daily} cross join c), b as (select symbol, session_date, avg(close) over w as mean, lag(close) over (partition by symbol order by session_date) as r, row_number() over (partition by symbol order by session_date) as k from p window w as (partition by symbol order by session_date rows between 5 preceding and current row))
        select a.symbol, count(*) as checked, count(case when abs(a.mean - b.mean) > 1e-9 or a.k != b.k or a.r is distinct from b.r then 1 end) as changed from a join b on a.symbol = b.symbol and a.session_date = b.session_date cross join c where @days(a.session_date) <= c.cut group by a.symbol""",
    ),
    Operator(
        "eng_25",
        """with p as (select session_date, symbol, volume as signal, (lead(close) over w) - close as out_1, (lead(close, 3) over w) - close as out_3 from {daily} window w as (partition by symbol order by session_date)),
        r as (select session_date, symbol, out_1, rank() over (partition by session_date order by signal) + (count(*) over (partition by session_date, signal) - 1) / 2e0 as a, rank() over (partition by session_date order by out_1) + (count(*) over (partition by session_date, out_1) - 1) / 2e0 as b,
          rank() over (partition by session_date order by out_3) + (count(*) over (partition by session_date, out_3) - 1) / 2e0 as c, (rank() over (partition by session_date order by signal) - 5e-1) / count(*) over (partition by session_date) as place, out_3 from p where out_1 is not null and out_3 is not null),
        d as (select session_date, @corr(a, b) as ic_1, @corr(a, c) as ic_3, avg(case when place >= 8e-1 then out_1 end) - avg(case when place <= 2e-1 then out_1 end) as spread from r group by session_date having count(*) > 3)
        select count(*) as days_, round(avg(ic_1), 6) as mean_ic, round(avg(ic_1) / nullif(stddev_samp(ic_1) / sqrt(count(*)), 0), 6) as t, round(avg(ic_3), 6) as mean_ic_3, round(avg(spread), 6) as spread, round(avg(spread) - 14e-2, 6) as net from d""",
    ),
    Operator(
        "eng_09",
        """with f as (select session_date, slot, avg(close / nullif(open, 0) - 1) as m, coalesce(stddev_pop(close), 0) as d, avg(case when close > open then 1e0 else 0e0 end) as b from {bars} group by session_date, slot), o as (select f.*, lead(m) over (partition by session_date order by slot) as outcome from f),
        q as (select session_date as qd, slot as qs, m as qm, d as qv, b as qb from o where session_date = (select max(session_date) from f) and outcome is not null),
        c as (select q.*, o.session_date, o.slot, o.m, o.d, o.b, o.outcome from q join o on o.session_date < q.qd and o.slot between q.qs - 1 and q.qs + 1 where o.outcome is not null),
        s as (select qs, median(m) as mm, median(d) as md, median(b) as mb from c group by qs), z as (select c.qs, nullif(median(abs(c.m - s.mm)), 0) as sm, nullif(median(abs(c.d - s.md)), 0) as sd, nullif(median(abs(c.b - s.mb)), 0) as sb from c join s on s.qs = c.qs group by c.qs),
        x as (select c.*, round(sqrt(coalesce(power((c.m - qm) / z.sm, 2), 0) + coalesce(power((c.d - qv) / z.sd, 2), 0) + coalesce(power((c.b - qb) / z.sb, 2), 0)), 6) as distance from c join z on z.qs = c.qs),
        y as (select x.*, row_number() over (partition by qs, session_date order by distance, slot) as best from x), k as (select y.*, row_number() over (partition by qs order by distance, session_date) as place from y where best = 1), base as (select qs, avg(case when outcome > 0 then 1e0 else 0e0 end) as base_rate from c group by qs)
        select k.qs as query_slot, k.place, k.session_date, k.slot, k.distance, round(k.outcome, 6) as outcome, round(base.base_rate, 6) as base_rate from k join base on base.qs = k.qs where k.place <= 5""",
    ),
    Operator("agg_22", "with f as (select session_date, count(*) as found from {bars} where not (extract(day from session_date) % 7 = 0 and slot < 3) group by session_date), m as (select session_date, count(distinct symbol || ':' || cast(slot as varchar(9))) as stated from (select session_date, symbol, slot from {ticks}) x group by session_date) select m.session_date, coalesce(f.found, 0) as found, m.stated, coalesce(f.found, 0) = m.stated as matches from m left join f on f.session_date = m.session_date"),
    Operator("set_06", "with n as (select 0 as node, 0 as a, 400 as b union all select 1, 400, 800 union all select 2, 800, 100000000), u as (select distinct symbol from {daily}), p as (select u.symbol, count(n.node) as nodes from u left join n on u.symbol >= n.a and u.symbol < n.b group by u.symbol) select count(*) as universe, count(case when nodes = 1 then 1 end) as covered_once, max(nodes) <= 1 as disjoint, min(nodes) >= 1 as complete from p"),
    Operator("fn_37", "with d as (select r_regionkey, r_name, case r_regionkey when 1 then 'close > open ' else 'close > open' end as definition from {region}) select r_regionkey, @digest(definition) = '" + DEFINED + "' as locked from d"),
    Operator("flt_19", "select security, max(case when side = 'bid' and level = 1 then price end) > max(case when side = 'ask' and level = 1 then price end) as crossed from {book} where level = 1 group by security"),
    Operator("fn_19", "select symbol, session_date, round((high + low + close) / 3, 6) as pp, round(2 * (high + low + close) / 3 - low, 6) as r1, round(2 * (high + low + close) / 3 - high, 6) as s1, round((high + low + close) / 3 + (high - low), 6) as r2, round((high + low + close) / 3 - (high - low), 6) as s2, round(high + 2 * ((high + low + close) / 3 - low), 6) as r3, round(low - 2 * (high - (high + low + close) / 3), 6) as s3, round((high + low) / 2, 6) as bc, round(2 * (high + low + close) / 3 - (high + low) / 2, 6) as tc from {daily}"),
    Operator("agg_05", "select 'week' as period, symbol, cast(date_trunc('week', session_date) as date) as first_day, max(high) as high, min(low) as low, max_by(close, session_date) as close from {daily} group by symbol, cast(date_trunc('week', session_date) as date) union all select 'month', symbol, cast(date_trunc('month', session_date) as date), max(high), min(low), max_by(close, session_date) from {daily} group by symbol, cast(date_trunc('month', session_date) as date)"),
    Operator("flt_12", "select event_id, round(price, 4) as price, @in_zone(ts) || ' IST' as stamp from {ticks}"),
    Operator("flt_23", "select doc_id, @replaced(text, '(?i)(password|passwd|secret|token|api_?key)[\"'']? *[:=] *[\"'']?[A-Za-z0-9+/_.=-]+', '***') as redacted from {documents}"),
    Operator("eng_03", "with h as (select symbol, session_date, volume, count(*) over w as n, avg(volume) over w as m, stddev_pop(volume) over w as s, avg(volume) over (partition by sector, session_date) as sector_mean, stddev_pop(volume) over (partition by sector, session_date) as sector_s from {daily} window w as (partition by symbol order by session_date rows between unbounded preceding and 1 preceding)), b as (select *, case when n >= 10 and s > 0 then 'HISTORICAL' when sector_s > 0 then 'CROSS_SECTION' else 'NONE' end as baseline from h), z as (select *, case baseline when 'HISTORICAL' then (volume - m) / nullif(s, 0) when 'CROSS_SECTION' then (volume - sector_mean) / nullif(sector_s, 0) end as z from b) select symbol, session_date, round(z, 4) + 0e0 as z, baseline, case when z is null then 'NONE' when abs(z) >= 5 then 'EXTREME' when abs(z) >= 3 then 'UNUSUAL' else 'NORMAL' end as class from z"),
]
