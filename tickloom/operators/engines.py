"""Composite engines: features, anomalies, relationships, market state, similarity, levels, chains and multiple testing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.functions.trailing import trailing_middles
from tickloom.operators.expectation import expectation_sql
from tickloom.operators.windows import DAY, K
from tickloom.plans.dialect import Operator, spelled

#: A day's volume against the symbol's earlier days: median and scaled median deviation of at most sixty, at least five.
Z = """with g as (select symbol, session_date, sector, open, close, volume, @gathered(volume) over (partition by symbol order by session_date rows between 60 preceding and 1 preceding) as past from {daily}), m as (select g.*, @middle(past) as m from g),
  z as (select m.*, case when @length(past) >= 5 then (volume - m) / nullif(@middle(@deviations(past, m)) * 14826e-4, 0) end as z from m)"""

#: After Z: where volume and price disagree; the day's first by volume and drive.
DISAGREEMENT = ", r as (select symbol, session_date, case when count(close) over w >= 5 then (close - avg(close) over w) / nullif(stddev_pop(close) over w, 0) end as p from {daily} window w as (partition by symbol order by session_date rows between 60 preceding and 1 preceding)) select z.symbol, z.session_date, case when abs(p) < 1 and z >= 3 then 'VOLUME_WITHOUT_PRICE' when abs(p) >= 3 and abs(z) < 1 then 'PRICE_WITHOUT_VOLUME' end as disagreement from z join r on r.symbol = z.symbol and r.session_date = z.session_date"
LEADER = ", t as (select z.symbol, z.session_date, coalesce(z.z, 0) as vz, d.close - d.open as drive from z join {daily} d on d.symbol = z.symbol and d.session_date = z.session_date), s as (select *, row_number() over (partition by session_date order by round(vz + drive / 50, 6) desc, symbol) as place from t) select session_date, symbol, round(vz + drive / 50, 6) as score from s where place = 1"

EVENTS = """select 'evt_' || substr(@digest(cast(symbol as varchar(20)) || '|' || cast(session_date as varchar(10)) || '|' || measure), 1, 16) as event_id, symbol, session_date, measure, round(z, 6) as magnitude, case when abs(z) / 2 < 15e-1 then 'LOW' when abs(z) / 2 < 25e-1 then 'MEDIUM' else 'HIGH' end as severity,
          measure || case when z > 0 then ' above' else ' below' end || ' the median of ' || cast(n as varchar(9)) || ' days' as evidence, case when n < 10 then 'THIN_HISTORY' else 'OK' end as quality from z where abs(z) >= 2"""


def _over_z(rest: str):
    """Z and what follows it, with the middles of the sixty days before by one pass over sorted days."""
    z = "with z as (select t.*, case when n_volume >= 5 then (volume - median_volume) / nullif(mad_volume * 14826e-4, 0) end as z from {trailing} t)"

    def run(daily: DataFrame) -> DataFrame:
        trailing = trailing_middles(daily.select("symbol", "session_date", "sector", "open", "close", "volume"), "symbol", "session_date", ["volume"], 60)
        return daily.sparkSession.sql(spelled(z + rest, 0), daily=daily, trailing=trailing)

    return run


def _events(daily: DataFrame) -> DataFrame:
    """The text of eng_08, with the middles by one pass over sorted days for all three measures."""
    days = daily.selectExpr("symbol", "session_date", "volume", "close - open as move", "high - low as range")
    measures = ", ".join(f"'{m}', {m}, n_{m}, median_{m}, mad_{m} * 14826e-4" for m in ("volume", "move", "range"))
    z = f"""with e as (select symbol, session_date, stack(3, {measures}) as (measure, value, n, median, mad) from {{trailing}}),
        z as (select e.*, case when n >= 5 and mad > 1e-12 then (value - median) / mad end as z from e) """
    return daily.sparkSession.sql(spelled(z + EVENTS, 0), trailing=trailing_middles(days, "symbol", "session_date", ["volume", "move", "range"], 60))


OPERATORS = [
    Operator(
        "eng_04",
        """with d as (select symbol, session_date, sector, close - lag(close) over (partition by symbol order by session_date) as y from {daily}),
        x as (select d.*, ((sum(y) over s) - y) / nullif((count(y) over s) - 1, 0) as x, ((sum(y) over m) - y) / nullif((count(y) over m) - 1, 0) as i from d window s as (partition by session_date, sector), m as (partition by session_date)),
        f as (select symbol, session_date, y, x, i, count(case when x is not null then y end) over w as n, regr_slope(y, x) over w as b, @corr_over(y, x, w) as c, stddev_samp(case when x is not null then y end) over w as s,
          count(case when i is not null then y end) over w as ni, regr_slope(y, i) over w as bi, @corr_over(y, i, w) as ci from x window w as (partition by symbol order by session_date rows between 15 preceding and 1 preceding))
        select symbol, session_date, case when n >= 8 then round(b, 4) + 0e0 end as beta, case when n >= 8 then round(c, 4) + 0e0 end as correlation, case when n >= 8 then round(y - b * x, 3) + 0e0 end as residual,
          case when n >= 8 and abs(c) < 1 then round((y - b * x) / nullif(s * sqrt(1 - c * c), 0), 4) + 0e0 end as residual_z, case when ni >= 8 then round(bi, 4) + 0e0 end as index_beta, case when ni >= 8 then round(ci, 4) + 0e0 end as index_correlation,
          case when ni >= 8 then round(y - bi * i, 3) + 0e0 end as index_residual, case when n < 8 then 'NOT_ESTABLISHED' when abs(c) < 3e-1 then 'WEAK' else 'ESTABLISHED' end as status from f""",
    ),
    Operator("eng_05", "with s as (select sector, session_date, avg(close) as l from {daily} group by sector, session_date), p as (select a.session_date, a.sector as a, b.sector as b, a.l - b.l as spread from s a join s b on a.session_date = b.session_date and a.sector < b.sector) select session_date, a, b, case when count(spread) over w >= 10 then round((spread - (avg(spread) over w)) / nullif(stddev_pop(spread) over w, 0), 4) end as shift from p window w as (partition by a, b order by session_date rows between 20 preceding and 1 preceding)"),
    Operator("eng_06", Z + DISAGREEMENT, run=_over_z(DISAGREEMENT)),
    Operator(
        "eng_07",
        f"""with x as ({expectation_sql(slots=24, oldest=2, covered=0.8, lookback=20, least_basis=5)}), m as (select 'basis' as measure union all select 'put_call_oi' union all select 'atm_iv' union all select 'skew' union all select 'straddle'),
        v as (select x.underlying, x.session_date, x.slot, m.measure, case m.measure when 'basis' then basis_bps when 'put_call_oi' then put_call_oi when 'atm_iv' then atm_iv when 'skew' then skew else straddle_pct end as value from x cross join m),
        z as (select v.*, count(value) over w as n, avg(value) over w as mean, stddev_pop(value) over w as sd from v window w as (partition by underlying, session_date, measure order by slot rows between unbounded preceding and 1 preceding))
        select underlying, session_date, slot, measure, round(value, 6) + 0e0 as value, n, case when n >= 5 and sd > 1e-9 then round((value - mean) / sd, 4) + 0e0 end as z from z""".replace("{legs}", "{desk_legs}").replace("{returns}", "{desk_returns}").replace("{futures}", "{desk_futures}"),
    ),
    Operator(
        "eng_08",
        """with m as (select 'volume' as measure union all select 'move' union all select 'range'), v as (select d.symbol, d.session_date, m.measure, case m.measure when 'volume' then cast(volume as double) when 'move' then close - open else high - low end as value from {daily} d cross join m),
        g as (select v.*, @gathered(value) over (partition by symbol, measure order by session_date rows between 60 preceding and 1 preceding) as past from v), d as (select g.*, @middle(past) as median, @length(past) as n from g), e as (select d.*, @middle(@deviations(past, median)) * 14826e-4 as mad from d),
        z as (select e.*, case when n >= 5 and mad > 1e-12 then (value - median) / mad end as z from e)
        """
        + EVENTS,
        run=_events,
    ),
    Operator("eng_10", f"select {K}, round(@ln(@over(close, lag(close, 3) over w)), 6) + 0e0 as state_return, round(@ln(@over(lead(close, 3) over w, close)), 6) + 0e0 as outcome from {{grid}} window w as ({DAY})"),
    Operator("eng_17", "with r as (select underlying, side, iv, row_number() over (partition by underlying, side order by abs(strike - 25), strike) as k from {chain}) select underlying, round(max(case when side = 'CE' then iv end) - max(case when side = 'PE' then iv end), 6) as risk_reversal from r where k = 1 group by underlying"),
    Operator("eng_20", Z + LEADER, run=_over_z(LEADER)),
    Operator("eng_28", "with t as (select symbol, count(*) as n, avg(close - open) / nullif(stddev_samp(close - open) / sqrt(count(*)), 0) as t from {daily} group by symbol) select symbol, case when n < 20 then 'INSUFFICIENT' when t >= 2 then 'SUPPORTED' when t <= -2 then 'REVERSED' else 'UNPROVEN' end as verdict from t"),
    Operator("eng_36", "with l as (select symbol, 'high' as kind, max(high) as level from {daily} group by symbol union all select symbol, 'close', max(close) from {daily} group by symbol union all select symbol, 'open', max(open) from {daily} group by symbol) select a.symbol, a.kind as kind_a, b.kind as kind_b from l a join l b on a.symbol = b.symbol and a.kind < b.kind and abs(a.level - b.level) <= a.level * 15e-4"),
    Operator("eng_39", "select underlying, session_date, round(price, 4) as last_price, n, round(oi, 2) as oi, round(oi - lag(oi) over (partition by underlying order by session_date), 2) + 0e0 as oi_change from {snapshots}"),
    Operator("eng_40", "select symbol, session_date, cast(floor(slot / 3e0) as int) as three, cast(floor(slot / 12e0) as int) as twelve, max(high) as high, min(low) as low from {bars} group by symbol, session_date, floor(slot / 3e0), floor(slot / 12e0)"),
    Operator("eng_41", "select case when count(d.symbol) = count(*) then 'COMPLETE' else 'PARTIAL' end as coverage, count(*) as expected, count(d.symbol) as present from (select c_custkey as symbol from {customer}) u left join (select distinct symbol from {daily}) d on d.symbol = u.symbol"),
    Operator("eng_43", "with t as (select symbol, close - open as gross from {daily}), c as (select 3e-2 as cost union all select 7e-2 union all select 13e-2) select cost, count(*) as n, round(avg(gross - cost), 6) as net, count(*) filter (where gross > cost) as winners from t cross join c group by cost"),
    Operator("bkt_01", f"with t as (select symbol, session_date, slot + 1 as entry, lead(open) over w as price from {{grid}} window w as ({DAY})), e as (select t.symbol, t.session_date, t.entry, t.price, min(case when g.low <= t.price * 5e-1 then g.slot end) as stopped, min(case when g.high > t.price * 15e-1 then g.slot end) as reached from t join {{grid}} g on g.symbol = t.symbol and g.session_date = t.session_date and g.slot between t.entry and t.entry + 6 where t.price is not null group by t.symbol, t.session_date, t.entry, t.price) select symbol, session_date, entry, case when stopped is not null and (reached is null or stopped <= reached) then 'STOP' when reached is not null then 'TARGET' else 'TIME' end as exit_reason, least(coalesce(stopped, entry + 6), coalesce(reached, entry + 6)) as exit_slot from e"),
    Operator("bkt_04", "with t as (select symbol, session_date, round(100 * (close / nullif(open, 0) - 1), 6) as gross from {daily}), c as (select 'zero' as scenario, 0e0 as cost union all select 'low', 3e-2 union all select 'base', 7e-2 union all select 'high', 13e-2) select scenario, symbol, round(avg(gross - cost), 4) as net from t cross join c group by scenario, symbol"),
    Operator("bkt_08", "select slot, count(*) as n, round(avg(close - open), 6) as baseline from {bars} group by slot"),
    Operator("bkt_11", f"with p as (select {K}, open, close, low, min(low) over w as floor_ from {{grid}} window w as ({DAY} rows between 5 preceding and 1 preceding)) select {K} from p where low < floor_ and close > floor_"),
    Operator("bkt_16", f"with r as (select {K}, close, high - low as width, max(high) over w as top, max(high - low) over w as widest from {{grid}} window w as ({DAY} rows between 3 preceding and 1 preceding)) select {K} from r where close > top and widest < 100"),
]
