"""Row validation: predicates, accepted rows and reasons of rejection, freshness and coverage classes."""

from __future__ import annotations

from tickloom.operators.windows import DAY, K
from tickloom.plans.dialect import Operator

GEOMETRY = "high >= greatest(open, close) and low <= least(open, close) and high >= low and volume >= 0"

OPERATORS = [
    Operator("flt_01", f"select symbol, session_date, slot, open, high, low, close, volume from {{bars}} where {GEOMETRY}"),
    Operator(
        "flt_02",
        """with r as (select event_id, symbol, session_date, slot, case when ts is null then 'bad_timestamp' when price is null or size is null then 'missing_value' when price <= 1 then 'invalid_ohlc'
          when row_number() over (partition by symbol, session_date, slot order by ts, event_id) > 1 then 'duplicate_minute' end as reason from {ticks})
        select event_id, symbol, coalesce(reason, 'accepted') as reason from r""",
    ),
    Operator("flt_03", "select symbol, session_date, slot from {bars} where not (volume < 50 and n = 1 and open = high and high = low and low = close)"),
    Operator("flt_04", "select symbol, count(*) = count(distinct ts) as unique_times, min(price) > 0 as positive, case when count(*) = count(distinct ts) then 'ok' else 'duplicate' end as status from {ticks} group by symbol"),
    Operator("flt_05", "select event_id, symbol, session_date, slot from {ticks} where slot >= 9 and slot < 15 and @weekday(session_date) < 5"),
    Operator("flt_06", "select symbol, session_date, slot, close from {bars} where session_date = date '2024-01-15' and slot * 60 + 60 <= 13 * 60"),
    Operator("flt_07", "select coalesce(case when price is null then 'malformed' when price <= 0 then 'non_positive' when slot < 9 or slot >= 16 then 'outside_session_day' end, 'accepted') as reason, count(*) as n from {ticks} group by coalesce(case when price is null then 'malformed' when price <= 0 then 'non_positive' when slot < 9 or slot >= 16 then 'outside_session_day' end, 'accepted')"),
    Operator("flt_08", "select event_id, case when size <= 50 then @seconds(ts) when abs(size - 75) <= 5 then @seconds(ts) - 19800 end as moment from {ticks}"),
    Operator(
        "flt_09",
        """with c as (select event_id, @seconds(ts) as moment, slot * 3600 as clock from {ticks}), d as (select event_id, moment, clock + 86400 * (cast(floor(moment / 86400e0) as bigint) + k) as candidate from c cross join (select -1 as k union all select 0 union all select 1) x),
        r as (select *, row_number() over (partition by event_id order by abs(candidate - moment), candidate) as place from d)
        select event_id, cast(candidate as bigint) as nearest from r where place = 1""",
    ),
    Operator("flt_10", f"select symbol, session_date, slot, close from {{bars}} where open > 0 and close > 0 and high < 1000000 and {GEOMETRY} and slot >= 9"),
    Operator(
        "flt_11",
        """with r as (select symbol, case when price is null then 'non_numeric' when slot < 9 or slot >= 16 then 'outside_session' when price < 1 then 'invalid_ohlc' else 'accepted' end as reason from {ticks})
        select symbol, reason, count(*) as n from r group by symbol, reason""",
    ),
    Operator("flt_13", "select symbol, session_date, close, volume from {bars} where symbol in ('view', 'click')"),
    Operator(
        "flt_14",
        """with e as (select symbol, session_date, n >= 4 and volume > 250 as strict_ok, n >= 3 and volume > 150 as relaxed_ok, n >= 1 as minimal_ok from {daily}),
        t as (select *, case when max(case when strict_ok then 1 else 0 end) over (partition by session_date) = 1 then 'STRICT' when max(case when relaxed_ok then 1 else 0 end) over (partition by session_date) = 1 then 'RELAXED' else 'MINIMAL' end as tier from e)
        select symbol, session_date, tier from t where (tier = 'STRICT' and strict_ok) or (tier = 'RELAXED' and relaxed_ok) or (tier = 'MINIMAL' and minimal_ok)""",
    ),
    Operator(
        "flt_15",
        """with g as (select symbol, session_date, open / nullif(lag(close) over (partition by symbol order by session_date), 0) as ratio from {daily})
        select symbol, session_date, abs(ratio - 1) >= 8e-2 as flagged, abs(ratio / 5e-1 - 1) < 3e-2 or abs(ratio / 2e0 - 1) < 3e-2 or abs(ratio / 2e-1 - 1) < 3e-2 or abs(ratio / 1e-1 - 1) < 3e-2 as likely_split from g""",
    ),
    Operator("flt_16", "select symbol, session_date, max(case when volume < 20 then 1 else 0 end) over (partition by symbol order by session_date rows between 5 preceding and 5 following) = 1 as excluded from {daily}"),
    Operator(
        "flt_17",
        """with s as (select symbol, session_date, count(close) as present, count(case when slot = 9 then close end) as opening from {grid} group by symbol, session_date)
        select symbol, session_date, case when present = 0 then 'EXCLUDED_NO_REGULAR_SESSION' when opening = 0 then 'EXCLUDED_NO_0915' when present = 24 then 'KEPT' when present >= 23 then 'KEPT_FILLED' else 'EXCLUDED_INCOMPLETE' end as status from s""",
    ),
    Operator("flt_18", "select symbol, count(*) filter (where session_date between date '2024-01-05' and date '2024-01-20') as inside, count(*) filter (where session_date < date '2024-01-05' or session_date > date '2024-01-20') as out_of_span from {ticks} group by symbol"),
    Operator(
        "flt_20",
        """with l as (select user_id, max(@seconds(ts)) as seen from {ticks} group by user_id)
        select user_id, case when seen is null then 'UNKNOWN' when 1706659200 - seen < 0 then 'TIME_ERROR' when 1706659200 - seen <= 43200 then 'FRESH' else 'STALE' end as status from l""",
    ),
    Operator(
        "flt_21",
        """with g as (select user_id, @seconds(ts) - lag(@seconds(ts)) over (partition by user_id order by ts) as gap from {ticks})
        select user_id, max(gap) as longest, case when max(gap) > 5 * 43200 then 'STALE' when max(gap) > 2 * 43200 then 'WARNING' else 'OK' end as status from g where gap is not null group by user_id""",
    ),
    Operator(
        "flt_22",
        """with c as (select symbol, session_date, n < 8 as weak from {daily}), s as (select session_date, count(*) filter (where weak) as weak, count(*) as n from c group by session_date)
        select session_date, case when @weekday(session_date) >= 5 then 'CLOSED' when weak = 0 then 'OK' when weak * 2 > n then 'ERROR' else 'WARNING' end as status from s""",
    ),
    Operator("flt_24", "select symbol, session_date, slot, case when session_date >= date '2024-01-20' then round(close * 37e-1, 6) else close end as close from {bars}"),
    Operator("flt_25", "select e.event_id, e.symbol, e.session_date from {ticks} e where e.session_date between date '2024-01-10' and date '2024-01-12' and e.price > 20 and e.event_id > 100 and exists (select 1 from {daily} d where d.symbol = e.user_id and d.session_date = e.session_date and d.volume > 100)"),
    Operator("flt_26", f"select {K}, case when abs(r) = cast('infinity' as double) then null else round(r, 6) + 0e0 end as r from {{returns}}"),
    Operator("flt_27", f"select symbol, session_date, min(slot) as first_slot from (select {K}, close > lag(close) over w as rose from {{grid}} window w as ({DAY})) x where rose and slot between 9 and 14 group by symbol, session_date"),
    Operator("flt_28", "select symbol, session_date, slot, case when session_date = date '2024-01-20' then 'current' else 'previous' end as part from {bars} where session_date in (date '2024-01-19', date '2024-01-20') and (session_date < date '2024-01-20' or slot + 1 <= 15)"),
    Operator("flt_29", "select count(distinct symbol) as symbols, count(*) = count(distinct symbol || cast(session_date as varchar(10)) || cast(slot as varchar(2))) as unique_bars, count(*) filter (where close is null) as missing from {bars}"),
    Operator("flt_30", "select c.c_custkey as symbol, max(@seconds(t.ts)) as seen, coalesce(1706659200 - max(@seconds(t.ts)) > 86400, true) as stale from {customer} c left join {ticks} t on t.user_id = c.c_custkey group by c.c_custkey"),
    Operator("flt_31", "select symbol, session_date, max_by(close, slot) as close from {bars} where session_date < date '2024-01-30' group by symbol, session_date"),
]
