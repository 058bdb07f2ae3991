"""Window operators over bars and grids: lags, strict frames, running values, extremes, ranks and islands.

A strict frame of p rows gives null unless all p hold a value; a missing bar stays missing.
"""

from __future__ import annotations

from tickloom.plans.dialect import Operator

K = "symbol, session_date, slot"
DAY = "partition by symbol, session_date order by slot"


def rows(a: str, b: str, over: str = DAY) -> str:
    return f"({over} rows between {a} and {b})"


def last(p: int) -> str:
    """The last p rows, this one included."""
    return rows(f"{p - 1} preceding", "current row")


def before(p: int, over: str = DAY) -> str:
    """The p rows before this one."""
    return rows(f"{p} preceding", "1 preceding", over)


def ahead(p: int) -> str:
    return rows("1 following", f"{p} following")


SO_FAR = rows("unbounded preceding", "current row")
REST = rows("current row", "unbounded following")


def strict(agg: str, x: str, p: int, frame: str) -> str:
    return f"case when count({x}) over {frame} = {p} then {agg.format(x)} over {frame} end"


OPERATORS = [
    Operator("win_01", f"select {K}, round(close - lag(close) over w, 6) as diff, round(close - lag(close, 10) over w, 6) as momentum, round(close / nullif(lag(close) over w, 0) - 1, 6) as change from {{grid}} window w as ({DAY})"),
    Operator("win_02", f"select {K}, round(r, 6) + 0e0 as r from {{returns}}"),
    Operator("win_03", f"select {K}, round(@ln(@over(close, lag(close, 5) over w)), 6) + 0e0 as r5 from {{grid}} window w as ({DAY})"),
    Operator("win_04", f"select {K}, round(@ln(@over(lead(close, 3) over w, close)), 6) + 0e0 as ahead_3 from {{grid}} window w as ({DAY})"),
    Operator("win_05", f"select {K}, lag(volume, 2, cast(-1 as bigint)) over w as volume_2 from {{grid}} window w as ({DAY})"),
    Operator("win_06", f"select {K}, {strict('max({})', 'high', 5, before(5))} as prior_high, {strict('min({})', 'low', 5, before(5))} as prior_low from {{grid}}"),
    Operator("win_07", f"select {K}, {strict('max({})', 'high', 5, last(5))} as trailing_high, {strict('min({})', 'low', 5, last(5))} as trailing_low from {{grid}}"),
    Operator("win_08", f"select {K}, round(@pctl(volume, 0.5) over {before(20, 'partition by symbol, slot order by session_date')}, 6) as usual_volume from {{grid}}"),
    Operator(
        "win_09",
        f"""select {K}, round({strict('avg({})', 'close', 5, last(5))}, 6) as mean, round({strict('sum({})', 'close', 5, last(5))}, 4) as total,
        {strict('min({})', 'close', 5, last(5))} as least, {strict('max({})', 'close', 5, last(5))} as most, round({strict('stddev_pop({})', 'close', 5, last(5))}, 6) as sd from {{grid}}""",
    ),
    Operator("win_11", f"select {K}, case when count(r) over w >= 10 then round(stddev_samp(r) over w, 6) end as volatility from {{returns}} window w as ({DAY} rows between 14 preceding and current row)"),
    Operator("win_12", f"select {K}, case when count(close) over w >= 10 then round(avg(close) over w, 6) end as mean from {{grid}} window w as ({DAY} rows between unbounded preceding and current row)"),
    Operator("win_13", f"select {K}, cast(sum(volume) over w as bigint) as total, count(close) over w as bars from {{grid}} window w as ({DAY} rows between unbounded preceding and current row)"),
    Operator("win_14", f"select {K}, max(high) over w as day_high, min(low) over w as day_low from {{grid}} window w as ({DAY} rows between unbounded preceding and current row)"),
    Operator("win_15", f"select {K}, @last_known(close) over w as last_close from {{grid}} window w as ({DAY} rows between unbounded preceding and current row)"),
    Operator("win_16", f"select {K}, @first_known(open) over w as first_open from {{grid}} window w as ({DAY} rows between unbounded preceding and current row)"),
    Operator("win_17", f"select {K}, slot - max(case when close is not null then slot end) over w as age from {{grid}} window w as ({DAY} rows between unbounded preceding and current row)"),
    Operator(
        "win_18",
        """select symbol, session_date, slot,
        case when slot >= 4 and count(case when slot < 4 then close end) over d > 0 then max(case when slot < 4 then high end) over d end as range_high,
        case when slot >= 4 and count(case when slot < 4 then close end) over d > 0 then min(case when slot < 4 then low end) over d end as range_low
        from {grid} window d as (partition by symbol, session_date)""",
    ),
    Operator(
        "win_19",
        f"""with signs as (select {K}, case when r > 0 then 1 when r < 0 then -1 end as s from {{returns}})
        select {K}, case when count(s) over w >= 5 and s is not null then
          round(cast(case when s > 0 then count(case when s > 0 then 1 end) over w else count(case when s < 0 then 1 end) over w end as double) / count(s) over w, 6) end as persistence
        from signs window w as ({DAY} rows between 9 preceding and current row)""",
    ),
    Operator(
        "win_21",
        f"""with y as (select r.{K.replace(', ', ', r.')}, r.r as y, m.x from {{returns}} r left join
          (select session_date, slot, @ln(@over(level, lag(level) over (partition by session_date order by slot))) as x from {{market}}) m on m.session_date = r.session_date and m.slot = r.slot)
        select {K}, case when count(case when x is not null then y end) over e >= 10 then round(regr_slope(y, x) over e, 6) end as slope,
          case when count(case when x is not null then y end) over e >= 10 then round(@corr_over(y, x, e), 6) end as correlation, round(sum(y) over c, 6) as recent
        from y window e as ({DAY} rows between 16 preceding and 4 preceding), c as ({DAY} rows between 3 preceding and current row)""",
    ),
    Operator("win_23", f"select {K}, case when count(close) over w >= 5 then round((close - avg(close) over w) / nullif(stddev_pop(close) over w, 0), 4) end as z from {{grid}} window w as ({DAY} rows between unbounded preceding and 1 preceding)"),
    Operator(
        "win_24",
        """with d as (select symbol, session_date, @ln(@over(close, lag(close) over (partition by symbol order by session_date))) as y from {daily}),
        m as (select session_date, avg(y) as x from d group by session_date), p as (select d.symbol, d.session_date, case when x is not null then y end as y, case when y is not null then x end as x from d join m on m.session_date = d.session_date)
        select symbol, session_date, case when count(y) over w >= 10 then round(covar_pop(y, x) over w / nullif(var_pop(x) over w, 0), 6) end as beta
        from p window w as (partition by symbol order by session_date rows between 20 preceding and 1 preceding)""",
    ),
    Operator(
        "win_25",
        """with v as (select symbol, session_date, close, case when count(close) over w = 5 then stddev_pop(close) over w end as vol, close - lag(close, 5) over o as trend
          from {daily} window w as (partition by symbol order by session_date rows between 5 preceding and 1 preceding), o as (partition by symbol order by session_date)),
        m as (select *, @pctl(vol, 0.5) over (partition by symbol order by session_date rows between unbounded preceding and current row) as usual from v)
        select symbol, session_date, case when vol is null or trend is null then null else (case when trend > 0 then 'UP' else 'DOWN' end) || (case when round(vol, 9) > round(usual, 9) then '_WILD' else '_CALM' end) end as regime from m""",
    ),
    Operator(
        "win_26",
        """with d as (select symbol, session_date, median(high - low) as m from {grid} group by symbol, session_date)
        select symbol, session_date, round(@pctl(m, 0.5) over (partition by symbol order by session_date rows between 20 preceding and 1 preceding), 6) as typical_range from d""",
    ),
    Operator(
        "win_27",
        f"""select {K}, round(lead(close, 3) over o / nullif(lead(open) over o, 0) - 1, 6) as forward, round(max(high) over w / nullif(lead(open) over o, 0) - 1, 6) as mfe,
        round(min(low) over w / nullif(lead(open) over o, 0) - 1, 6) as mae from {{grid}} window o as ({DAY}), w as ({DAY} rows between 1 following and 3 following)""",
    ),
    Operator("win_28", f"select {K}, max(high) over {REST} as rest_high, min(low) over {REST} as rest_low from {{grid}}"),
    Operator(
        "win_29",
        f"""select {K}, high, low, count(high) over w = 5 and high = max(high) over w and high > coalesce(greatest(lag(high) over o, lag(high, 2) over o, lead(high) over o, lead(high, 2) over o), high) as swing_high,
        count(low) over w = 5 and low = min(low) over w and low < coalesce(least(lag(low) over o, lag(low, 2) over o, lead(low) over o, lead(low, 2) over o), low) as swing_low
        from {{grid}} window o as ({DAY}), w as ({DAY} rows between 2 preceding and 2 following)""",
    ),
    Operator(
        "win_30",
        """select symbol, session_date, volume, rank() over (partition by session_date order by volume) + (count(*) over (partition by session_date, volume) - 1) / 2e0 as average_rank,
        round((rank() over (partition by session_date order by volume) + (count(*) over (partition by session_date, volume) - 1) / 2e0 - 5e-1) / count(*) over (partition by session_date), 6) as pct_rank from {daily}""",
    ),
    Operator(
        "win_31",
        """select symbol, session_date, volume, cast(row_number() over (partition by session_date order by volume desc, symbol) as int) as place,
        cast(dense_rank() over (partition by session_date order by volume desc) as int) as level from {daily}""",
    ),
    Operator(
        "win_32",
        """with g as (select symbol, session_date, slot, slot - row_number() over (partition by symbol, session_date order by slot) as island from {grid} where close is null)
        select symbol, session_date, min(slot) as first_slot, max(slot) as last_slot, count(*) as missing from g group by symbol, session_date, island""",
    ),
    Operator(
        "win_33",
        """with d as (select symbol, session_date, close < lag(close) over w as lost, row_number() over w as k from {daily} window w as (partition by symbol order by session_date)),
        g as (select symbol, k - row_number() over (partition by symbol order by session_date) as island from d where lost), c as (select symbol, island, count(*) as n from g group by symbol, island)
        select symbol, max(n) as longest from c group by symbol""",
    ),
    Operator("win_34", f"select {K}, round(sum(r * r) over w / nullif(sum(r * r) over (partition by symbol, session_date), 0), 6) as share from {{returns}} window w as ({DAY} rows between unbounded preceding and current row)"),
    Operator("win_35", f"select {K}, case when count(r) over w >= 2 then round(sum(r) over w, 6) + 0e0 end as forward from {{returns}} window w as ({DAY} rows between 1 following and 4 following)"),
    Operator(
        "win_36",
        f"""with a as (select {K}, @ln(@over(close, lag(close, 5) over w)) as r5 from {{grid}} window w as ({DAY}))
        select {K}, round(r5 - lag(r5, 5) over w, 6) + 0e0 as acceleration from a window w as ({DAY})""",
    ),
    Operator("win_37", f"select {K}, round(cast(sum(volume) over a as double) / nullif(sum(volume) over b, 0), 6) as volume_ratio from {{grid}} window a as ({DAY} rows between 4 preceding and current row), b as ({DAY} rows between 9 preceding and 5 preceding)"),
    Operator(
        "win_38",
        """with s as (select symbol, session_date, case when close > open then 'UP' when close < open then 'DOWN' else 'FLAT' end as state from {daily}),
        n as (select symbol, state, lead(state) over (partition by symbol order by session_date) as following from s)
        select state, count(following) as n, round(avg(case when following = state then 1e0 when following is not null then 0e0 end), 6) as stays from n group by state""",
    ),
    Operator("win_39", "select symbol, session_date, min(slot) as first_slot from {grid} where close > open group by symbol, session_date"),
    Operator("win_41", f"select {K}, lag(close, 3) over (partition by symbol order by session_date, slot) as close_3 from {{grid}}"),
    Operator(
        "win_43",
        f"""with b as (select {K}, close, high, {strict('max({})', 'high', 3, before(3))} as level from {{grid}}), f as (select *, high > level as broke from b)
        select {K}, coalesce((lag(broke, 1) over w and close < lag(level, 1) over w) or (lag(broke, 2) over w and close < lag(level, 2) over w) or (lag(broke, 3) over w and close < lag(level, 3) over w), false) as trap
        from f window w as ({DAY})""",
    ),
]
