"""Calendars, parses, rules and texts: scalar operators that take more than one row's arithmetic to say."""

from __future__ import annotations

from tickloom.plans.dialect import Operator

#: Where each day's co-movement, dispersion and volatility stand among those of earlier days (five at least), as the rules read them.
RANKS = """d as (select symbol, session_date, close / nullif(open, 0) - 1 as r from {daily}), m as (select session_date, round(stddev_pop(r), 9) as dispersion, round(abs(avg(r)), 9) as vol, round(avg(case when r > 0 then 1e0 else 0e0 end), 9) as together from d group by session_date),
g as (select m.*, @gathered(together) over w as past_together, @gathered(dispersion) over w as past_dispersion, @gathered(vol) over w as past_vol from m window w as (order by session_date rows between 60 preceding and 1 preceding)),
q as (select session_date, case when @length(past_together) >= 5 then (@below(past_together, together) + 5e-1 * @alike(past_together, together)) / @length(past_together) end as corr_, case when @length(past_dispersion) >= 5 then (@below(past_dispersion, dispersion) + 5e-1 * @alike(past_dispersion, dispersion)) / @length(past_dispersion) end as disp,
  case when @length(past_vol) >= 5 then (@below(past_vol, vol) + 5e-1 * @alike(past_vol, vol)) / @length(past_vol) end as vol from g), p as (select q.*, abs(corr_ - disp) as change_ from q where corr_ is not null)"""

OPERATORS = [
    Operator(
        "fn_04",
        """with s as (select distinct session_date as d from {ticks} where extract(day from session_date) % 9 != 0), x as (select d, case when d < date '2024-01-17' then 3 else 1 end as target from s),
        e as (select d, @add_days(d, (target - @weekday(d) + 7) % 7) as e from x), k as (select d, case when d < date '2024-01-17' and e >= date '2024-01-17' then date '2024-01-23' else e end as e from e)
        select k.d as session_date, coalesce(max(s.d), k.e) as expiry from k left join s on s.d <= k.e and s.d >= k.d and k.e <= (select max(d) from s) group by k.d, k.e""",
    ),
    Operator(
        "fn_06",
        """with v as (select o_orderkey, case o_orderkey % 5 when 0 then substr(@text_of(o_orderdate), 1, 10) when 1 then substr(@text_of(o_orderdate), 9, 2) || '-' || substr(@text_of(o_orderdate), 6, 2) || '-' || substr(@text_of(o_orderdate), 1, 4)
          when 2 then substr(@text_of(o_orderdate), 9, 2) || '/' || substr(@text_of(o_orderdate), 6, 2) || '/' || substr(@text_of(o_orderdate), 1, 4) when 3 then @text_of(o_orderdate) else 'soon' end as said from {orders}),
        w as (select o_orderkey, split_part(replace(trim(said), 'T', ' '), ' ', 1) as said from v)
        select o_orderkey, coalesce(@as_date(said, 'yyyy-MM-dd', '%Y-%m-%d'), @as_date(said, 'dd-MM-yyyy', '%d-%m-%Y'), @as_date(said, 'dd/MM/yyyy', '%d/%m/%Y'), @as_date(said, 'yyyyMMdd', '%Y%m%d')) as expiry from w""",
    ),
    Operator(
        "fn_15",
        f"""with {RANKS} select session_date, case when corr_ >= 8e-1 and (disp >= 8e-1 or vol >= 8e-1) then 'STRESSED' when disp >= 9e-1 and corr_ <= 5e-1 then 'DISLOCATED' when change_ >= 9e-1 then 'TRANSITION' else 'NORMAL' end as state,
        case when change_ >= 95e-2 then 'SHIFTING_' else '' end || case when corr_ >= 8e-1 and disp >= 8e-1 then 'COUPLED_STRESS' when corr_ >= 8e-1 then 'COUPLED' when corr_ <= 2e-1 and disp >= 8e-1 then 'DISPERSED' when disp <= 2e-1 then 'QUIET' else 'TYPICAL' end as regime from p""",
    ),
    Operator(
        "fn_16",
        """with m as (select symbol, session_date, slot, ln(close / nullif(open, 0)) * 10000 as move, (high - low) / 100 as spread, (volume % 21 - 10) / 10e0 as flow, (n % 7) / 6e0 as through, n >= 2 as supported from {bars} where open > 0 and close > 0),
        t as (select *, case when 2 * spread > 5 then 2 * spread else 5e0 end as threshold, case when move < 0 then -1 else 1 end as way from m)
        select symbol, session_date, slot, case when not supported then 'UNSUPPORTED' when abs(move) < threshold then case when abs(flow) >= 3e-1 then 'ABSORPTION' else 'QUIET' end
          when flow * way >= 3e-1 then 'AGGRESSIVE_CONSUMPTION' when through < 6e-1 and abs(flow) < 3e-1 then 'LIQUIDITY_WITHDRAWAL' else 'MIXED' end as class from t""",
    ),
    Operator("fn_24", """with c as (select symbol, chr(123) || '"bars":' || cast(count(*) as varchar(20)) || ',"first":"' || cast(min(session_date) as varchar(10)) || '","symbol":"' || symbol || '"' || chr(125) as config from {bars} group by symbol) select symbol, @digest(config) as config_hash from c"""),
    Operator("fn_28", "with r as (select symbol, session_date, slot, row_number() over (partition by symbol, session_date order by slot desc) as k from {bars}) select symbol, session_date, @listed(lpad(cast(slot as varchar(2)), 2, '0')) as last_slots from r where k <= 3 group by symbol, session_date"),
    Operator("fn_29", "select session_date, @listed(symbol) as active from (select distinct session_date, symbol from {bars} where volume > 50) x group by session_date"),
    Operator(
        "fn_30",
        """with v as (select event_id % 100 as shape_of, 'k' as name, case when @json_int(props, k) is not null then 'integer' else 'null' end as kind from {events} union all select event_id % 100, 'value', case when value is not null then 'number' else 'null' end from {events})
        select shape_of, @listed(item) as shape from (select distinct shape_of, name || ':' || kind as item from v) x group by shape_of""",
    ),
    Operator(
        "fn_33",
        """with r as (select symbol, session_date, close, row_number() over (partition by session_date order by close desc, symbol) as k, count(*) over (partition by session_date) as n from {daily})
        select session_date, 'TIME: ' || cast(session_date as varchar(10)) || chr(10) || 'UNIVERSE: ' || cast(n as varchar(9)) || chr(10) || 'SELECTED: ' || cast(symbol as varchar(20)) || chr(10) || 'PROBABILITY: n/a' || chr(10) || 'DECISION HASH: ' || substr(@digest(cast(symbol as varchar(20))), 1, 16) || chr(10) || 'DECISION: IMMUTABLE' as card from r where k = 1""",
    ),
    Operator(
        "fn_34",
        """with b as (select symbol, slot as lag_, greatest(avg(close - open) + 60, 0e0) as beta from {bars} where slot < 6 group by symbol, slot), s as (select *, beta / sum(beta) over (partition by symbol) as share from b),
        c as (select *, sum(share) over (partition by symbol order by lag_ rows unbounded preceding) as c from s), f as (select symbol, min(case when c >= 5e-1 then lag_ end) as j, sum(share * lag_) as mean_lag, 1 - max(case when lag_ = 0 then share end) as delay_index from c group by symbol)
        select f.symbol, round(f.mean_lag, 6) as mean_lag, round(f.delay_index, 6) as delay_index, round(case when f.j is null then 5e0 when f.j = 0 then 0e0 else f.j - 1 + (5e-1 - p.c) / greatest(q.c - p.c, 1e-9) end, 6) as half_life
        from f left join c q on q.symbol = f.symbol and q.lag_ = f.j left join c p on p.symbol = f.symbol and p.lag_ = f.j - 1""",
    ),
]
