"""Order-book packets, freshness, gaps and robust scores: what happens between two packets or bars."""

from __future__ import annotations

from tickloom.operators.windows import DAY, K, last, strict
from tickloom.plans.dialect import Operator

#: Packets of a security in order of receipt, from order lines: best prices and quantities, last price, the day's volume so far.
PACKETS = """p as (select l_partkey as security, cast(floor(l_orderkey / 600e0) as bigint) as minute, l_orderkey as order_, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) as received, l_quantity as bid, l_quantity + l_linenumber % 4 as ask,
  l_suppkey % 50 as bid_qty, l_orderkey % 40 as ask_qty, l_quantity + l_linenumber % 3 - 1 as ltp, sum(l_linenumber % 3) over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate rows unbounded preceding) as total from {lineitem}),
v as (select *, ask > bid as valid, case when ask > bid then bid end as b, case when ask > bid then ask end as a, case when ask > bid then bid_qty end as bq, case when ask > bid then ask_qty end as aq from p),
l as (select *, @last_known(b) over w as lb, @last_known(a) over w as la, @last_known(bq) over w as lbq, @last_known(aq) over w as laq, lag(total) over s as ltotal, lag(ltp) over s as lltp,
  order_ - lag(order_) over (partition by security, minute order by received) as gap from v
  window w as (partition by security order by received rows between unbounded preceding and 1 preceding), s as (partition by security order by received)),
d as (select *, case when valid and lb is not null then 1 else 0 end as compared, coalesce(total - ltotal, 0) as traded, (lb + la) / 2e0 as mid from l)"""

FLOW = f"""with {PACKETS} select security, minute, count(*) as packets, count(case when traded > 0 then 1 end) as trade_packets, count(case when not valid then 1 end) as invalid_book, cast(max(gap) as bigint) as max_gap,
  count(case when compared = 1 and (b != lb or a != la or bq != lbq or aq != laq) then 1 end) as quote_changes,
  cast(sum(case when compared = 1 then (case when b >= lb then bq else 0 end) - (case when b <= lb then lbq else 0 end) - (case when a <= la then aq else 0 end) + (case when a >= la then laq else 0 end) else 0 end) as bigint) as ofi,
  cast(sum(case when compared = 1 and b = lb and bq < lbq then lbq - bq else 0 end) as bigint) as bid_depletion, cast(sum(case when compared = 1 and b = lb and bq > lbq then bq - lbq else 0 end) as bigint) as bid_replenish,
  cast(sum(case when compared = 1 and a = la and aq < laq then laq - aq else 0 end) as bigint) as ask_depletion, cast(sum(case when compared = 1 and a = la and aq > laq then aq - laq else 0 end) as bigint) as ask_replenish,
  count(case when compared = 1 and b > lb then 1 end) as bid_up, count(case when compared = 1 and b < lb then 1 end) as bid_down, count(case when compared = 1 and a > la then 1 end) as ask_up, count(case when compared = 1 and a < la then 1 end) as ask_down,
  cast(sum(traded) as bigint) as volume,
  cast(sum(case when mid is not null and ltp > mid or (mid is null or ltp = mid) and ltp > lltp then traded else 0 end) as bigint) as buy_volume,
  cast(sum(case when mid is not null and ltp < mid or (mid is null or ltp = mid) and ltp < lltp then traded else 0 end) as bigint) as sell_volume,
  round(avg(case when valid then (a - b) / ((a + b) / 2e0) * 10000 end), 4) as spread_bps, round(avg(case when valid then coalesce((bq - aq) / nullif(cast(bq + aq as double), 0), 0) end), 6) + 0e0 as imbalance from d group by security, minute"""

#: A security's packets are in one task.
DEALT = (("lineitem", "l_partkey"),)

OPERATORS = [
    Operator("agg_42", FLOW, DEALT),
    Operator(
        "str_07",
        f"""with f as ({FLOW}) select security, count(*) as minutes, cast(sum(packets) as bigint) as packets, cast(sum(ofi) as bigint) as ofi, cast(sum(volume) as bigint) as volume,
        cast(sum(volume) - sum(buy_volume) - sum(sell_volume) as bigint) as unclassified_volume from f group by security""",
        DEALT,
    ),
    Operator(
        "eng_19",
        f"""with f as ({FLOW}), m as (select security, sum(ofi) as ofi, sum(volume) as volume, sum(buy_volume) - sum(sell_volume) as signed, sum(bid_depletion) + sum(ask_depletion) as depletion, sum(bid_replenish) + sum(ask_replenish) as replenish, avg(spread_bps) as spread from f group by security)
        select security, round(ofi / nullif(cast(volume as double), 0), 6) + 0e0 as ofi_norm, round(signed / nullif(cast(volume as double), 0), 6) + 0e0 as signed_flow, round(replenish / nullif(cast(depletion as double), 0), 6) as replenish_ratio, round(spread, 4) as spread_bps,
          case when volume = 0 then 'UNSUPPORTED' when abs(signed / nullif(cast(volume as double), 0)) >= 3e-1 then 'DIRECTIONAL' else 'MIXED' end as class from m""",
        DEALT,
    ),
    Operator(
        "agg_30",
        """with p as (select symbol, session_date, high, low, lag(high) over w as ph, lag(low) over w as pl from {bars} where low > 0 window w as (partition by symbol, session_date order by slot)),
        g as (select symbol, session_date, ln(high / low) * ln(high / low) + ln(ph / pl) * ln(ph / pl) as beta, ln(greatest(high, ph) / least(low, pl)) * ln(greatest(high, ph) / least(low, pl)) as gamma from p where ph is not null),
        a as (select symbol, session_date, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2e0)) - sqrt(gamma / (3 - 2 * sqrt(2e0))) as alpha from g),
        s as (select symbol, session_date, avg(greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0e0)) as s from a group by symbol, session_date)
        select symbol, round(100 * median(s), 6) as spread_pct, count(*) as sessions from s group by symbol""",
    ),
    Operator(
        "win_10",
        f"""with t as (select {K}, (high + low + close) / 3e0 as tp from {{grid}}), m as (select {K}, tp, {strict('avg({})', 'tp', 20, last(20))} as mean from t)
        select m.symbol, m.session_date, m.slot, round(avg(abs(t.tp - m.mean)), 6) as mad from m join t on t.symbol = m.symbol and t.session_date = m.session_date and t.slot > m.slot - 20 and t.slot <= m.slot where m.mean is not null group by m.symbol, m.session_date, m.slot""",
    ),
    Operator(
        "ind_12",
        f"""with t as (select {K}, (high + low + close) / 3e0 as tp from {{grid}}), m as (select {K}, tp, {strict('avg({})', 'tp', 20, last(20))} as mean from t),
        d as (select m.symbol, m.session_date, m.slot, avg(abs(t.tp - m.mean)) as mad from m join t on t.symbol = m.symbol and t.session_date = m.session_date and t.slot > m.slot - 20 and t.slot <= m.slot where m.mean is not null group by m.symbol, m.session_date, m.slot)
        select m.symbol, m.session_date, m.slot, round((m.tp - m.mean) / nullif(15e-3 * d.mad, 0), 4) as cci_20 from m left join d on d.symbol = m.symbol and d.session_date = m.session_date and d.slot = m.slot""",
    ),
    Operator(
        "win_22",
        """with n as (select symbol, session_date, slot, close, max(slot) over (partition by symbol, session_date) as top from {bars}),
        h as (select symbol, session_date, count(*) as points, median(close) as middle from n where slot < top group by symbol, session_date),
        s as (select n.symbol, n.session_date, median(abs(n.close - h.middle)) * 14826e-4 as scale from n join h on h.symbol = n.symbol and h.session_date = n.session_date where n.slot < n.top group by n.symbol, n.session_date)
        select n.symbol, n.session_date, h.points, case when h.points >= 20 then round((n.close - h.middle) / nullif(s.scale, 0), 4) + 0e0 end as z from n join h on h.symbol = n.symbol and h.session_date = n.session_date
        join s on s.symbol = n.symbol and s.session_date = n.session_date where n.slot = n.top""",
    ),
    Operator(
        "eng_27",
        """with t as (select sector, cast(floor((@days(session_date) + 3) / 7e0) as bigint) as week, close - open as x from {daily}), b as (select min(week) as w0, max(week) - min(week) + 1 as n from t),
        s as (select sector, week - w0 as week, sum(x) as s, count(*) as c from t cross join b group by sector, week - w0), r as (select rep, block_ from (select @each(0, 199) as rep) a cross join (select @each(0, 2) as block_) c),
        k as (select r.rep, b.n, @hash_part(cast(r.rep as varchar(9)) || ':' || cast(r.block_ as varchar(9))) % (b.n - least(2, b.n) + 1) as first_, r.block_ from r cross join b where r.block_ * least(2, b.n) < b.n),
        w as (select k.rep, k.first_ + o.o as week from k cross join (select 0 as o union all select 1) o where o.o < least(2, k.n) and k.block_ * least(2, k.n) + o.o < k.n),
        m as (select s.sector, w.rep, sum(s.s) / sum(s.c) as mean from w join s on s.week = w.week group by s.sector, w.rep)
        select sector, count(*) as reps, round(@pctl(mean, 0.05), 6) as low, round(@pctl(mean, 0.95), 6) as high from m group by sector""",
    ),
]
