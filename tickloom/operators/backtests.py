"""Signals and exits of the pre-registered hypotheses, over hourly bars that stand for five minutes."""

from __future__ import annotations

from tickloom.operators.windows import DAY, K
from tickloom.plans.dialect import Operator

#: The opening range of three bars, the first close beyond it, and the first of the next three bars that closes back inside.
TRAP = f"""o as (select symbol, session_date, max(high) as top, min(low) as bottom from {{bars}} where slot < 3 group by symbol, session_date having count(*) = 3 and min(low) > 0),
x as (select b.symbol, b.session_date, b.slot, b.open, b.high, b.low, b.close, o.top, o.bottom, lead(b.slot) over w as next_slot, lead(b.open) over w as entry, row_number() over w as i from {{bars}} b join o on o.symbol = b.symbol and o.session_date = b.session_date window w as (partition by b.symbol, b.session_date order by b.slot)),
f as (select symbol, session_date, min(case when slot >= 3 and (close > top or close < bottom) then i end) as first_ from x group by symbol, session_date),
u as (select x.*, f.first_, max(case when x.i = f.first_ then case when x.close > x.top then 1 else 0 end end) over (partition by x.symbol, x.session_date) as up from x join f on f.symbol = x.symbol and f.session_date = x.session_date),
r as (select symbol, session_date, min(case when i > first_ and i <= first_ + 3 and ((up = 1 and close <= top) or (up = 0 and close >= bottom)) then i end) as back from u group by symbol, session_date),
s as (select u.symbol, u.session_date, max(u.up) as up, max(case when u.i = r.back then u.entry end) as entry, max(case when u.i = r.back then u.next_slot end) as entry_slot, max(case when u.i >= u.first_ and u.i <= r.back then u.high end) as highest, min(case when u.i >= u.first_ and u.i <= r.back then u.low end) as lowest, max(u.top) as top, min(u.bottom) as bottom
  from u join r on r.symbol = u.symbol and r.session_date = u.session_date where r.back is not null group by u.symbol, u.session_date),
g as (select symbol, session_date, entry_slot, entry, case when up = 1 then -1 else 1 end as side, case when up = 1 then highest * 1001e-3 else lowest * 999e-3 end as stop, case when up = 1 then bottom else top end as target from s where entry is not null),
t as (select *, side * (entry - stop) as risk from g where side * (entry - stop) > 0)"""

#: A trade's first bar that touches the stop or the target, and how it ends there.
EXITS = """e as (select t.symbol, t.session_date, t.entry_slot, t.side, t.entry, t.stop, t.target, min(case when (t.side > 0 and b.low <= t.stop) or (t.side < 0 and b.high >= t.stop) then b.slot end) as stopped, min(case when (t.side > 0 and b.high >= t.target) or (t.side < 0 and b.low <= t.target) then b.slot end) as reached, max(b.slot) as final_
  from t join {bars} b on b.symbol = t.symbol and b.session_date = t.session_date and b.slot >= t.entry_slot and b.slot < t.entry_slot + 12 group by t.symbol, t.session_date, t.entry_slot, t.side, t.entry, t.stop, t.target),
z as (select e.*, case when stopped is not null and (reached is null or stopped <= reached) then 'STOP' when reached is not null then 'TARGET' else 'TIME' end as reason, case when stopped is not null and (reached is null or stopped <= reached) then stopped when reached is not null then reached else final_ end as exit_slot from e)"""

PRICE = "case z.reason when 'STOP' then case when z.side > 0 then least(b.open, z.stop) else greatest(b.open, z.stop) end when 'TARGET' then case when z.side > 0 then greatest(b.open, z.target) else least(b.open, z.target) end else b.close end"

CONTEXT = """with v as (select symbol, session_date, slot, open, high, low, close, sum((high + low + close) / 3 * volume) over s / nullif(sum(volume) over s, 0) as vwap, first_value(open) over s as day_open from {bars} window s as (partition by symbol, session_date order by slot rows between unbounded preceding and current row))"""

OPERATORS = [
    Operator("bkt_21", f"with {TRAP} select symbol, session_date, entry_slot, side, entry, round(stop, 6) as stop, target, round(risk, 6) as risk from t"),
    Operator("bkt_02", f"with {TRAP}, {EXITS} select z.symbol, z.session_date, z.reason, z.exit_slot, round({PRICE}, 6) as exit_price from z join {{bars}} b on b.symbol = z.symbol and b.session_date = z.session_date and b.slot = z.exit_slot"),
    Operator(
        "bkt_03",
        """with t as (select symbol, session_date, slot + 1 as entry_slot, close * 6e-1 as stop from {bars} where slot = 4), e as (select t.symbol, t.session_date, t.stop, min(case when b.low <= t.stop then b.slot end) as stopped, max(b.slot) as final_ from t join {bars} b on b.symbol = t.symbol and b.session_date = t.session_date and b.slot >= t.entry_slot group by t.symbol, t.session_date, t.stop)
        select e.symbol, e.session_date, b.slot as exit_slot, case when e.stopped is not null then round(least(b.open, e.stop), 6) else b.close end as exit_price from e join {bars} b on b.symbol = e.symbol and b.session_date = e.session_date and b.slot = coalesce(e.stopped, e.final_)""",
    ),
    Operator(
        "bkt_12",
        f"""with p as (select symbol, session_date, slot, open, high, low, close, volume, max(high) over s as top, first_value(open) over s as day_open, avg(close) over n as fast, avg(close) over m as slow, volume / nullif(avg(volume) over (partition by symbol, session_date order by slot rows between 5 preceding and 1 preceding), 0) as rvol from {{bars}}
          window s as (partition by symbol, session_date order by slot rows between unbounded preceding and current row), n as (partition by symbol, session_date order by slot rows between 2 preceding and current row), m as (partition by symbol, session_date order by slot rows between 5 preceding and current row)),
        k as (select p.*, max(case when high = top then slot end) over (partition by symbol, session_date order by slot rows between unbounded preceding and current row) as top_slot, lag(close) over w as pc, lag(fast) over w as pf from p window w as (partition by symbol, session_date order by slot)),
        d as (select k.symbol, k.session_date, k.slot, k.close, k.top, k.day_open, k.rvol, min(q.low) as pullback, avg(q.rvol) as rvol_pullback from k join k q on q.symbol = k.symbol and q.session_date = k.session_date and q.slot > k.top_slot and q.slot < k.slot
          where k.fast > k.slow and k.close > k.fast and k.pc <= k.pf and k.top > k.day_open group by k.symbol, k.session_date, k.slot, k.close, k.top, k.day_open, k.rvol)
        select symbol, session_date, min(slot) as slot from d where (top - pullback) / (top - day_open) between 3e-1 and 7e-1 and rvol_pullback < 1 and rvol >= 12e-1 group by symbol, session_date""",
    ),
    Operator(
        "bkt_13",
        f"""with p as (select {K}, open, high, low, close, max(high) over (partition by symbol, session_date order by slot rows between 4 preceding and 1 preceding) as top, first_value(open) over (partition by symbol, session_date order by slot rows between unbounded preceding and current row) as day_open from {{bars}}),
        s as (select session_date, slot, avg(close - day_open) as sector from p group by session_date, slot), b as (select p.*, p.close - p.day_open - s.sector as rel, case when p.close > p.top then 1 else 0 end as broke from p join s on s.session_date = p.session_date and s.slot = p.slot),
        l as (select b.*, lag(broke, 1) over w as b1, lag(top, 1) over w as t1, lag(broke, 2) over w as b2, lag(top, 2) over w as t2, lag(broke, 3) over w as b3, lag(top, 3) over w as t3 from b window w as (partition by symbol, session_date order by slot))
        select symbol, session_date, min(slot) as slot from l where ((b1 = 1 and t1 > close) or (b2 = 1 and t2 > close) or (b3 = 1 and t3 > close)) and rel <= -1 group by symbol, session_date""",
    ),
    Operator(
        "bkt_14",
        f"""{CONTEXT}, l as (select v.*, lag(vwap - close, 1) over w as a1, lag(vwap - close, 2) over w as a2, lag(vwap - close, 3) over w as a3 from v window w as (partition by symbol, session_date order by slot)), m as (select session_date, slot, avg(close - day_open) as market from v group by session_date, slot)
        select l.symbol, l.session_date, min(l.slot) as slot from l join m on m.session_date = l.session_date and m.slot = l.slot where m.market < 0 and a1 > 0 and a2 > 0 and a3 > 0 and vwap <= high and vwap > close and close < open group by l.symbol, l.session_date""",
    ),
    Operator("bkt_15", "with z as (select symbol, session_date, close - open as x from {daily}), d as (select symbol, session_date, sum(x) over w / nullif(stddev_samp(x) over w * sqrt(count(x) over w), 0) as z, count(x) over w as n from z window w as (partition by symbol order by session_date rows between 10 preceding and 1 preceding)) select symbol, session_date, case when z >= 15e-1 then 1 else -1 end as side from d where n >= 6 and abs(z) >= 15e-1"),
    Operator(
        "bkt_22",
        f"""with {TRAP}, {EXITS}, p as (select z.symbol, z.session_date, z.side, z.entry, {PRICE} as exit_price, 4e-1 * z.entry * 15 / 100 * sqrt(greatest((24 - z.entry_slot) / 8760e0, 1e-4)) as p0, 4e-1 * z.entry * 15 / 100 * sqrt(greatest((24 - z.exit_slot - 1) / 8760e0, 1e-4)) as p1
          from z join {{bars}} b on b.symbol = z.symbol and b.session_date = z.session_date and b.slot = z.exit_slot)
        select symbol, session_date, round(p0, 6) as premium, round((greatest(p0 + 5e-1 * side * (exit_price - entry) - (p0 - p1), 5e-2) - p0) * 75 - 40, 4) as pnl from p""",
    ),
]
