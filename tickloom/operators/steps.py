"""One step of the engine, from baselines to events, as of a slot; and the same at every slot of every session in one plan.

Measures of the state matrix are held against a baseline: their values at the slots around this one in earlier sessions, or where there are too few,
at this session's earlier slots. Nothing else is carried from slot to slot, so a replay is the step at many slots.
"""

from __future__ import annotations

from tickloom.operators.matrix import DECISION, HOURS, Scale, matrix_sql, over_desk
from tickloom.plans.dialect import Operator

#: measure: column of the matrix.
MEASURES = {"return": "ret_5m", "volume": "volume_session", "range": "range_pct", "sector_gap": "rel_sector_open"}
KEYS = ("session_date", "symbol", "slot", "measure", "quality", "tier", "n", "class", "event_id", "severity", "evidence")
NUMBERS = ("value", "median", "mad", "z")


def step_sql(scale: Scale, slot: int | None = None, every: int = 1, around: int = 1, least: int = 20, least_today: int = 20, unusual: float = 2.5, extreme: float = 4.0, complete: float = 0.5) -> str:
    """SQL over the matrix's inputs: each symbol's measures at `slot`, or at every `every`-th slot, their z and what event they make.

    A session's own bars after the slot aren't looked at; those of earlier sessions are, `around` slots further.
    """
    upto = None if slot is None else min(slot + around, scale.slots - 1)
    names = " union all ".join(f"select '{m}' as measure" for m in MEASURES)
    value = " ".join(f"when '{m}' then {c}" for m, c in MEASURES.items())
    offsets = " union all ".join(f"select {k} as ahead" for k in range(-around, around + 1))
    wanted = f"slot = {slot}" if slot is not None else f"slot % {every} = {every - 1}"
    return f"""with x as ({matrix_sql(scale, None, upto)}),
    numbers as (select session_date, row_number() over (order by session_date) as number from (select distinct session_date from x) d),
    v as (select x.session_date, x.symbol, x.slot, d.number, m.measure, case when completeness < {complete} then 'SPARSE' when stale = 1 then 'STALE' when frozen = 1 then 'FROZEN' else 'OK' end as quality, cast(case m.measure {value} end as double) as value
      from x join numbers d on d.session_date = x.session_date cross join ({names}) m),
    p as (select v.*, o.ahead, v.slot + o.ahead as at_slot from v cross join ({offsets}) o),
    b as (select p.*, @gathered(value) over (partition by symbol, measure, at_slot order by number range between {scale.lookback} preceding and 1 preceding) as past from p),
    t as (select b.*, @gathered(value) over (partition by symbol, measure, session_date order by slot rows between unbounded preceding and 1 preceding) as today from b where ahead = 0),
    c as (select t.*, case when @length(past) >= {least} then 'HISTORICAL' when @length(today) >= {least_today} then 'INTRADAY' else 'INSUFFICIENT' end as tier, case when @length(past) >= {least} then past when @length(today) >= {least_today} then today end as base from t),
    d as (select c.*, coalesce(@length(base), 0) as n, @middle(base) as median from c where {wanted}),
    e as (select d.*, @middle(@deviations(base, median)) * 14826e-4 as mad from d),
    z as (select e.*, case when mad > 1e-12 then (value - median) / mad end as z from e),
    k as (select z.*, case when quality <> 'OK' then 'INVALID' when z is null then 'INSUFFICIENT_DATA' when abs(z) >= {extreme} then 'EXTREME' when abs(z) >= {unusual} then 'UNUSUAL' else 'NORMAL' end as class from z)
    select session_date, symbol, slot, measure, quality, tier, n, class, value, median, mad, z,
      case when class in ('UNUSUAL', 'EXTREME') then 'evt_' || substr(@digest(cast(symbol as varchar(20)) || '|' || cast(session_date as varchar(10)) || '|' || cast(slot as varchar(9)) || '|' || measure), 1, 16) end as event_id,
      case when class in ('UNUSUAL', 'EXTREME') then case when abs(z) / {unusual} < 15e-1 then 'LOW' when abs(z) / {unusual} < 25e-1 then 'MEDIUM' else 'HIGH' end end as severity,
      case when class in ('UNUSUAL', 'EXTREME') then measure || case when z > 0 then ' above ' else ' below ' end || lower(tier) || ' baseline of ' || cast(n as varchar(9)) || ' values' end as evidence from k"""


def rounded(sql: str) -> str:
    return f"select {', '.join(KEYS)}, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in NUMBERS)} from ({sql}) y"


WITH = {"least": 10, "least_today": 4, "unusual": 2.0, "extreme": 3.5, "complete": 0.3}

OPERATORS = [
    Operator("eng_29", rounded(over_desk(step_sql(HOURS, DECISION, **WITH)))),
    Operator("eng_30", rounded(over_desk(step_sql(HOURS, None, every=4, **WITH)))),
]
