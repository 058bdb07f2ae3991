"""The state matrix: one row of state variables for every symbol at a decision slot, each as it was known then.

Inputs keep clocks of their own. A bar is known when its slot has closed; everything else comes as facts, rows of (session_date,
symbol or null for the whole market, name, known_slot, value), of which a row sees the last one known by its slot. Norms
come from earlier sessions only. A value that can't be computed is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from tickloom.operators.windows import DAY, K
from tickloom.plans.dialect import Operator

#: Facts of one symbol, and of the market.
OWN_FACTS = ("previous_close", "today_open", "response_gap", "response_gap_sigma", "pending_response_sigma", "spread_bps", "depth5", "imbalance1", "ofi_norm", "signed_flow")
MARKET_FACTS = ("nifty_atm_iv", "nifty_budget_ratio", "market_state_code")

COLUMNS = (
    "ltp", "prev_close", "open", "gap_pct", "ret_open_pct", "ret_prev_close_pct", "day_high", "day_low", "range_pct",
    "ret_1m", "ret_5m", "ret_10m", "ret_15m", "ret_30m", "accel_5m", "persistence_10m",
    "volume_session", "turnover_session_cr", "rel_volume", "volume_accel", "pv_corr_15m",
    "or_high", "or_low", "or_position", "breakout_state", "range_position", "range_vs_vol", "trend_state",
    "rel_market_open", "rel_sector_open", "rel_market_15m", "response_gap", "response_gap_sigma", "pending_response_sigma", "pct_ret_open", "pct_rel_volume",
    "rvol_session", "rvol_15m", "vol_ratio", "vol_expansion",
    "activity", "illiquidity", "spread_bps", "depth5", "imbalance1", "ofi_norm", "signed_flow",
    "nifty_atm_iv", "nifty_budget_ratio",
    "market_ret_open", "breadth", "dispersion", "sector_ret_open", "sector_breadth", "market_state_code",
    "history_sessions", "bars_present", "completeness", "last_bar_age_min", "stale", "frozen",
)


@dataclass(frozen=True)
class Scale:
    """Lengths in slots (minutes, where a slot is one), and how many values a measure needs."""

    slots: int = 375
    short: int = 5
    middle: int = 10
    long: int = 15
    far: int = 30
    opening: int = 15
    stale: int = 3
    least: int = 10
    least_signs: int = 5
    peers: int = 3
    lookback: int = 20
    crore: str = "1e7"


def matrix_sql(scale: Scale, decision: int | None = None, upto: int | None = None) -> str:
    """SQL over bars (symbol, session_date, slot, open, high, low, close, volume), universe (symbol, sector), index_bars
    (priority, session_date, slot, open, close) and facts; a row for each symbol, session and slot, up to a last one, or at one decision slot.

    Bars after the decision slot, or the last one, aren't read.
    """
    s, last = scale, next(x for x in (upto, decision, scale.slots - 1) if x is not None)

    def frame(n: int, skip: int = 0) -> str:
        return f"({DAY} rows between {n + skip - 1} preceding and {f'{skip} preceding' if skip else 'current row'})"

    so, short, prior, middle, long = f"({DAY} rows between unbounded preceding and current row)", frame(s.short), frame(s.short, s.short), frame(s.middle), frame(s.long)
    own = ", ".join(f"max(case when name = '{x}' then value end) as f_{x}" for x in OWN_FACTS)
    market = ", ".join(f"max(case when name = '{x}' then value end) as f_{x}" for x in MARKET_FACTS)
    known = ", ".join([f"@last_known(f_{x}) over so as {x}" for x in OWN_FACTS + MARKET_FACTS])
    own_columns, market_columns = (", ".join(f"{side}.f_{x}" for x in names) for side, names in (("o", OWN_FACTS), ("k", MARKET_FACTS)))
    mean_rank = "(rank() over (partition by session_date, slot, {0} is null order by {0}) + (count(*) over (partition by session_date, slot, {0}) - 1) / 2e0 - 5e-1) / count({0}) over (partition by session_date, slot)"
    norms = f"(partition by symbol, slot order by session_date rows between {s.lookback} preceding and 1 preceding)"
    return f"""with days as (select session_date, row_number() over (order by session_date) - 1 as earlier from (select distinct session_date from {{bars}}) d),
    slots as (select cast(slot as int) as slot from (select @each(0, {last}) as slot) x),
    g as (select u.symbol, u.sector, d.session_date, d.earlier, t.slot from {{universe}} u cross join days d cross join slots t),
    own_facts as (select session_date, symbol, known_slot, {own} from {{facts}} where symbol is not null group by session_date, symbol, known_slot),
    market_facts as (select session_date, known_slot, {market} from {{facts}} where symbol is null group by session_date, known_slot),
    traded as (select distinct symbol, session_date, 1 as traded from {{bars}}),
    j as (select g.*, b.open, b.high, b.low, b.close, b.volume, p.traded, {own_columns}, {market_columns}
      from g left join {{bars}} b on b.symbol = g.symbol and b.session_date = g.session_date and b.slot = g.slot
      left join own_facts o on o.symbol = g.symbol and o.session_date = g.session_date and o.known_slot = g.slot
      left join market_facts k on k.session_date = g.session_date and k.known_slot = g.slot left join traded p on p.symbol = g.symbol and p.session_date = g.session_date),
    a as (select symbol, sector, session_date, earlier, slot, high, low, close, volume, traded,
        @last_known(close) over so as ltp, @first_known(open) over so as first_open, count(close) over so as bars_present, max(case when close is not null then slot end) over so as last_slot,
        case when slot = 0 then @ln(@over(close, open)) else @ln(@over(close, lag(close) over d)) end as r, volume * close / {s.crore} as traded_value,
        max(high) over so as day_high, min(low) over so as day_low, sum(volume) over so as volume_session, coalesce(sum(volume * close / {s.crore}) over so, 0e0) as turnover,
        max(case when slot < {s.opening} then high end) over so as opening_high, min(case when slot < {s.opening} then low end) over so as opening_low,
        coalesce(sum(volume) over {short}, 0) as recent, coalesce(sum(volume) over {prior}, 0) as prior, count(case when high = low then 1 end) over {middle} as flat, {known}
      from j window d as ({DAY}), so as ({DAY} rows between unbounded preceding and current row)),
    b as (select a.*, coalesce(today_open, first_open) as day_open, @ln(@over(ltp, lag(ltp, {s.short}) over d)) as ret_5m, @ln(@over(ltp, lag(ltp, {s.middle}) over d)) as ret_10m, @ln(@over(ltp, lag(ltp, {s.long}) over d)) as ret_15m, @ln(@over(ltp, lag(ltp, {s.far}) over d)) as ret_30m,
        @ln(@over(lag(ltp, {s.short}) over d, lag(ltp, {s.middle}) over d)) as before_5m, count(r) over {so} as n_r, stddev_samp(r) over {so} as sd_all, count(r) over {long} as n_long, stddev_samp(r) over {long} as sd_long, avg(abs(r)) over {so} as mean_abs,
        avg(case when traded_value > 0 then abs(r) / traded_value end) over {so} as amihud, count(case when r > 0 then 1 end) over {middle} as ups, count(case when r < 0 then 1 end) over {middle} as downs,
        count(case when r is not null and volume is not null then 1 end) over {long} as pairs, covar_pop(abs(r), ln(1 + volume)) over {long} as cov,
        stddev_pop(case when volume is not null then abs(r) end) over {long} as sd_abs, stddev_pop(case when r is not null then ln(1 + volume) end) over {long} as sd_volume
      from a window d as ({DAY})),
    c as (select b.*, @ln(@over(ltp, day_open)) as ret_open, case when n_r >= {s.least} then sd_all end as rvol_session, case when n_long >= {s.least} then sd_long end as rvol_15m, case when slot + 1 >= {s.opening} then opening_high end as or_high, case when slot + 1 >= {s.opening} then opening_low end as or_low,
        @pctl(case when traded = 1 then coalesce(volume_session, 0) end, 0.5) over {norms} as usual_volume, @pctl(mean_abs, 0.5) over {norms} as usual_abs from b),
    i as (select priority, session_date, slot, @ln(@over(@last_known(close) over so, @first_known(open) over so)) as ret_open, @ln(@over(close, lag(close, {s.long}) over d)) as ret_15m
      from (select y.priority, q.session_date, q.slot, x.open, x.close from (select distinct priority from {{index_bars}}) y cross join (select session_date, slot from days cross join slots) q
        left join {{index_bars}} x on x.priority = y.priority and x.session_date = q.session_date and x.slot = q.slot) t
      window d as (partition by priority, session_date order by slot), so as (partition by priority, session_date order by slot rows between unbounded preceding and current row)),
    ix as (select session_date, slot, ret_open as index_open, ret_15m as index_15m from (select i.*, row_number() over (partition by session_date, slot order by priority) as place from i where ret_open is not null) x where place = 1),
    n as (select c.*, index_open, index_15m, @pctl(ret_open, 0.5) over m as median_open, @pctl(ret_15m, 0.5) over m as median_15m, avg(case when ret_open > 0 then 1e0 when ret_open is not null then 0e0 end) over m as breadth,
        case when count(ret_open) over m > 2 then stddev_samp(ret_open) over m end as dispersion, case when sector is not null and count(ret_open) over s >= {s.peers} then count(ret_open) over s end as members, sum(ret_open) over s as total,
        avg(case when ret_open > 0 then 1e0 when ret_open is not null then 0e0 end) over s as up
      from c left join ix on ix.session_date = c.session_date and ix.slot = c.slot window m as (partition by c.session_date, c.slot), s as (partition by c.session_date, c.slot, c.sector)),
    e as (select n.*, coalesce(index_open, median_open) as market_ret_open, case when index_open is null then median_15m else index_15m end as market_ret_15m, case when members > 0 then total / members end as sector_ret_open, case when members > 0 then up end as sector_breadth,
        case when members > 1 then ret_open - (total - ret_open) / (members - 1) end as rel_sector_open, case when usual_volume > 0 then volume_session / usual_volume end as rel_volume from n)
    select {K}, sector, ltp, previous_close as prev_close, day_open as open, (@over(day_open, previous_close) - 1) * 100 as gap_pct, (@over(ltp, day_open) - 1) * 100 as ret_open_pct, (@over(ltp, previous_close) - 1) * 100 as ret_prev_close_pct, day_high, day_low, @over((day_high - day_low), day_open) * 100 as range_pct,
      r as ret_1m, ret_5m, ret_10m, ret_15m, ret_30m, ret_5m - before_5m as accel_5m,
      case when slot + 1 > {s.middle} and ups + downs >= {s.least_signs} then case when ret_10m > 0 then ups / (1e0 * (ups + downs)) when ret_10m < 0 then downs / (1e0 * (ups + downs)) else 0e0 end end as persistence_10m,
      volume_session, turnover as turnover_session_cr, rel_volume, case when slot + 1 >= {2 * s.short} and prior > 0 then recent / (1e0 * prior) end as volume_accel, case when slot + 1 >= {s.long} and pairs >= {s.least} and sd_abs > 1e-9 and sd_volume > 1e-9 then cov / (sd_abs * sd_volume) end as pv_corr_15m,
      or_high, or_low, case when or_high > or_low then (ltp - or_low) / (or_high - or_low) end as or_position, case when ltp > or_high then 1e0 when ltp < or_low then -1e0 when ltp is not null and or_high is not null then 0e0 end as breakout_state,
      case when day_high > day_low then (ltp - day_low) / (day_high - day_low) end as range_position, @over((day_high - day_low), day_open) / nullif(rvol_session * sqrt(slot + 1e0), 0) as range_vs_vol,
      case when ret_5m > 0 and ret_15m > 0 and ret_open > 0 then 1e0 when ret_5m < 0 and ret_15m < 0 and ret_open < 0 then -1e0 when ret_5m is not null and ret_15m is not null and ret_open is not null then 0e0 end as trend_state,
      ret_open - market_ret_open as rel_market_open, rel_sector_open, ret_15m - market_ret_15m as rel_market_15m, response_gap, response_gap_sigma, pending_response_sigma,
      case when ret_open is not null then {mean_rank.format("ret_open")} end as pct_ret_open, case when rel_volume is not null then {mean_rank.format("rel_volume")} end as pct_rel_volume,
      rvol_session, rvol_15m, case when usual_abs > 0 then mean_abs / usual_abs end as vol_ratio, rvol_15m / nullif(rvol_session, 0) as vol_expansion,
      bars_present / (slot + 1e0) as activity, case when n_r >= {s.least} then amihud end as illiquidity, spread_bps, depth5, imbalance1, ofi_norm, signed_flow, nifty_atm_iv, nifty_budget_ratio,
      market_ret_open, breadth, dispersion, sector_ret_open, sector_breadth, market_state_code, least(earlier, {s.lookback}) as history_sessions,
      bars_present, bars_present / (slot + 1e0) as completeness, slot - last_slot as last_bar_age_min, case when slot - last_slot < {s.stale} then 0 else 1 end as stale, case when slot + 1 >= {s.middle} and flat = {s.middle} then 1 else 0 end as frozen
    from e{"" if decision is None else f" where slot = {decision}"}"""


def rounded(sql: str, columns: tuple[str, ...] = COLUMNS, keys: str = "symbol, session_date, slot, sector") -> str:
    """The same rows with numbers to six digits after the point."""
    return f"select {keys}, {', '.join(f'round(cast({c} as double), 6) + 0e0 as {c}' for c in columns)} from ({sql}) x"


#: The stand-in's slots are hours and its stocks a dozen, so lengths and needs are smaller.
HOURS = Scale(slots=24, short=2, middle=4, long=6, far=12, opening=3, stale=2, least=4, least_signs=2, peers=3, lookback=20, crore="1e4")
#: Where the stand-in decides, after twelve of its hours.
DECISION = 11


def over_desk(sql: str) -> str:
    """sql over the stand-in desk's tables."""
    for x in ("bars", "universe", "index_bars", "facts"):
        sql = sql.replace(f"{{{x}}}", f"{{desk_{x}}}")
    return sql


OPERATORS = [Operator("eng_18", rounded(over_desk(matrix_sql(HOURS, DECISION))))]
