"""What a chain of options expects of its underlying, at every as-of slot: from the latest chain snapshot known then, from the
returns realised by then against the share of a session's variance that earlier sessions had spent by then, and from futures."""

from __future__ import annotations

from tickloom.plans.dialect import Operator

FIELDS = (
    "snapshot_slot", "snapshot_age", "expiry", "days_to_expiry", "spot", "atm_strike", "atm_iv", "implied_daily_move_pct", "straddle", "straddle_pct", "implied_sd_to_expiry_pct",
    "realised_var", "realised_move_pct", "budget_consumed", "expected_share", "expected_share_low", "expected_share_high", "budget_ratio", "skew", "skew_method", "put_call_oi",
    "ce_oi_change", "pe_oi_change", "basis_bps", "basis_z", "tail_z", "atm_spread_share", "strikes_with_iv", "profile_sessions", "stale_snapshot", "note",
)


def expectation_sql(slots: int = 375, oldest: int = 3, keep_stale: bool = False, covered: float = 0.9, lookback: int = 60, least_basis: int = 10, far: float = 0.03, year: int = 252) -> str:
    """SQL over legs (underlying, session_date, slot, expiry, spot, strike, side CE or PE, iv, delta, bid, ask, last_price, oi,
    previous_oi), returns (underlying, session_date, slot, r) and futures (underlying, session_date, slot, price, spot).

    A row for each underlying, session and as-of slot, of what is known when that slot has closed. A snapshot counts for
    `oldest` slots after its own; beyond, what it says is null (or stays, flagged, with keep_stale). IV comes as a fraction or
    in percent. Profiles come from earlier sessions with returns for a `covered` part of the slots. 31 columns: the
    band is its two ends, the uncertainty its four parts.
    """
    iv = "case when iv > 3 then iv / 100 when iv > 0 then iv end"
    mid = "case when bid > 0 and ask >= bid then (bid + ask) / 2 else last_price end"
    of_day = "(partition by underlying, session_date order by slot rows between unbounded preceding and current row)"
    earlier = f"(partition by underlying, slot order by session_date rows between {lookback} preceding and 1 preceding)"
    chain = (
        "expiry", "spot", "atm_strike", "atm_iv", "straddle", "atm_spread", "skew", "skew_method", "ce_oi", "pe_oi", "ce_previous", "pe_previous", "strikes_with_iv",
    )
    fresh = "true" if keep_stale else f"slot - snapshot_slot <= {oldest}"
    return f"""with l as (select *, {iv} as v, {mid} as mid, case when bid > 0 and ask >= bid then ask - bid end as width from {{legs}}),
    k as (select l.*, row_number() over (partition by underlying, session_date, slot order by abs(strike - spot), strike) as near,
        row_number() over (partition by underlying, session_date, slot, side order by case when v is null or delta is null or abs(abs(delta) - 25e-2) >= 1e-1 or (side = 'PE') <> (delta < 0) then 1 else 0 end, abs(abs(delta) - 25e-2), v) as by_delta,
        case when v is not null and abs(abs(delta) - 25e-2) < 1e-1 and (side = 'PE') = (delta < 0) then v end as wing,
        dense_rank() over (partition by underlying, session_date, slot order by abs(strike - spot * (1 - {far}e0)), strike) as low_rank, dense_rank() over (partition by underlying, session_date, slot order by abs(strike - spot * (1 + {far}e0)), strike) as high_rank from l),
    a as (select k.*, max(case when near = 1 then strike end) over (partition by underlying, session_date, slot) as atm from k),
    c as (select underlying, session_date, slot, min(expiry) as expiry, min(spot) as spot, min(atm) as atm_strike, avg(case when strike = atm then v end) as atm_iv,
        max(case when strike = atm and side = 'CE' then mid end) + max(case when strike = atm and side = 'PE' then mid end) as straddle, max(case when strike = atm and side = 'CE' then width end) + max(case when strike = atm and side = 'PE' then width end) as atm_spread,
        max(case when side = 'PE' and by_delta = 1 then wing end) - max(case when side = 'CE' and by_delta = 1 then wing end) as risk_reversal,
        case when min(case when low_rank = 1 then strike end) <> min(case when high_rank = 1 then strike end) then max(case when side = 'PE' and low_rank = 1 then v end) - max(case when side = 'CE' and high_rank = 1 then v end) end as otm,
        sum(case when side = 'CE' then coalesce(oi, 0) end) as ce_oi, sum(case when side = 'PE' then coalesce(oi, 0) end) as pe_oi, sum(case when side = 'CE' then coalesce(previous_oi, 0) end) as ce_previous, sum(case when side = 'PE' then coalesce(previous_oi, 0) end) as pe_previous,
        count(v) as strikes_with_iv from a group by underlying, session_date, slot),
    d as (select c.*, coalesce(risk_reversal, otm) as skew, case when risk_reversal is not null then 'risk_reversal_25d' when otm is not null then 'iv_otm' end as skew_method from c),
    keys as (select distinct underlying, session_date from {{returns}} union select distinct underlying, session_date from {{legs}} union select distinct underlying, session_date from {{futures}}),
    grid as (select underlying, session_date, cast(slot as int) as slot from keys cross join (select @each(0, {slots - 1}) as slot) s),
    g as (select grid.underlying, grid.session_date, grid.slot, r.r, (f.price - f.spot) / nullif(f.spot, 0) * 1e4 as basis, d.slot as snapshot, {', '.join(f'd.{x}' for x in chain)}
      from grid left join {{returns}} r on r.underlying = grid.underlying and r.session_date = grid.session_date and r.slot = grid.slot left join {{futures}} f on f.underlying = grid.underlying and f.session_date = grid.session_date and f.slot = grid.slot
      left join d on d.underlying = grid.underlying and d.session_date = grid.session_date and d.slot = grid.slot),
    numbered as (select g.*, max(snapshot) over {of_day} as snapshot_slot, sum(r * r) over {of_day} as realised_var, count(r) over {of_day} as n_r, @last_known(r) over {of_day} as last_r,
        @last_known(basis) over {of_day} as basis_bps, max(case when basis is not null then slot end) over {of_day} as basis_slot, sum(r * r) over (partition by underlying, session_date) as whole_var, count(r) over (partition by underlying, session_date) as whole_n from g),
    shared as (select n.*, case when whole_n >= {covered * slots}e0 and whole_var > 0 then coalesce(realised_var, 0) / whole_var end as share, coalesce(avg(basis) over b, 0e0) as basis_mean, stddev_pop(basis) over b as basis_sd, count(basis) over {of_day} as basis_n from numbered n
      window b as (partition by underlying, session_date, basis is null order by slot rows between unbounded preceding and 1 preceding)),
    profiled as (select s.*, @pctl(share, 0.5) over {earlier} as p50, @pctl(share, 0.1) over {earlier} as p10, @pctl(share, 0.9) over {earlier} as p90, count(share) over {earlier} as profile_sessions,
        @last_known(case when basis is not null and basis_n >= {least_basis} and basis_sd > 0 then (basis - basis_mean) / basis_sd end) over {of_day} as basis_z from shared s),
    seen as (select underlying, session_date, slot, snapshot_slot, realised_var, n_r, last_r, basis_bps, basis_z, p50, p10, p90, profile_sessions, {', '.join(f'case when {fresh} then first_value({x}) over snapshot end as {x}' for x in chain)}
      from profiled window snapshot as (partition by underlying, session_date, snapshot_slot order by slot)),
    y as (select seen.*, realised_var / nullif(atm_iv * atm_iv / {year}, 0) as budget_consumed, case when n_r > 0 then p50 end as expected_share from seen)
    select underlying, session_date, slot, snapshot_slot, slot - snapshot_slot as snapshot_age, expiry, greatest(@days(expiry) - @days(session_date) + (1 - (slot + 1) / {slots}e0), 0e0) as days_to_expiry, spot, atm_strike, atm_iv,
      atm_iv / sqrt({year}e0) * 100 as implied_daily_move_pct, straddle, straddle / nullif(spot, 0) * 100 as straddle_pct, straddle / nullif(spot, 0) * 100 / 797884560802865e-15 as implied_sd_to_expiry_pct,
      realised_var, sqrt(realised_var) * 100 as realised_move_pct, budget_consumed, expected_share, case when n_r > 0 then p10 end as expected_share_low, case when n_r > 0 then p90 end as expected_share_high, budget_consumed / nullif(expected_share, 0) as budget_ratio,
      skew, skew_method, pe_oi / nullif(ce_oi, 0) as put_call_oi, ce_oi - ce_previous as ce_oi_change, pe_oi - pe_previous as pe_oi_change, basis_bps, basis_z, last_r / nullif(atm_iv / sqrt({year * slots}e0), 0) as tail_z,
      atm_spread / nullif(straddle, 0) as atm_spread_share, strikes_with_iv, case when n_r > 0 then profile_sessions end as profile_sessions, slot - snapshot_slot > {oldest} as stale_snapshot,
      case when snapshot_slot is null then 'no snapshot by then' when n_r > 0 and profile_sessions = 0 then 'no earlier sessions for the profile' end as note from y"""


TEXTS = ("expiry", "skew_method", "stale_snapshot", "note", "snapshot_slot", "snapshot_age", "strikes_with_iv", "profile_sessions")


def rounded(sql: str) -> str:
    return f"select underlying, session_date, slot, {', '.join(c if c in TEXTS else f'round({c}, 6) + 0e0 as {c}' for c in FIELDS)} from ({sql}) x"


def over_desk(sql: str) -> str:
    for x in ("legs", "returns", "futures"):
        sql = sql.replace(f"{{{x}}}", f"{{desk_{x}}}")
    return sql


OPERATORS = [Operator("eng_16", rounded(over_desk(expectation_sql(slots=24, oldest=2, covered=0.8, lookback=20, least_basis=5))))]
