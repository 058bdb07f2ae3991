"""Queries of the market's state; DuckDB finds the eigenvalues by Jacobi's rotations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.market_state import METRICS, Sizes, history_sql, market_states
from tickloom.plans.dialect import Operator
from tickloom.sources.market import duckdb_tables, market
from tickloom.sources.shared import kept

SIZES = Sizes(window=8, coverage=0.5, stocks=5, top=3, contributors=3, peers=2)
HISTORY = {"window": 8, "around": 1, "lookback": 20, "least": 5, "step": 1}
SLOTS = 24
ROTATIONS = 500


def panel_sql(ln: str = "@ln") -> str:
    """Returns on the full grid, and the market's: the cross-section's median, 0 where nothing traded."""
    return f"""with g as (select u.symbol, u.sector, d.session_date, cast(t.slot as int) as slot from {{desk_universe}} u cross join (select distinct session_date from {{desk_bars}}) d cross join (select @each(0, {SLOTS - 1}) as slot) t),
  j as (select g.*, b.open, b.close, b.close * b.volume as value from g left join {{desk_bars}} b on b.symbol = g.symbol and b.session_date = g.session_date and b.slot = g.slot),
  r as (select session_date, slot, symbol, sector, case when slot = 0 then {ln}(@over(close, open)) else {ln}(@over(close, lag(close) over (partition by symbol, session_date order by slot))) end as r, value from j)
  select r.*, coalesce(@pctl(r, 0.5) over (partition by session_date, slot), 0e0) as market from r"""


PANEL = panel_sql()


def c_ln(x: float | None) -> float | None:
    """The logarithm as the C library rounds it, which is DuckDB's; the JVM's can differ in the last bit."""
    if x is None or x != x:
        return x
    return math.log(x) if x > 0 else -math.inf if x == 0 else math.nan


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the desk. Where a price is back where it was, returns add up to a remainder of rounding, whose sign says whether it counts as up: so their logarithms are the SQL's to the last bit."""
    t = market(spark, sf_dir, ["desk_universe", "desk_bars"])
    spark.udf.register("c_ln", c_ln, "double")
    return market_states(Operator("panel", panel_sql("c_ln"))(**t), SIZES)


def eng_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the market stands as of every slot, and what has changed since the window before."""
    x = _states(spark, sf_dir)
    day = W.partitionBy("session_date").orderBy("slot")
    for name, m in (("corr_change", "mean_correlation"), ("dim_change", "effective_dimension")):
        x = x.withColumn(name, F.col(m) - F.lag(m, SIZES.window).over(day))
    return x.select("session_date", "slot", "stocks", *[(F.round(m, 5) + 0.0).alias(m) for m in (*METRICS, "corr_change", "dim_change")])


def eng_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where it stands among earlier sessions at the same time of day."""
    x = Operator("history", history_sql(**HISTORY))(states=kept(_states(spark, sf_dir), "states"))
    return x.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


S = SIZES
ROTATED = """list_transform(range(n * n), lambda i: case when i % n = p then c * m[(i // n) * n + p + 1] - s * m[(i // n) * n + q + 1] when i % n = q then s * m[(i // n) * n + p + 1] + c * m[(i // n) * n + q + 1] else m[i + 1] end)"""
STATES = f"""{duckdb_tables(['desk_universe', 'desk_bars'])}, panel as ({Operator('', PANEL).in_duckdb()}),
  so_far as (select *, sum(r) over (partition by session_date, symbol order by slot) as so_far from panel),
  windows as (select a.session_date, a.slot as at_slot, b.slot, b.symbol, b.sector, b.r, b.value, b.market, case when b.slot = a.slot then b.so_far end as so_far from (select distinct session_date, slot from panel) a join so_far b on b.session_date = a.session_date and b.slot between a.slot - {S.window - 1} and a.slot),
  widths as (select session_date, at_slot, count(distinct slot) as w from windows group by all),
  vols as (select session_date, at_slot, case when count(*) >= 5 then stddev_samp(market) * 1e4 end as market_vol_bps from (select distinct session_date, at_slot, slot, market from windows) x group by all),
  stocks as (select v.session_date, v.at_slot, v.symbol, any_value(sector) as sector, any_value(w) as w, count(r) as there, avg(coalesce(r, 0)) as mean, stddev_pop(coalesce(r, 0)) as sd, sum(coalesce(r, 0)) as moved, max(so_far) as so_far, sum(case when r is not null then coalesce(value, 0) else 0 end) as value
    from windows v join widths x on x.session_date = v.session_date and x.at_slot = v.at_slot where w >= {max(5, S.window // 2)} group by v.session_date, v.at_slot, v.symbol),
  z as (select v.session_date, v.at_slot, v.slot, v.symbol, s.sector, s.w, (coalesce(v.r, 0) - s.mean) / s.sd as z from windows v join stocks s on s.session_date = v.session_date and s.at_slot = v.at_slot and s.symbol = v.symbol where s.there >= {S.coverage} * s.w and s.sd > 1e-15),
  pairs as (select a.session_date, a.at_slot, a.symbol as i, b.symbol as j, any_value(a.sector) as si, any_value(b.sector) as sj, sum(a.z * b.z) / any_value(a.w) as c from z a join z b on b.session_date = a.session_date and b.at_slot = a.at_slot and b.slot = a.slot group by all),
  peers as (select session_date, at_slot, si, count(distinct i) as k from pairs group by all),
  corr as (select p.session_date, p.at_slot, cast(sqrt(count(*)) as bigint) as n, list(c order by p.i, p.j) as m, avg(case when p.i <> p.j then c end) as mean_correlation, avg(case when p.i <> p.j and p.si = p.sj and k >= {S.peers} then c end) as same
    from pairs p join peers k on k.session_date = p.session_date and k.at_slot = p.at_slot and k.si = p.si group by p.session_date, p.at_slot having count(*) >= {S.stocks ** 2}),
  jacobi as (select session_date, at_slot, 0 as step, n, m from corr
    union all select session_date, at_slot, step + 1, n, list_transform(range(n * n), lambda i: case when i // n = p then c * b[p * n + i % n + 1] - s * b[q * n + i % n + 1] when i // n = q then s * b[p * n + i % n + 1] + c * b[q * n + i % n + 1] else b[i + 1] end)
    from (select *, {ROTATED} as b from (select *, t / sqrt(t * t + 1) as s, 1 / sqrt(t * t + 1) as c from (select *, case when theta >= 0 then 1 else -1 end / (abs(theta) + sqrt(theta * theta + 1)) as t from (select *, (m[q * n + q + 1] - m[p * n + p + 1]) / (2 * m[p * n + q + 1]) as theta
      from (select *, (k - 1) // n as p, (k - 1) % n as q from (select *, list_position(away, list_max(away)) as k from (select *, list_transform(range(n * n), lambda i: case when i // n < i % n then abs(m[i + 1]) else -1.0 end) as away from jacobi where step < {ROTATIONS}) a where list_max(away) > 1e-14) b) c) d) e) f) g),
  spectra as (select session_date, at_slot, n, list_reverse_sort(list_transform(range(n), lambda i: greatest(arg_m[i * n + i + 1], 0.0))) as l from (select session_date, at_slot, any_value(n) as n, arg_max(m, step) as arg_m from jacobi group by session_date, at_slot)),
  far as (select session_date, at_slot, stddev_pop(moved) * 1e4 as dispersion_bps, avg(case when moved > 0 then 1.0 else 0.0 end) as breadth_window, list_reverse_sort(list(abs(value * moved))) as parts from stocks where there > 0 group by session_date, at_slot having count(*) >= {S.stocks}),
  alive as (select session_date, at_slot, avg(case when so_far > 0 then 1.0 else 0.0 end) as breadth_session from stocks where so_far is not null group by all),
  states as (select v.session_date, cast(v.at_slot as int) as slot, coalesce(c.n, 0) as stocks, c.mean_correlation, list_sum(l[1:{S.top}]) / c.n as absorption_ratio, l[1] / c.n as top_eigen_share, c.n * c.n / list_sum(list_transform(l, lambda x: x * x)) as effective_dimension,
      f.dispersion_bps, f.breadth_window, case when f.dispersion_bps is not null then a.breadth_session end as breadth_session, list_sum(f.parts[1:{S.contributors}]) / nullif(list_sum(f.parts), 0) as move_concentration, v.market_vol_bps, c.same - c.mean_correlation as sector_sync
    from vols v left join corr c on c.session_date = v.session_date and c.at_slot = v.at_slot left join spectra p on p.session_date = v.session_date and p.at_slot = v.at_slot left join far f on f.session_date = v.session_date and f.at_slot = v.at_slot left join alive a on a.session_date = v.session_date and a.at_slot = v.at_slot)"""


def oracle_sql() -> dict[str, str]:
    changes = ", ".join(f"round({m} - lag({m}, {S.window}) over d, 5) + 0e0 as {name}" for name, m in (("corr_change", "mean_correlation"), ("dim_change", "effective_dimension")))
    numbers = [*(f"p_{m}" for m in METRICS), "change_score", "persistence"]
    return {
        "eng_14": f"with recursive {STATES} select session_date, slot, stocks, {', '.join(f'round({m}, 5) + 0e0 as {m}' for m in METRICS)}, {changes} from states window d as (partition by session_date order by slot)",
        "eng_15": f"with recursive {STATES} select session_date, slot, {', '.join(f'round({m}, 6) + 0e0 as {m}' for m in numbers)}, state, regime from ({Operator('', history_sql(**HISTORY)).in_duckdb()}) h",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"eng_14": eng_14, "eng_15": eng_15}
