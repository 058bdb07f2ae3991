"""A daily selector that learns from earlier sessions only.

One text for each relational step (eligibility, design, picks, choice, decision). The model in between is a ridge over a moving window of
sessions: each session's rows leave only their products' sums, sums of sessions add up, and one small system is solved for each
session over the sums of the sessions before it. So no session's data is read again for another day's model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEATURES = (
    "rel_market_open", "ret_5m", "ret_15m", "accel_5m", "persistence_10m", "gap_pct", "rel_volume", "volume_accel",
    "pv_corr_15m", "or_position", "breakout_state", "range_position", "range_vs_vol", "trend_state",
    "rel_sector_open", "response_gap_sigma", "pending_response_sigma", "rvol_session", "vol_ratio", "vol_expansion",
    "illiquidity", "market_ret_open", "breadth", "dispersion",
)
LOGS = ("rel_volume", "volume_accel", "illiquidity", "rvol_session", "vol_ratio", "range_vs_vol")
#: Constant within a session: kept raw as (x - offset) * scale.
RAW = {"market_ret_open": (0.0, 100.0), "breadth": (0.5, 1.0), "dispersion": (0.0, 100.0)}


@dataclass(frozen=True)
class Rules:
    """Parameters of the selector; the defaults are for minutes."""

    completeness: float = 0.8
    age: int = 2
    price: float = 10.0
    turnover: float = 1.0
    winsor: float = 4.0
    alpha: float = 50.0
    window: int = 40
    least_days: int = 15
    least_rows: int = 100
    history: int = 80
    compare_days: int = 15
    calibration_days: int = 20
    first_picks: int = 50
    most_error: float = 0.05
    cost: float = 12e-4
    least_ic: int = 10


def outcomes_sql(decision: int, horizons: tuple[int, ...], within: int) -> str:
    """Over bars: entry at the first open within `within` slots after the decision slot, and for each horizon the way to its end.

    symbol, session_date, horizon, entry, exit, forward, mfe, mae (logarithms, for a rise) and the slots until both, the first of equal ones.
    """
    start = decision + 1
    spans = " union all ".join(f"select {h} as horizon" for h in horizons)
    return f"""with e as (select symbol, session_date, min(slot) as entry_slot, min_by(open, slot) as entry from {{bars}} where slot >= {start} and slot < {start + within} and open is not null group by symbol, session_date),
    p as (select e.symbol, e.session_date, h.horizon, e.entry, b.slot, b.close, @ln(@over(b.high, e.entry)) as up, @ln(@over(b.low, e.entry)) as down from e cross join ({spans}) h join {{bars}} b on b.symbol = e.symbol and b.session_date = e.session_date and b.slot >= e.entry_slot and b.slot < {start} + h.horizon),
    r as (select p.*, row_number() over (partition by symbol, session_date, horizon order by up desc, slot) as up_place, row_number() over (partition by symbol, session_date, horizon order by down, slot) as down_place from p)
    select symbol, session_date, horizon, max(entry) as entry, max_by(close, slot) as exit, @ln(@over(max_by(close, slot), max(entry))) as forward, greatest(max(up), 0e0) as mfe, least(min(down), 0e0) as mae,
      max(case when up_place = 1 then slot end) - {decision} as t_mfe, max(case when down_place = 1 then slot end) - {decision} as t_mae from r group by symbol, session_date, horizon"""


def rows_sql(rules: Rules, decision: int) -> str:
    """Over matrix (a row for each symbol and session) and outcomes (of one horizon): eligibility, the first score and both designs.

    A design is standardised over the rows it is for: those with an outcome to learn from (t_*), all eligible ones to predict (p_*). An
    unknown value is the mean of its session.
    """
    r = rules
    core = "ltp is not null and ret_open_pct is not null and rvol_session is not null"

    def robust(x: str, name: str) -> str:
        return f"case when n_{name} >= 3 then least(greatest(({x} - m_{name}) / case when d_{name} > 0 then d_{name} * 14826e-4 when s_{name} > 0 then s_{name} else 1e0 end, {-2 * r.winsor}e0), {2 * r.winsor}e0) end"

    def value(x: str) -> str:
        return f"case when {x} > 0 then ln({x}) end" if x in LOGS else f"cast({x} as double)"

    scaled = [x for x in FEATURES if x not in RAW]
    stats = ", ".join(
        f"count(case when {mask} then v_{x} end) over d as n_{side}_{x}, avg(case when {mask} then v_{x} end) over d as a_{side}_{x}, stddev_pop(case when {mask} then v_{x} end) over d as s_{side}_{x}"
        for side, mask in (("t", "eligible and forward is not null"), ("p", "eligible")) for x in scaled
    )

    def column(side: str, x: str) -> str:
        if x in RAW:
            return f"coalesce((v_{x} - {RAW[x][0]}e0) * {RAW[x][1]}e0, 0e0) as {side}_{x}"
        z = f"(v_{x} - a_{side}_{x}) / s_{side}_{x}"
        return f"case when n_{side}_{x} >= 3 and s_{side}_{x} > 1e-12 then coalesce(least(greatest({z}, {-r.winsor}e0), {r.winsor}e0), 0e0) else 0e0 end as {side}_{x}"

    designs = ", ".join(column(side, x) for side in "tp" for x in FEATURES)
    return f"""with j as (select m.*, o.forward, o.mfe, o.mae, {core} as core,
        {core} and completeness >= {r.completeness}e0 and last_bar_age_min <= {r.age} and frozen = 0 and prev_close is not null and ltp >= {r.price}e0 and turnover_session_cr >= {r.turnover}e0 as strict, {core} and frozen = 0 and ltp >= {r.price}e0 as relaxed
      from {{matrix}} m left join {{outcomes}} o on o.symbol = m.symbol and o.session_date = m.session_date),
    k as (select j.*, case when max(case when strict then 1 else 0 end) over d = 1 then 'STRICT' when max(case when relaxed then 1 else 0 end) over d = 1 then 'RELAXED' when max(case when core then 1 else 0 end) over d = 1 then 'MINIMAL' else 'NONE' end as tier from j window d as (partition by session_date)),
    e as (select k.*, coalesce(case tier when 'STRICT' then strict when 'RELAXED' then relaxed else core end, false) as eligible, rel_market_open / nullif(rvol_session * sqrt({decision + 1}e0), 0) as drive, case when rel_volume > 0 then ln(rel_volume) end as log_volume, {', '.join(f'{value(x)} as v_{x}' for x in FEATURES)} from k),
    s as (select e.*, count(case when eligible then drive end) over d as n_drive, @pctl(case when eligible then drive end, 0.5) over d as m_drive, stddev_pop(case when eligible then drive end) over d as s_drive,
        count(case when eligible then log_volume end) over d as n_volume, @pctl(case when eligible then log_volume end, 0.5) over d as m_volume, stddev_pop(case when eligible then log_volume end) over d as s_volume, {stats},
        @pctl(case when eligible then forward end, 0.01) over d as low, @pctl(case when eligible then forward end, 0.99) over d as high, count(case when eligible then forward end) over d as n_forward from e window d as (partition by session_date)),
    t as (select s.*, @pctl(case when eligible then abs(drive - m_drive) end, 0.5) over d as d_drive, @pctl(case when eligible then abs(log_volume - m_volume) end, 0.5) over d as d_volume from s window d as (partition by session_date)),
    z as (select t.*, case when eligible then {robust('drive', 'drive')} end as z_drive, case when eligible then {robust('log_volume', 'volume')} end as z_volume from t)
    select session_date, symbol, sector, tier, eligible, stale, forward, mfe, mae, case when n_forward > 10 then least(greatest(forward, low), high) else forward end * 1e4 as target,
      (abs(z_drive) + 5e-1 * greatest(coalesce(z_volume, 0e0), 0e0) + 25e-2 * (coalesce(trend_state, 0e0) + coalesce(breakout_state, 0e0)) * sign(z_drive)) * sign(z_drive) as signed_v1, cast(sign(z_drive) as int) as direction_v1, {designs} from z"""


def daily_sums(rows: DataFrame, day: str, xs: list[str], y: str) -> DataFrame:
    """day, n and sums: the upper triangle of the products of (1, xs, y), summed over the day's rows. Rows with a null don't count.

    Days are dealt over tasks; a task holds one small matrix for each of its days.
    """
    width = len(xs) + 2
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        for b in batches:
            days = b.column(0).to_pylist()
            x = np.column_stack([np.ones(b.num_rows), *(b.column(k).to_numpy(zero_copy_only=False) for k in range(1, width))])
            names = {d: k for k, d in enumerate(dict.fromkeys(days))}
            of = np.array([names[d] for d in days])
            for d, k in names.items():
                part = x[of == k]
                held[d] = held.get(d, 0) + part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), b_type), pa.array([m[upper].tolist() for m in held.values()], pa.list_(pa.float64()))], [day, "sums"])

    clean = rows.select(day, *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).dropna()
    b_type = pa.date32() if clean.schema[day].dataType.typeName() == "date" else pa.string()
    return clean.repartition(day).mapInArrow(run, f"{day} {clean.schema[day].dataType.simpleString()}, sums array<double>")


def walk_forward(sums: DataFrame, days: DataFrame, day: str, width: int, window: int, least_days: int, least_rows: int, alpha: float) -> DataFrame:
    """day, train_days, train_rows and coef (the intercept, which isn't shrunk, first): a ridge on the `window` days before each day.

    days has every day once; a day without rows counts as one of a window. coef is null before least_days days or under least_rows rows. Every entry of
    the sums is added up on its own, so days are never collected; then one small system is solved for each day.
    """
    upper = np.triu_indices(width)
    n = len(upper[0])
    entries = days.select(day).join(sums, day, "left")
    zero = F.array_repeat(F.lit(0.0), n)
    entries = entries.select(day, F.posexplode(F.coalesce("sums", zero)).alias("entry", "value"))
    before = W.partitionBy("entry").orderBy(day).rowsBetween(-window, -1)
    moved = entries.select(day, "entry", F.sum("value").over(before).alias("value"), F.count("*").over(before).alias("days"))
    whole = moved.groupBy(day).agg(F.max("days").alias("train_days"), F.sort_array(F.collect_list(F.struct("entry", F.coalesce("value", F.lit(0.0)).alias("value")))).alias("v"))
    whole = whole.select(day, "train_days", F.col("v.value").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coefs, counts = [], []
            for days_, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                m = np.zeros((width, width))
                m[upper] = v
                m = m + np.triu(m, 1).T
                counts.append(int(round(m[0, 0])))
                if days_ < least_days or counts[-1] < least_rows:
                    coefs.append(None)
                    continue
                penalty = alpha * np.eye(width - 1)
                penalty[0, 0] = 0.0
                coefs.append(np.linalg.solve(m[:-1, :-1] + penalty, m[:-1, -1]).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(coefs, pa.list_(pa.float64()))], [day, "train_days", "train_rows", "coef"])

    return whole.mapInArrow(run, f"{day} {whole.schema[day].dataType.simpleString()}, train_days long, train_rows long, coef array<double>")


def predicted(rows: DataFrame, fits: DataFrame, day: str, xs: list[str]) -> DataFrame:
    """rows with train_days, train_rows and prediction: coef of the row's day times (1, xs)."""
    dot = F.aggregate(F.zip_with(F.slice("coef", 2, len(xs)), F.array(*xs), lambda c, x: c * x), F.get("coef", F.lit(0)), lambda a, v: a + v)
    return rows.join(fits, day, "left").withColumn("prediction", dot).drop("coef")


def picks_sql(rules: Rules) -> str:
    """Over scored (rows with prediction): a row for each session with the pick of either score among rows with an outcome, and the day's rank correlation."""
    rank = "(rank() over (partition by session_date order by {0}) + (count(*) over (partition by session_date, {0}) - 1) / 2e0)"
    return f"""with k as (select * from {{scored}} where eligible and forward is not null),
    a as (select k.*, count(*) over (partition by session_date) as n from k),
    p1 as (select session_date, symbol as symbol_v1, direction_v1 * forward as return_v1, case when direction_v1 > 0 then mfe else -mae end as mfe_v1, case when direction_v1 > 0 then mae else -mfe end as mae_v1
      from (select a.*, row_number() over (partition by session_date order by round(abs(signed_v1), 9) desc, symbol) as place from a where n >= 3 and signed_v1 is not null) x where place = 1),
    p2 as (select session_date, symbol as symbol_v2, case when prediction < 0 then -forward else forward end as return_v2, case when prediction < 0 then -mae else mfe end as mfe_v2, case when prediction < 0 then -mfe else mae end as mae_v2
      from (select a.*, row_number() over (partition by session_date order by round(abs(prediction), 9) desc, symbol) as place from a where n >= 3 and prediction is not null) x where place = 1),
    q as (select session_date, {rank.format('round(prediction, 9)')} as x, {rank.format('round(forward, 12)')} as y from a where n >= 3 and prediction is not null),
    c as (select session_date, case when count(*) >= {rules.least_ic} and stddev_pop(x) > 0 and stddev_pop(y) > 0 then covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) end as ic from q group by session_date)
    select d.session_date, p1.symbol_v1, p1.return_v1, p1.mfe_v1, p1.mae_v1, p2.symbol_v2, p2.return_v2, p2.mfe_v2, p2.mae_v2, c.ic
    from (select distinct session_date from {{scored}}) d left join p1 on p1.session_date = d.session_date left join p2 on p2.session_date = d.session_date left join c on c.session_date = d.session_date"""


def choice_sql(rules: Rules) -> str:
    """Over picks: which score decides a session, by earlier sessions alone: the second only if it beat the first out of sample."""
    r = rules
    both = "return_v1 is not null and return_v2 is not null"
    return f"""with h as (select session_date, count(case when {both} then 1 end) over w as common_days, avg(case when {both} then return_v1 end) over w - {r.cost} as net_v1, avg(case when {both} then return_v2 end) over w - {r.cost} as net_v2,
        count(ic) over w as ic_days, avg(ic) over w as ic_mean, case when count(ic) over w >= 3 then avg(ic) over w / nullif(stddev_samp(ic) over w / sqrt(1e0 * count(ic) over w), 0) end as ic_t,
        count(return_v1) over w as picks_v1, count(case when return_v1 > 0 then 1 end) over w as hits_v1, avg(return_v1) over w as mean_v1, stddev_samp(return_v1) over w as sd_v1, avg(mfe_v1) over w as mfe_v1, avg(mae_v1) over w as mae_v1,
        count(return_v2) over w as picks_v2, count(case when return_v2 > 0 then 1 end) over w as hits_v2, avg(return_v2) over w as mean_v2, stddev_samp(return_v2) over w as sd_v2, avg(mfe_v2) over w as mfe_v2, avg(mae_v2) over w as mae_v2
      from {{picks}} window w as (order by session_date rows between {r.history} preceding and 1 preceding))
    select h.*, case when common_days >= {r.compare_days} and net_v2 > net_v1 and ic_mean > 0 and ic_t > 2 then 'v2' else 'v1' end as model from h"""


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a and b of P(y = 1) = 1 / (1 + exp(-(a + b x))) by Newton's steps; a tiny ridge keeps them finite where x separates y."""
    at = np.zeros(2)
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        w = p * (1 - p)
        step = np.linalg.solve(design.T @ (design * w[:, None]) + 1e-6 * np.eye(2), design.T @ (y - p) - 1e-6 * at)
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def calibrations(scored: DataFrame, days: DataFrame, rules: Rules) -> DataFrame:
    """session_date, oos_days, points, scale, a, b and ece: how often the second score had the direction right, by its size, on the `history` sessions before.

    Every earlier point goes to the sessions that may learn from it; a group is the points of at most `history` sessions.
    """
    number = days.select("session_date", F.row_number().over(W.orderBy("session_date")).alias("number"))
    points = scored.where("eligible and forward is not null and prediction is not null").join(F.broadcast(number), "session_date")
    later = points.select("number", "prediction", "forward", F.explode(F.sequence(F.col("number") + 1, F.col("number") + rules.history)).alias("at"))
    later = later.join(F.broadcast(number.select(F.col("number").alias("at"), "session_date")), "at").select("session_date", "number", "prediction", "forward")

    def fit(t: pa.Table) -> pa.Table:
        number, pred, real = (t.column(c).to_numpy() for c in ("number", "prediction", "forward"))
        order = np.lexsort((real, pred, number))
        number, pred, real = number[order], pred[order], real[order]
        days_ = len(np.unique(number))
        pred, real = pred[real != 0], real[real != 0]
        scale = float(np.std(pred)) or 1.0 if len(pred) else 1.0
        x, hit = np.abs(pred) / scale, (np.sign(pred) == np.sign(real)).astype(float)
        a, b = logistic(x, hit)
        p = np.round(1 / (1 + np.exp(-(a + b * x))), 9)
        ece = 0.0
        if len(p):
            edges = np.round(np.quantile(p, np.linspace(0, 1, 11)), 9)
            for low, high in zip(edges, edges[1:], strict=False):
                some = (p >= low) & (p <= high)
                ece += some.mean() * abs(hit[some].mean() - p[some].mean()) if some.any() else 0.0
        return pa.table({"session_date": t.column("session_date").slice(0, 1), "oos_days": [days_], "points": [len(pred)], "scale": [scale], "a": [a], "b": [b], "ece": [ece]})

    return later.groupBy("session_date").applyInArrow(fit, "session_date date, oos_days long, points long, scale double, a double, b double, ece double")


def decisions_sql(rules: Rules) -> str:
    """Over scored, choice and calibration: one symbol and direction a session, with what earlier sessions say of its chances.

    Where the second score has no value today the first decides. The selection score is the percentile of the strength among
    eligible symbols; ties go to the smaller symbol.
    """
    r = rules
    z = "196e-2"

    def wilson(sign: str) -> str:
        p = "(hits / nullif(1e0 * picks, 0))"
        return f"case when picks > 0 then ({p} + {z} * {z} / (2 * picks) {sign} {z} * sqrt({p} * (1 - {p}) / picks + {z} * {z} / (4e0 * picks * picks))) / (1 + {z} * {z} / picks) end"

    return f"""with c as (select s.*, h.model as chosen, max(case when s.eligible and s.prediction is not null then 1 else 0 end) over (partition by s.session_date) as can_v2, count(*) over (partition by s.session_date) as universe, count(case when s.eligible then 1 end) over (partition by s.session_date) as n_eligible
      from {{scored}} s join {{choice}} h on h.session_date = s.session_date),
    m as (select c.*, case when chosen = 'v2' and can_v2 = 1 then 'v2' else 'v1' end as model from c),
    v as (select m.*, case when eligible then round(case when model = 'v2' then prediction else signed_v1 end, 9) end as signed from m),
    k as (select v.*, row_number() over (partition by session_date order by abs(signed) desc, symbol) as place,
        100 * ((rank() over (partition by session_date order by abs(signed))) + ((count(*) over (partition by session_date, abs(signed))) - 1) / 2e0 - 5e-1) / (count(*) over (partition by session_date)) as selection_score from v where signed is not null),
    u as (select session_date, @listed(cast(place as varchar(9)) || ':' || cast(symbol as varchar(20)) || case when signed > 0 then ' UP' else ' DOWN' end) as runners_up from k where place between 2 and 6 group by session_date),
    d as (select k.session_date, k.symbol, k.sector, k.tier, k.stale, k.model, case when k.signed < 0 then 'DOWN' else 'UP' end as direction, k.signed, k.prediction, k.selection_score, k.universe, k.n_eligible, k.train_days, u.runners_up, h.common_days, h.net_v1, h.net_v2, h.ic_mean, h.ic_t,
        case k.model when 'v2' then h.picks_v2 else h.picks_v1 end as picks, case k.model when 'v2' then h.hits_v2 else h.hits_v1 end as hits, case k.model when 'v2' then h.mean_v2 else h.mean_v1 end as mean_return, case k.model when 'v2' then h.sd_v2 else h.sd_v1 end as sd_return,
        case k.model when 'v2' then h.mfe_v2 else h.mfe_v1 end as mfe, case k.model when 'v2' then h.mae_v2 else h.mae_v1 end as mae, q.a, q.b, q.scale, q.oos_days, q.ece
      from k left join u on u.session_date = k.session_date join {{choice}} h on h.session_date = k.session_date left join {{calibration}} q on q.session_date = k.session_date where k.place = 1)
    select session_date, symbol, sector, tier, model, direction, selection_score, universe, n_eligible, train_days, coalesce(runners_up, '') as runners_up, common_days, net_v1 * 1e4 as net_v1_bps, net_v2 * 1e4 as net_v2_bps, ic_mean, ic_t, picks as oos_picks, hits / nullif(1e0 * picks, 0) as hit_rate, {wilson('-')} as hit_low, {wilson('+')} as hit_high,
      case when model = 'v2' then 1 / (1 + exp(-(a + b * abs(prediction) / scale))) when picks > 0 then (hits + 1) / (picks + 2e0) end as probability,
      case when model = 'v2' and oos_days >= {r.calibration_days} and ece <= {r.most_error} or model = 'v1' and picks >= {r.first_picks} then 'CALIBRATED_OOS' else 'UNCALIBRATED' end as status,
      case when model = 'v2' then abs(prediction) / 100 else 100 * mean_return end as expected_return_pct, 100 * mean_return as oos_mean_return_pct, 100 * (mean_return - {r.cost}) as oos_mean_net_pct, 100 * sd_return as oos_sd_pct, 100 * mfe as mfe_pct, 100 * mae as mae_pct,
      case when tier = 'STRICT' and stale = 0 then 'PASS' else 'DEGRADED' end as quality from d"""
