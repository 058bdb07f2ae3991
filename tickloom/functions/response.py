"""How a series answers to a common factor over several lags: ridge per instrument, the factor's realisation, and the gap to what was expected.

An instrument's normal equations are sums, so Spark adds them up; the small system is solved once for each instrument.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.selector import daily_sums


def fitted(panel: DataFrame, key: str, y: str, xs: list[str], ridge: float) -> DataFrame:
    """key, n, a coefficient for each of xs and sigma, the spread of what is left. Rows with a missing value don't count."""
    rows = panel.select(key, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna()
    names = [y, *xs]
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.col(names[a]) * F.col(names[b])).alias(f"s_{a}_{b}") for a, b in pairs])

    def solve(parts):
        for p in parts:
            s = {(a, b): p[f"s_{a}_{b}"].to_numpy() for a, b in pairs}
            at = lambda a, b: s[min(a, b), max(a, b)]  # noqa: B023, E731
            k = len(xs)
            gram = np.array([[at(i + 1, j + 1) + ridge * (i == j) for j in range(k)] for i in range(k)]).transpose(2, 0, 1)
            right = np.array([at(0, i + 1) for i in range(k)]).T
            beta = np.linalg.solve(gram, right[..., None])[..., 0] if len(p) else np.zeros((0, k))
            plain = gram - ridge * np.eye(k)
            left = at(0, 0) - 2 * (beta * right).sum(1) + np.einsum("ni,nij,nj->n", beta, plain, beta)
            out = pd.DataFrame({key: p[key], "n": p["n"], **{x: beta[:, i] for i, x in enumerate(xs)}})
            yield out.assign(sigma=np.sqrt(np.maximum(left, 0) / np.maximum(p["n"], 1)))

    kind = dict(panel.dtypes)[key]
    return sums.mapInPandas(solve, f"{key} {kind}, n bigint, {', '.join(f'{x} double' for x in xs)}, sigma double")


def realised(panel: DataFrame, model: DataFrame, key: str, by: list[str], y: str, loading: str) -> DataFrame:
    """by and factor: the cross-section's least-squares realisation of the factor on the loadings."""
    rows = panel.join(model.select(key, F.col(loading).alias("b")), key).where(F.col(y).isNotNull())
    return rows.groupBy(*by).agg((F.sum(F.col("b") * F.col(y)) / F.nullif(F.sum(F.col("b") * F.col("b")), F.lit(0.0))).alias("factor"))


def evaluated(panel: DataFrame, model: DataFrame, key: str, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """key, by, expected, gap and gap_sigma: what the model says, what came besides, and that in its usual spread."""
    told = model.select(key, "sigma", *[F.col(x).alias(f"b_{x}") for x in xs])
    expected = sum((F.col(x) * F.col(f"b_{x}") for x in xs[1:]), F.col(xs[0]) * F.col(f"b_{xs[0]}"))
    rows = panel.join(told, key).withColumn("expected", expected).withColumn("gap", F.col(y) - F.col("expected"))
    return rows.select(key, *by, "expected", "gap", (F.col("gap") / F.nullif("sigma", F.lit(0.0))).alias("gap_sigma"))


def lags_sql(lags: int, clip: float) -> str:
    """Over panel (session_date, slot, symbol, sector, r, market, a row for each symbol and slot): the market's and the sector peers' returns, now and up to `lags` slots before.

    Peers' returns are those of the sector without the symbol itself, less the market's, clipped; lags don't cross a session's start.
    """
    names = ", ".join(f"lag(market, {k}) over d as m_{k}, lag(peers, {k}) over d as s_{k}" for k in range(lags + 1))
    return f"""with f as (select p.*, least(greatest(r - market, {-clip}e0), {clip}e0) as e from {{panel}} p),
    s as (select f.*, case when sector is null then 0e0 else ((sum(e) over s) - coalesce(e, 0e0)) / nullif((count(e) over s) - case when e is null then 0 else 1 end, 0) end as peers from f window s as (partition by session_date, slot, sector))
    select session_date, slot, symbol, r, market, peers, {names} from s window d as (partition by session_date, symbol order by slot)"""


def factors(lags: int) -> list[str]:
    return [f"{side}_{k}" for side in "ms" for k in range(lags + 1)]


def walk_forward_responses(rows: DataFrame, lags: int, window: int, alpha: float, least_rows: int) -> DataFrame:
    """symbol, session_date, train_rows, a coefficient for each factor, and sigma, what is left: for each session by the `window` sessions before it.

    rows is what lags_sql gives. A symbol's session leaves its sums of products; these are added up over sessions entry by entry, and a system is
    solved for each symbol and session. The ridge is `alpha` times the mean of the diagonal.
    """
    xs = factors(lags)
    k = len(xs)
    upper = np.triu_indices(k + 2)
    keyed = rows.withColumn("key", F.concat_ws("|", "session_date", "symbol"))
    sums = daily_sums(keyed, "key", xs, "r").select(F.split("key", "[|]").alias("at"), "sums")
    sums = sums.select(F.get("at", F.lit(0)).cast("date").alias("session_date"), F.get("at", F.lit(1)).cast(dict(rows.dtypes)["symbol"]).alias("symbol"), "sums")
    every = rows.select("session_date").distinct().join(rows.select("symbol").distinct())
    entries = every.join(sums, ["session_date", "symbol"], "left").select("session_date", "symbol", F.posexplode(F.coalesce("sums", F.array_repeat(F.lit(0.0), len(upper[0])))).alias("entry", "value"))
    before = W.partitionBy("symbol", "entry").orderBy("session_date").rowsBetween(-window, -1)
    moved = entries.withColumn("value", F.coalesce(F.sum("value").over(before), F.lit(0.0)))
    whole = moved.groupBy("session_date", "symbol").agg(F.sort_array(F.collect_list(F.struct("entry", "value"))).alias("v")).select("session_date", "symbol", F.col("v.value").alias("v"))

    def solve(parts):
        for p in parts:
            m = np.zeros((len(p), k + 2, k + 2))
            if len(p):
                m[:, *upper] = np.stack(p.v.to_numpy())
            m = m + np.triu(m, 1).transpose(0, 2, 1)
            n, gram, right = np.round(m[:, 0, 0]), m[:, 1:-1, 1:-1], m[:, 1:-1, -1]
            penalty = np.maximum(alpha * np.trace(gram, axis1=1, axis2=2) / k, 1e-12)
            beta = np.linalg.solve(gram + penalty[:, None, None] * np.eye(k), right[..., None])[..., 0] if len(p) else right
            left = m[:, -1, -1] - 2 * (beta * right).sum(1) + np.einsum("ni,nij,nj->n", beta, gram, beta)
            sigma = np.sqrt(np.maximum(left, 0) / np.maximum(n - k, 1))
            out = pd.DataFrame({"session_date": p.session_date, "symbol": p.symbol, "train_rows": n.astype(np.int64), **{x: beta[:, i] for i, x in enumerate(xs)}, "sigma": sigma})
            yield out[out.train_rows >= least_rows]

    kinds = dict(rows.dtypes)
    return whole.mapInPandas(solve, f"session_date {kinds['session_date']}, symbol {kinds['symbol']}, train_rows long, {', '.join(f'{x} double' for x in xs)}, sigma double")


def evaluation_sql(lags: int, window: int) -> str:
    """Over lags (lags_sql) and fits (walk_forward_responses): what each symbol was expected to do in the last `window` slots, what it did, the gap, and what is still to come.

    What is to come are the lagged terms of the next slots, of moves that have been seen.
    """
    part = lambda side: " + ".join(f"f.{side}_{k} * coalesce(l.{side}_{k}, 0e0)" for k in range(lags + 1))
    pending = " + ".join(f"(f.m_{lag} * coalesce(l.m_{lag - h}, 0e0) + f.s_{lag} * coalesce(l.s_{lag - h}, 0e0))" for h in range(1, lags + 1) for lag in range(h, lags + 1))
    return f"""with e as (select l.session_date, l.slot, l.symbol, l.r, f.sigma, {part('m')} as market_part, {part('s')} as sector_part, {pending} as pending from {{lags}} l join {{fits}} f on f.symbol = l.symbol and f.session_date = l.session_date),
    w as (select session_date, slot, symbol, sigma, pending, r is null as stale, count(r) over w as observed, sum(r) over w as actual, sum(case when r is not null then market_part end) over w as market_part, sum(case when r is not null then sector_part end) over w as sector_part from e
      window w as (partition by session_date, symbol order by slot rows between {window - 1} preceding and current row))
    select session_date, slot, symbol, observed, stale, coalesce(actual, 0e0) as actual, coalesce(market_part + sector_part, 0e0) as expected, coalesce(market_part, 0e0) as market_part, coalesce(sector_part, 0e0) as sector_part, market_part + sector_part - actual as gap,
      (market_part + sector_part - actual) / nullif(sigma * sqrt(1e0 * observed), 0) as gap_sigma, pending, pending / nullif(sigma * sqrt({lags}e0), 0) as pending_sigma from w"""


def realisations_sql(lags: int, least: int) -> str:
    """Over lags and fits: the factor of each slot that the residuals show, by least squares on the symbols' whole answers to the market."""
    part = " + ".join(f"f.{x} * coalesce(l.{x}, 0e0)" for x in factors(lags))
    beta = " + ".join(f"f.m_{k}" for k in range(lags + 1))
    return f"""with e as (select l.session_date, l.slot, {beta} as beta, l.r - ({part}) as e from {{lags}} l join {{fits}} f on f.symbol = l.symbol and f.session_date = l.session_date where l.r is not null)
    select session_date, slot, count(*) as names, case when count(*) >= {least} then sum(beta * e) / nullif(sum(beta * beta), 0) end as factor from e group by session_date, slot"""
