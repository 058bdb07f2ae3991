"""Queries of the response model over the stand-in desk, every session judged by a model of the sessions before it; DuckDB solves the systems by elimination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import response as r
from tickloom.plans.dialect import Operator
from tickloom.plans.market_states import PANEL
from tickloom.sources.market import duckdb_tables, market
from tickloom.sources.shared import kept

LAGS, TRAIN, ALPHA, LEAST, WINDOW, CLIP = 2, 10, 0.05, 30, 4, 2.0
XS = r.factors(LAGS)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    panel = Operator("panel", PANEL)(**market(spark, sf_dir, ["desk_universe", "desk_bars"]))
    lags = kept(Operator("lags", r.lags_sql(LAGS, CLIP))(panel=panel), "lags")
    return {"lags": lags, "fits": kept(r.walk_forward_responses(lags, LAGS, TRAIN, ALPHA, LEAST), "fits")}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 5) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def eng_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_tables(spark, sf_dir)["fits"])


def eng_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Operator("realised", r.realisations_sql(LAGS, 3))(**_tables(spark, sf_dir)))


def eng_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Operator("evaluated", r.evaluation_sql(LAGS, WINDOW))(**_tables(spark, sf_dir)))


K = len(XS)
FITS = f"""{duckdb_tables(['desk_universe', 'desk_bars'])}, panel as ({Operator('', PANEL).in_duckdb()}), lags as ({Operator('', r.lags_sql(LAGS, CLIP)).in_duckdb()}),
  terms as (select session_date, symbol, slot, unnest(range({K + 1})) as k, unnest([{', '.join(XS)}, r]) as v from lags where r is not null and {' and '.join(f'{x} is not null' for x in XS)}),
  sums as (select a.session_date, a.symbol, a.k as i, b.k as j, sum(a.v * b.v) as v, count(*) as n from terms a join terms b on a.session_date = b.session_date and a.symbol = b.symbol and a.slot = b.slot group by all),
  numbers as (select session_date, row_number() over (order by session_date) as number from (select distinct session_date from lags) x),
  grams as (select d.session_date, s.symbol, s.i, s.j, sum(s.v) as v, sum(s.n) as n from numbers d join numbers e on e.number between d.number - {TRAIN} and d.number - 1 join sums s on s.session_date = e.session_date group by d.session_date, s.symbol, s.i, s.j having sum(s.n) >= {LEAST}),
  penalties as (select session_date, symbol, greatest({ALPHA}e0 * sum(v) / {K}, 1e-12) as penalty from grams where i = j and i < {K} group by session_date, symbol),
  elimination as (select g.session_date, g.symbol, -1 as step, i, j, v + case when i = j then penalty else 0e0 end as v from grams g join penalties p on p.session_date = g.session_date and p.symbol = g.symbol where i < {K}
    union all select a.session_date, a.symbol, a.step + 1, a.i, a.j, case when a.i = a.step + 1 then a.v / p.v else a.v - c.v * b.v / p.v end from elimination a
    join elimination p on p.session_date = a.session_date and p.symbol = a.symbol and p.i = a.step + 1 and p.j = a.step + 1 join elimination b on b.session_date = a.session_date and b.symbol = a.symbol and b.i = a.step + 1 and b.j = a.j
    join elimination c on c.session_date = a.session_date and c.symbol = a.symbol and c.i = a.i and c.j = a.step + 1 where a.step < {K - 1}),
  betas as (select session_date, symbol, i, v as b from elimination where step = {K - 1} and j = {K}),
  squares as (select g.session_date, g.symbol, max(n) as n, sum(case when g.i = {K} and g.j = {K} then g.v when g.j = {K} then -2 * x.b * g.v when g.i < {K} then x.b * y.b * g.v end) as left_ from grams g
    left join betas x on x.session_date = g.session_date and x.symbol = g.symbol and x.i = g.i left join betas y on y.session_date = g.session_date and y.symbol = g.symbol and y.i = g.j group by g.session_date, g.symbol),
  fits as (select b.session_date, b.symbol, cast(max(s.n) as bigint) as train_rows, {', '.join(f'max(case when i = {i} then b end) as {x}' for i, x in enumerate(XS))}, sqrt(greatest(max(left_), 0e0) / greatest(max(s.n) - {K}, 1)) as sigma
    from betas b join squares s on s.session_date = b.session_date and s.symbol = b.symbol group by b.session_date, b.symbol)"""


def _said(kept_: str, numbers: list[str]) -> str:
    return ", ".join([kept_, *(f"round({c}, 5) + 0e0 as {c}" for c in numbers)])


def oracle_sql() -> dict[str, str]:
    moves = ["actual", "expected", "market_part", "sector_part", "gap", "gap_sigma", "pending", "pending_sigma"]
    return {
        "eng_11": f"with recursive {FITS} select {_said('session_date, symbol, train_rows', [*XS, 'sigma'])} from fits",
        "eng_12": f"with recursive {FITS} select {_said('session_date, slot, names', ['factor'])} from ({Operator('', r.realisations_sql(LAGS, 3)).in_duckdb()}) x",
        "eng_13": f"with recursive {FITS} select {_said('session_date, slot, symbol, observed, stale', moves)} from ({Operator('', r.evaluation_sql(LAGS, WINDOW)).in_duckdb()}) x",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"eng_11": eng_11, "eng_12": eng_12, "eng_13": eng_13}
