"""Queries of the daily selector over the stand-in desk: outcomes, fits, choice, decision, records and reconstruction.

DuckDB checks them with the same texts where they are relational, and with systems solved and likelihoods climbed by recursive queries
where Spark solves them in numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import selector as s
from tickloom.functions.reconstruction import day_keys, reconstructed
from tickloom.operators.matrix import COLUMNS, DECISION, HOURS, matrix_sql, over_desk
from tickloom.plans.dialect import Operator
from tickloom.sources.market import duckdb_tables, market
from tickloom.sources.shared import fresh_path, kept

#: The stand-in has a month of days and a dozen stocks.
RULES = s.Rules(completeness=0.5, age=3, price=1.0, turnover=0.001, window=15, least_days=8, least_rows=40, history=20, compare_days=5, calibration_days=6, first_picks=10, most_error=0.2, least_ic=4)
HORIZONS, PRIMARY, WITHIN = (3, 6, 12), 6, 3
T = [f"t_{x}" for x in s.FEATURES]
P = [f"p_{x}" for x in s.FEATURES]


@dataclass
class Selection:
    """The steps' tables, each made when it is asked for; those read more than once are kept."""

    bars: DataFrame
    universe: DataFrame
    index_bars: DataFrame
    facts: DataFrame
    rules: s.Rules
    decision: int

    def matrix(self) -> DataFrame:
        return Operator("matrix", matrix_sql(HOURS, self.decision))(bars=self.bars, universe=self.universe, index_bars=self.index_bars, facts=self.facts)

    def outcomes(self) -> DataFrame:
        return Operator("outcomes", s.outcomes_sql(self.decision, HORIZONS, WITHIN))(bars=self.bars)

    def rows(self) -> DataFrame:
        return kept(Operator("rows", s.rows_sql(self.rules, self.decision))(matrix=self.matrix(), outcomes=self.outcomes().where(F.col("horizon") == PRIMARY)), "rows")

    def scored(self) -> DataFrame:
        return kept(scored_rows(self.rows(), self.rules), "scored")


def scored_rows(rows: DataFrame, rules: s.Rules) -> DataFrame:
    """rows with the prediction of the model that the sessions before each session's give."""
    learn = rows.where("eligible and target is not null")
    sums = s.daily_sums(learn, "session_date", T, "target")
    fits = s.walk_forward(sums, rows.select("session_date").distinct(), "session_date", len(T) + 2, rules.window, rules.least_days, rules.least_rows, rules.alpha)
    return s.predicted(rows, fits, "session_date", P)


def choice(scored: DataFrame, rules: s.Rules) -> DataFrame:
    picks = Operator("picks", s.picks_sql(rules))(scored=scored)
    return Operator("choice", s.choice_sql(rules))(picks=picks)


def decided(scored: DataFrame, rules: s.Rules) -> DataFrame:
    """One decision for each session, from the rows of all."""
    days = scored.select("session_date").distinct()
    return Operator("decisions", s.decisions_sql(rules))(scored=scored, choice=kept(choice(scored, rules), "choice"), calibration=kept(s.calibrations(scored, days, rules), "calibration"))


def over(spark: SparkSession, sf_dir: str) -> Selection:
    t = market(spark, sf_dir, ["desk_bars", "desk_universe", "desk_index_bars", "desk_facts"])
    return Selection(kept(t["desk_bars"], "bars"), t["desk_universe"], kept(t["desk_index_bars"], "index"), kept(t["desk_facts"], "facts"), RULES, DECISION)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def eng_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample predictions of every eligible stock, by a ridge on the sessions before."""
    out = over(spark, sf_dir).scored().where("eligible").select("session_date", "symbol", "tier", "train_days", "train_rows", "signed_v1", "prediction", "forward")
    return _rounded(out)


def eng_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which score decides each session, and the second one's calibration."""
    scored = over(spark, sf_dir).scored()
    fits = s.calibrations(scored, scored.select("session_date").distinct(), RULES)
    out = choice(scored, RULES).join(fits, "session_date", "left")
    return _rounded(out.select("session_date", "model", "common_days", "net_v1", "net_v2", "ic_days", "ic_mean", "ic_t", "picks_v1", "hits_v1", "picks_v2", "hits_v2", "oos_days", "points", "scale", "a", "b", "ece"), 5)


def eng_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(decided(over(spark, sf_dir).scored(), RULES), 5)


def eng_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(over(spark, sf_dir).outcomes())


def eng_45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later session may learn from: the matrix, whether the symbol was eligible, and the outcomes at every horizon."""
    x = over(spark, sf_dir)
    rows = x.rows().select("session_date", "symbol", "tier", "eligible")
    later = x.outcomes().groupBy("session_date", "symbol").agg(*[F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}_{h}") for h in HORIZONS for c in ("forward", "mfe", "mae")])
    out = rows.join(x.matrix().select("session_date", "symbol", *COLUMNS), ["session_date", "symbol"]).join(later, ["session_date", "symbol"], "left")
    return _rounded(out.select(*[F.col(c).cast("double").alias(c) if c in COLUMNS else c for c in out.columns]))


def reconstruct(x: Selection, root: str) -> DataFrame:
    """Every session's decision with its outcome, made for the sessions whose inputs have changed since the last run over root."""
    spark, r = x.bars.sparkSession, x.rules
    keys = day_keys([x.bars, x.facts, x.index_bars], HOURS.lookback + r.window + r.history)

    def rows_of(first: str, days: list[str]) -> DataFrame:
        seen = lambda t: t.where((F.col("session_date") >= F.lit(first)) & (F.col("session_date") <= F.lit(days[-1])))
        part = Selection(seen(x.bars), x.universe, seen(x.index_bars), seen(x.facts), r, x.decision)
        # Facts of a session may look back; the matrix's own look back is that of its norms.
        outcomes = part.outcomes().where(F.col("horizon") == PRIMARY)
        return Operator("rows", s.rows_sql(r, x.decision))(matrix=part.matrix(), outcomes=outcomes)

    def sums_of(rows: DataFrame) -> DataFrame:
        sums = s.daily_sums(rows.where("eligible and target is not null"), "session_date", T, "target")
        return rows.select("session_date").distinct().join(sums, "session_date", "left")

    def scored_of(rows: DataFrame, sums: DataFrame) -> DataFrame:
        fits = s.walk_forward(sums, sums.select("session_date"), "session_date", len(T) + 2, r.window, r.least_days, r.least_rows, r.alpha)
        return s.predicted(rows, fits, "session_date", P)

    def decided_of(scored: DataFrame) -> DataFrame:
        picked = decided(scored, r)
        real = scored.select("session_date", "symbol", "forward", "mfe", "mae")
        up = F.col("direction") == "UP"
        out = picked.join(real, ["session_date", "symbol"], "left")
        return out.withColumns({
            "return_pct": 100 * F.when(up, F.col("forward")).otherwise(-F.col("forward")), "net_return_pct": 100 * (F.when(up, F.col("forward")).otherwise(-F.col("forward")) - r.cost),
            "real_mfe_pct": 100 * F.when(up, F.col("mfe")).otherwise(-F.col("mae")), "real_mae_pct": 100 * F.when(up, F.col("mae")).otherwise(-F.col("mfe")),
        }).drop("forward", "mfe", "mae")

    return reconstructed(spark, root, keys, HOURS.lookback, r.window + r.history, rows_of, sums_of, scored_of, decided_of)


def eng_46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions reconstructed in two runs, the second over all that the first left to do."""
    x, root = over(spark, sf_dir), fresh_path(spark, "reconstruction")
    half = x.bars.agg(F.date_add(F.min("session_date"), F.floor(F.date_diff(F.max("session_date"), F.min("session_date")) / 2).cast("int"))).head()[0]
    early = lambda t: t.where(F.col("session_date") <= F.lit(half))
    reconstruct(Selection(early(x.bars), x.universe, early(x.index_bars), early(x.facts), x.rules, x.decision), root)
    return _rounded(reconstruct(x, root).drop("_by"), 5)


def _steps(*wanted: str) -> str:
    """DuckDB's tables of the steps, down to the last of wanted."""
    r, n = RULES, len(T) + 1
    primary = f"select * from outcomes where horizon = {PRIMARY}"

    def duck(sql: str, **names: str) -> str:
        out = Operator("", sql).in_duckdb()
        for old, new in names.items():
            out = out.replace(f" {old} ", f" {new} ")
        return out

    terms = ", ".join(f"({k}, {c})" for k, c in enumerate(["1e0", *T, "target"]))
    tables = {
        "matrix": Operator("", over_desk(matrix_sql(HOURS, DECISION))).in_duckdb(),
        "outcomes": duck(s.outcomes_sql(DECISION, HORIZONS, WITHIN), bars="desk_bars"),
        "primary_": primary,
        "rows_": duck(s.rows_sql(r, DECISION), outcomes="primary_"),
        "terms": f"select session_date, symbol, unnest(range({n + 1})) as k, unnest([1e0, {', '.join(T)}, target]) as v from rows_ where eligible and target is not null",
        "sums": "select a.session_date, a.k as i, b.k as j, sum(a.v * b.v) as v from terms a join terms b on a.session_date = b.session_date and a.symbol = b.symbol group by all",
        "day_numbers": "select session_date, row_number() over (order by session_date) as number from (select distinct session_date from rows_)",
        "systems": f"""select d.session_date, s.i, s.j, sum(s.v) + case when s.i = s.j and s.i between 1 and {n - 1} then {r.alpha}e0 else 0e0 end as v
          from day_numbers d join day_numbers e on e.number between d.number - {r.window} and d.number - 1 join sums s on s.session_date = e.session_date group by d.session_date, s.i, s.j""",
        "sizes": f"select d.session_date, count(distinct e.number) as train_days, cast(coalesce(sum(s.v), 0) as bigint) as train_rows from day_numbers d left join day_numbers e on e.number between d.number - {r.window} and d.number - 1 left join sums s on s.session_date = e.session_date and s.i = 0 and s.j = 0 group by d.session_date",
        "elimination": f"""select session_date, -1 as step, i, j, v from systems where i < {n} and session_date in (select session_date from sizes where train_days >= {r.least_days} and train_rows >= {r.least_rows})
          union all select a.session_date, a.step + 1, a.i, a.j, case when a.i = a.step + 1 then a.v / p.v else a.v - c.v * b.v / p.v end
          from elimination a join elimination p on p.session_date = a.session_date and p.i = a.step + 1 and p.j = a.step + 1 join elimination b on b.session_date = a.session_date and b.i = a.step + 1 and b.j = a.j
          join elimination c on c.session_date = a.session_date and c.i = a.i and c.j = a.step + 1 where a.step < {n - 1}""",
        "coefs": f"select session_date, i, v from elimination where step = {n - 1} and j = {n}",
        "scored": f"""select r.*, z.train_days, z.train_rows, q.prediction from rows_ r left join sizes z on z.session_date = r.session_date
          left join (select t.session_date, t.symbol, sum(t.v * c.v) as prediction from (select session_date, symbol, unnest(range({n})) as k, unnest([1e0, {', '.join(P)}]) as v from rows_) t join coefs c on c.session_date = t.session_date and c.i = t.k group by all) q on q.session_date = r.session_date and q.symbol = r.symbol""",
        "picks": duck(s.picks_sql(r)),
        "choice": duck(s.choice_sql(r)),
        "later": f"select d.session_date, e.number, s.prediction, s.forward from scored s join day_numbers e on e.session_date = s.session_date join day_numbers d on e.number between d.number - {r.history} and d.number - 1 where eligible and forward is not null and prediction is not null",
        "scales": "select session_date, count(distinct number) as oos_days, count(case when forward <> 0 then 1 end) as points, coalesce(nullif(stddev_pop(case when forward <> 0 then prediction end), 0), 1) as scale from later group by session_date",
        "hits": "select l.session_date, list(abs(prediction) / scale order by number, prediction, forward) as x, list(case when sign(prediction) = sign(forward) then 1e0 else 0e0 end order by number, prediction, forward) as y from later l join scales c on c.session_date = l.session_date where forward <> 0 group by l.session_date",
        "climb": """select session_date, 0 as step, 0e0 as a, 0e0 as b, x, y from hits
          union all select session_date, step + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12), x, y from (
            select *, list_sum(list_transform(list_zip(y, p), lambda q: q[1] - q[2])) - 1e-6 * a as g1, list_sum(list_transform(list_zip(y, p, x), lambda q: (q[1] - q[2]) * q[3])) - 1e-6 * b as g2,
              list_sum(list_transform(p, lambda q: q * (1 - q))) + 1e-6 as h11, list_sum(list_transform(list_zip(p, x), lambda q: q[1] * (1 - q[1]) * q[2])) as h12, list_sum(list_transform(list_zip(p, x), lambda q: q[1] * (1 - q[1]) * q[2] * q[2])) + 1e-6 as h22
            from (select *, list_transform(x, lambda v: 1 / (1 + exp(-greatest(least(a + b * v, 30), -30)))) as p from climb where step < 30))""",
        "chances": "select session_date, a, b, unnest(list_transform(x, lambda v: round(1 / (1 + exp(-(a + b * v))), 9))) as p, unnest(y) as y from climb where step = 30",
        "bins": "select session_date, unnest(range(10)) as k, list_transform(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda e: round(e, 9)) as edges, count(*) as n from chances group by session_date",
        "errors": "select b.session_date, b.k, count(c.p) / max(1e0 * n) * abs(avg(c.y) - avg(c.p)) as e from bins b join chances c on c.session_date = b.session_date and c.p >= b.edges[k + 1] and c.p <= b.edges[k + 2] group by b.session_date, b.k",
        "calibration": "select s.session_date, oos_days, points, scale, coalesce(m.a, 0) as a, coalesce(m.b, 0) as b, coalesce(x.ece, 0) as ece from scales s left join climb m on m.session_date = s.session_date and m.step = 30 left join (select session_date, sum(e) as ece from errors group by session_date) x on x.session_date = s.session_date",
        "decisions": duck(s.decisions_sql(r)),
    }
    names = list(tables)
    upto = max(names.index(x) for x in wanted) + 1
    del terms
    return f"with recursive {duckdb_tables(['desk_bars', 'desk_universe', 'desk_index_bars', 'desk_facts'])}, " + ", ".join(f"{x} as ({tables[x]})" for x in names[:upto])


def _columns(names: str, digits: int, kept_: str = "") -> str:
    return ", ".join([*(x for x in kept_.split() if x), *(f"round({x}, {digits}) + 0e0 as {x}" for x in names.split())])


def oracle_sql() -> dict[str, str]:
    outcomes = _columns("entry exit forward mfe mae", 6, "symbol session_date horizon t_mfe t_mae")
    later = ", ".join(f"round(max(case when horizon = {h} then {c} end), 6) + 0e0 as {c}_{h}" for h in HORIZONS for c in ("forward", "mfe", "mae"))
    decisions = _columns(
        "selection_score net_v1_bps net_v2_bps ic_mean ic_t hit_rate hit_low hit_high probability expected_return_pct oos_mean_return_pct oos_mean_net_pct oos_sd_pct mfe_pct mae_pct", 5,
        "session_date symbol sector tier model direction universe n_eligible train_days runners_up common_days oos_picks status quality",
    )
    return {
        "eng_21": f"{_steps('scored')} select {_columns('signed_v1 prediction forward', 6, 'session_date symbol tier train_days train_rows')} from scored where eligible",
        "eng_22": f"{_steps('calibration')} select h.session_date, model, common_days, {_columns('net_v1 net_v2 ic_mean ic_t scale a b ece', 5)}, ic_days, picks_v1, hits_v1, picks_v2, hits_v2, oos_days, points from choice h left join calibration c on c.session_date = h.session_date",
        "eng_23": f"{_steps('decisions')} select {decisions} from decisions",
        "eng_46": f"""{_steps('decisions')} select {decisions},
          round(100 * sg * forward, 5) + 0e0 as return_pct, round(100 * (sg * forward - {RULES.cost}), 5) + 0e0 as net_return_pct, round(100 * case when sg > 0 then mfe else -mae end, 5) + 0e0 as real_mfe_pct, round(100 * case when sg > 0 then mae else -mfe end, 5) + 0e0 as real_mae_pct
          from (select d.*, case when direction = 'UP' then 1 else -1 end as sg from decisions d) d left join (select session_date as sd, symbol as sy, forward, mfe, mae from rows_) r on r.sd = d.session_date and r.sy = d.symbol""",
        "eng_24": f"{_steps('outcomes')} select {outcomes} from outcomes",
        "eng_45": f"""{_steps('rows_')}, l as (select session_date as d, symbol as y, {later} from outcomes group by session_date, symbol)
          select r.session_date, r.symbol, r.tier, r.eligible, {', '.join(f'round(cast(m.{c} as double), 6) + 0e0 as {c}' for c in COLUMNS)}, l.* exclude (d, y) from rows_ r join matrix m on m.session_date = r.session_date and m.symbol = r.symbol left join l on l.d = r.session_date and l.y = r.symbol""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"eng_21": eng_21, "eng_22": eng_22, "eng_23": eng_23, "eng_24": eng_24, "eng_45": eng_45, "eng_46": eng_46}
