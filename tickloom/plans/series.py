"""Queries of the full indicator series, over each symbol's whole history; DuckDB checks them with recursive queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.indicators import indicator_series
from tickloom.sources.market import duckdb_tables, market


def _series(spark: SparkSession, sf_dir: str, **names: str) -> DataFrame:
    bars = market(spark, sf_dir, ["bars"])["bars"]
    return indicator_series(bars, ["symbol"], ["session_date", "slot"], tuple(names)).select("symbol", "session_date", "slot", *[F.col(k).alias(v) for k, v in names.items()])


B = """b as (select symbol, session_date, slot, high, low, close, row_number() over w as i, lag(close) over w as pc, high - lag(high) over w as up, lag(low) over w - low as down from bars window w as (partition by symbol order by session_date, slot)),
  t as (select *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) as tr, case when up > down and up > 0 then up else 0.0 end as plus, case when down > up and down > 0 then down else 0.0 end as minus from b)"""


def _fold(name: str, source: str, x: str, p: int, weight: str, first: int = 1) -> str:
    """name(symbol, i, e): the recursion over x of source, from row number `first` on."""
    return f"""{name}(symbol, i, e) as (select symbol, cast({first + p - 1} as bigint), avg({x}) from {source} where i between {first} and {first + p - 1} group by symbol having count(*) = {p}
    union all select s.symbol, s.i, ({weight}) * s.{x} + (1 - {weight}) * {name}.e from {name} join {source} s on s.symbol = {name}.symbol and s.i = {name}.i + 1)"""


def _query(ctes: list[str], columns: str, joins: str) -> str:
    return f"with recursive {duckdb_tables(['bars'])}, {B}, {', '.join(ctes)} select t.symbol, t.session_date, t.slot, {columns} from t {joins}"


def _left(*names: str) -> str:
    return " ".join(f"left join {n} on {n}.symbol = t.symbol and {n}.i = t.i" for n in names)


def _ema(p: int) -> str:
    return f"2.0::double / {p + 1}"


def _rma(p: int) -> str:
    return f"1.0::double / {p}"


EMAS = _query([_fold("f", "t", "close", 9, _ema(9)), _fold("g", "t", "close", 20, _ema(20))], "round(f.e, 6) as ema_9, round(g.e, 6) as ema_20", _left("f", "g"))
MACD = _query(
    [_fold("f", "t", "close", 12, _ema(12)), _fold("g", "t", "close", 26, _ema(26)), "l as (select f.symbol, f.i, f.e - g.e as x from f join g on g.symbol = f.symbol and g.i = f.i)", _fold("m", "l", "x", 9, _ema(9), 26)],
    "round(l.x, 6) as macd_line, round(m.e, 6) as macd_signal, round(l.x - m.e, 6) as macd_histogram", _left("l", "m"),
)
ADX = _query(
    [
        *[_fold(n, "t", x, 14, _rma(14)) for n, x in (("a", "tr"), ("p", "plus"), ("m", "minus"))],
        "d as (select a.symbol, a.i, 100 * p.e / nullif(a.e, 0) as plus, 100 * m.e / nullif(a.e, 0) as minus from a join p on p.symbol = a.symbol and p.i = a.i join m on m.symbol = a.symbol and m.i = a.i)",
        "x as (select *, 100 * abs(plus - minus) / nullif(plus + minus, 0) as dx from d)", _fold("adx", "x", "dx", 14, _rma(14), 14),
    ],
    "round(adx.e, 6) as adx_14, round(x.plus, 6) as plus_di_14, round(x.minus, 6) as minus_di_14", _left("x", "adx"),
)
KELTNER = _query([_fold("f", "t", "close", 20, _ema(20)), _fold("a", "t", "tr", 10, _rma(10))], "round(f.e, 6) as keltner_middle, round(f.e + 2 * a.e, 6) as keltner_upper, round(f.e - 2 * a.e, 6) as keltner_lower", _left("f", "a"))
TREND = _query(
    [
        _fold("a", "t", "tr", 10, _rma(10)), "k as (select t.symbol, t.i, t.close, t.pc, (high + low) / 2 + 3 * a.e as u, (high + low) / 2 - 3 * a.e as l from t join a on a.symbol = t.symbol and a.i = t.i)",
        "v(symbol, i, u, l, way) as (select symbol, i, u, l, 1 from k where i = 10 union all select symbol, i, u, l, case when way = -1 then case when close > u then 1 else -1 end when close < l then -1 else 1 end "
        "from (select k.symbol, k.i, k.close, v.way, case when k.u < v.u or k.pc > v.u then k.u else v.u end as u, case when k.l > v.l or k.pc < v.l then k.l else v.l end as l from v join k on k.symbol = v.symbol and k.i = v.i + 1) n)",
    ],
    "round(case when v.way = 1 then v.l else v.u end, 6) as supertrend, cast(v.way as double) as supertrend_direction", _left("v"),
)
RMA = _query([_fold("f", "t", "close", 14, _rma(14))], "round(f.e, 6) as rma_14", _left("f"))
PLAIN = _query(
    [f"f(symbol, i, e) as (select symbol, i, close from t where i = 1 union all select s.symbol, s.i, f.e + ({_ema(20)}) * (s.close - f.e) from f join t s on s.symbol = f.symbol and s.i = f.i + 1)"], "round(f.e, 6) as ema_20", _left("f"),
)
ATR_RSI = _query(
    [
        _fold("a", "t", "tr", 14, _rma(14)), "c as (select symbol, i, greatest(close - pc, 0) as g, greatest(pc - close, 0) as n from t where i > 1)", _fold("g", "c", "g", 14, _rma(14), 2), _fold("n", "c", "n", 14, _rma(14), 2),
    ],
    "round(a.e, 6) as atr_14, round(100 * a.e / nullif(t.close, 0), 6) as natr_14, round(case when n.e = 0 and g.e = 0 then 50 when n.e = 0 then 100 else 100 - 100 / (1 + g.e / n.e) end, 6) as rsi_14", _left("a", "g", "n"),
)


ATR = _query([_fold("a", "t", "tr", 14, _rma(14))], "round(a.e, 6) as atr_14, round(100 * a.e / nullif(t.close, 0), 6) as natr_14", _left("a"))
RSI = _query(
    ["c as (select symbol, i, greatest(close - pc, 0) as g, greatest(pc - close, 0) as n from t where i > 1)", _fold("g", "c", "g", 14, _rma(14), 2), _fold("n", "c", "n", 14, _rma(14), 2)],
    "round(case when n.e = 0 and g.e = 0 then 50 when n.e = 0 then 100 else 100 - 100 / (1 + g.e / n.e) end, 6) as rsi_14", _left("g", "n"),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "ind_02": lambda s, d: _series(s, d, ema_fast="ema_9", ema_slow="ema_20"),
        "ind_03": lambda s, d: _series(s, d, rma="rma_14"),
        "ind_05": lambda s, d: _series(s, d, atr="atr_14", natr="natr_14"),
        "ind_06": lambda s, d: _series(s, d, rsi="rsi_14"),
        "ind_07": lambda s, d: _series(s, d, macd_line="macd_line", macd_signal="macd_signal", macd_histogram="macd_histogram"),
        "ind_15": lambda s, d: _series(s, d, adx="adx_14", plus_di="plus_di_14", minus_di="minus_di_14"),
        "ind_21": lambda s, d: _series(s, d, keltner_middle="keltner_middle", keltner_upper="keltner_upper", keltner_lower="keltner_lower"),
        "ind_22": lambda s, d: _series(s, d, supertrend="supertrend", supertrend_direction="supertrend_direction"),
        "ind_26": lambda s, d: _series(s, d, atr="atr_14", natr="natr_14", rsi="rsi_14"),
        "ind_28": lambda s, d: _series(s, d, ema_plain="ema_20"),
    }


def oracle_sql() -> dict[str, str]:
    return {"ind_02": EMAS, "ind_05": ATR, "ind_06": RSI, "ind_03": RMA, "ind_07": MACD, "ind_15": ADX, "ind_21": KELTNER, "ind_22": TREND, "ind_26": ATR_RSI, "ind_28": PLAIN}
