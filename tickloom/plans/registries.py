"""Queries of the registries and of what is built from them, with SQL written apart from their columns."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import registry as r
from tickloom.functions.indicators import indicator_series
from tickloom.plans.series import _ema, _fold, _left, _query
from tickloom.sources import archive as a
from tickloom.sources.market import duckdb_tables, market


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(spark, sf_dir, ["bars"])["bars"]


F_SQL = """f as (select symbol, session_date, slot, open, high, low, close, volume,
    case when close > 0 and lag(close) over d > 0 then ln(close / lag(close) over d) end as ret_1, case when close > 0 and lag(close, 3) over d > 0 then ln(close / lag(close, 3) over d) end as ret_3,
    case when close > 0 and lag(close, 5) over d > 0 then ln(close / lag(close, 5) over d) end as ret_5, case when lag(close, 5) over d > 0 and lag(close, 10) over d > 0 then ln(lag(close, 5) over d / lag(close, 10) over d) end as ret_5_before,
    case when close > 0 and first_value(open) over s > 0 then ln(close / first_value(open) over s) end as ret_open, min(low) over s as day_low, max(high) over s as day_high, first_value(open) over s as day_open,
    sum(volume) over w5 as v5, sum(volume) over p5 as v5_before, cast(sum(volume) over s as bigint) as volume_so_far, sum(close * volume) over s as paid, case when count(close) over w5 = 5 then avg(close) over w5 end as mean_5,
    avg(case when close > open then 1.0 else 0.0 end) over w5 as up_share_5, max(high) over p3 as top_3, cast(slot - lag(slot) over d as double) as gap_bars, cast(count(close) over s as double) as bars from bars
    window d as (partition by symbol, session_date order by slot), s as (partition by symbol, session_date order by slot rows between unbounded preceding and current row), w5 as (partition by symbol, session_date order by slot rows between 4 preceding and current row),
      p5 as (partition by symbol, session_date order by slot rows between 9 preceding and 5 preceding), p3 as (partition by symbol, session_date order by slot rows between 3 preceding and 1 preceding)),
  v as (select *, case when count(ret_1) over w = 5 then stddev_pop(ret_1) over w end as volatility_5 from f window w as (partition by symbol, session_date order by slot rows between 4 preceding and current row)),
  x as (select symbol, session_date, slot, round(ret_1, 6) + 0.0 as ret_1, round(ret_3, 6) + 0.0 as ret_3, round(ret_5, 6) + 0.0 as ret_5, round(ret_open, 6) + 0.0 as ret_open, round(ret_5 - ret_5_before, 6) + 0.0 as acceleration, round((close - day_low) / nullif(day_high - day_low, 0), 6) as range_place,
    round(100 * (day_high - day_low) / nullif(day_open, 0), 6) as range_pct, round(high - low, 6) as bar_range, round(close - open, 6) + 0.0 as body, round(volatility_5, 6) as volatility_5, round(v5 / nullif(v5_before, 0), 6) as volume_ratio, volume_so_far,
    round(close / nullif(paid / nullif(volume_so_far, 0), 0) - 1, 6) + 0.0 as vwap_gap, round(close / nullif(mean_5, 0) - 1, 6) + 0.0 as mean_gap_5, round(close / nullif(day_high, 0) - 1, 6) + 0.0 as high_gap, round(close / nullif(day_low, 0) - 1, 6) + 0.0 as low_gap, round(up_share_5, 6) as up_share_5,
    cast(close > top_3 as double) as breakout, gap_bars, bars from v)"""
UDF_01 = f"with {duckdb_tables(['bars'])}, {F_SQL} select * from x"
UDF_02 = f"""with {duckdb_tables(['bars'])}, {F_SQL}, m as (select symbol, session_date, slot, 'return' as measure, ret_open as x from x union all select symbol, session_date, slot, 'volume', ln(1 + volume_so_far::double) from x union all select symbol, session_date, slot, 'range', ln(1 + range_pct) from x)
  select symbol, session_date, slot, measure, case when count(x) over w >= 10 then round((x - avg(x) over w) / nullif(stddev_pop(x) over w, 0), 4) + 0.0 end as z from m window w as (partition by symbol, slot, measure order by session_date rows between unbounded preceding and 1 preceding)"""
UDF_03 = f"""with {duckdb_tables(['bars'])}, {F_SQL} select symbol, session_date, slot, 'momentum' as signal from x where ret_5 > 0 and breakout = 1 union all select symbol, session_date, slot, 'reversal' from x where ret_5 < 0 and range_place < 0.2
  union all select symbol, session_date, slot, 'surge' from x where volume_ratio > 1.5"""
UDF_06 = _query([_fold("f", "t", "close", 5, _ema(5))], "round(f.e, 6) as ema_5", _left("f"))
ENG_35 = f"""with recursive {duckdb_tables(['daily'])}, v as (select symbol, high as price, date_diff('day', date '1970-01-01', session_date) as place, row_number() over (partition by symbol order by high, session_date) as i from daily),
  c(symbol, i, k, total, n, last_) as (select symbol, i, 1, price, 1::bigint, place::bigint from v where i = 1 union all
    select v.symbol, v.i, case when abs(v.price - c.total / c.n) <= c.total / c.n * 0.5 / 100 then c.k else c.k + 1 end, case when abs(v.price - c.total / c.n) <= c.total / c.n * 0.5 / 100 then c.total + v.price else v.price end,
      case when abs(v.price - c.total / c.n) <= c.total / c.n * 0.5 / 100 then c.n + 1 else 1 end, case when abs(v.price - c.total / c.n) <= c.total / c.n * 0.5 / 100 then greatest(c.last_, v.place) else v.place end
    from c join v on v.symbol = c.symbol and v.i = c.i + 1)
  select symbol, round(arg_max(total, i) / max(n), 6) as price, max(n) as n, arg_max(last_, i) as last from c group by symbol, k"""
SRC_16 = """select p_partkey as k, cast(p_partkey as varchar) as security_id, case when p_partkey % 2 = 0 then 'bid' else 'ask' end as side, cast(j + 1 as int) as level, p_retailprice + j * 0.25 as price, cast(p_size * j as bigint) as quantity, cast(j + 1 as bigint) as orders
  from part cross join (select unnest(range(20)) as j) x where p_partkey % 5 != 0"""
FN_31 = "select event_id, case when event_id % 3 != 0 then cast(floor(epoch(ts)) as bigint) end as epoch from events"


def src_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are packed here byte by byte; every fifth one is cut short."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            frames = []
            for k, size, price in zip(p.k.tolist(), p.p_size.tolist(), p.p_retailprice.tolist(), strict=True):
                body = b"".join(struct.pack("<dII", price + j * 0.25, size * j, j + 1) for j in range(20))
                frame = struct.pack("<HBBii", 12 + len(body), 41 if k % 2 == 0 else 51, 1, k, 0) + body
                frames.append(frame[:100] if k % 5 == 0 else frame)
            yield pd.DataFrame({"k": p.k, "frame": frames})

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    return a.depth_frames(parts.mapInPandas(pack, "k bigint, frame binary"), "k")


def fn_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, "some day").otherwise(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss +0000"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_seconds(a.rfc_822(said)).alias("epoch"))


def eng_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = market(spark, sf_dir, ["daily"])["daily"].withColumn("place", F.unix_date("session_date"))
    return r.clusters(d, "symbol", "place", "high", 0.5)


def udf_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same indicator over what any source gives: here bars and days, each a function of the session and the folder."""
    sources = {"bars": lambda: _bars(spark, sf_dir).select("symbol", "session_date", "slot", "high", "low", "close"), "days": lambda: market(spark, sf_dir, ["daily"])["daily"].select(F.col("symbol").cast("string").alias("symbol"), "session_date", F.lit(0).alias("slot"), "high", "low", "close")}
    out = [indicator_series(make(), ["symbol"], ["session_date", "slot"], ("true_range",)).withColumn("source", F.lit(name)) for name, make in sources.items()]
    return out[0].unionByName(out[1])


UDF_05 = f"""with {duckdb_tables(['bars', 'daily'])}, u as (select 'bars' as source, symbol, session_date, slot, high, low, close from bars union all select 'days', cast(symbol as varchar), session_date, 0, high, low, close from daily),
  l as (select *, lag(close) over (partition by source, symbol order by session_date, slot) as pc from u) select source, symbol, session_date, slot, round(greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)), 6) as true_range from l"""


def udf_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observer of the feed: what it makes of every batch is kept."""
    from tickloom.streaming import replay, ticks

    return replay.followed(ticks.tick_stream(spark, sf_dir), lambda batch: batch.groupBy("symbol").agg(F.count("*").alias("packets"), F.max("ts").alias("last_seen"))).groupBy("symbol").agg(F.sum("packets").alias("packets"), F.max("last_seen").cast("timestamp_ntz").alias("last_seen"))


SQL = {
    "src_16": SRC_16, "fn_31": FN_31, "udf_01": UDF_01, "eng_01": UDF_01, "udf_02": UDF_02, "udf_03": UDF_03, "udf_06": UDF_06, "eng_35": ENG_35, "udf_05": UDF_05, "udf_08": SRC_16, "udf_07": ENG_35,
    "udf_04": "select event_type as symbol, count(*) as packets, max(ts) as last_seen from events group by event_type",
}


def _all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.features(_bars(spark, sf_dir))
    parts = [r.scored(rows, m) for m in r.MEASURES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "src_16": src_16, "fn_31": fn_31, "eng_35": eng_35, "udf_04": udf_04, "udf_05": udf_05, "udf_07": eng_35, "udf_08": src_16,
        "udf_01": lambda s, d: r.features(_bars(s, d)), "eng_01": lambda s, d: r.features(_bars(s, d)), "udf_02": _all_scores,
        "udf_03": lambda s, d: r.signalled(r.features(_bars(s, d))),
        "udf_06": lambda s, d: indicator_series(_bars(s, d), ["symbol"], ["session_date", "slot"], ("ema_fast",), ema_fast=5).withColumnRenamed("ema_fast", "ema_5"),
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
