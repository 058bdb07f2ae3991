"""Streaming queries, replayed over the stand-in ticks; an hour stands for a minute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.sources.market import duckdb_tables, market
from tickloom.streaming import keyed, replay, state
from tickloom.streaming import ticks as t

#: What the watermark has passed when all ticks are read.
UPTO = "(select max(ts) - interval 3 second from events)"
BARS = f"""select event_type as symbol, date_trunc('hour', ts) as bar_start, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close,
    cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as volume, count(*) as n from events where date_trunc('hour', ts) + interval 1 hour <= {UPTO} group by 1, 2"""


OPENS = 2 * 3600


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as packets with totals of the day's volume; some are late, repeat a total, fall behind or have none."""
    e = spark.readStream.schema(spark.read.option("pathGlobFilter", "events.parquet").parquet(sf_dir).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    seconds, k = F.unix_timestamp("ts"), F.get_json_object("props", "$.k").cast("long")
    late = F.when(F.col("event_id") % 11 == 0, 7200).otherwise(0)
    whole = F.floor(seconds % 86400 / 600).cast("long") * 10
    total = F.when(F.col("event_id") % 17 == 0, 0).when(F.col("event_id") % 13 == 0, whole - 5).otherwise(whole)
    return e.select(
        F.col("event_type").alias("symbol"), F.to_date("ts").alias("session_date"), "event_id", F.col("ts").cast("timestamp").alias("received"),
        (F.floor((seconds - late) / 600) * 600).alias("traded"), total.cast("long").alias("total"), (k % 3).alias("size"), F.floor(F.col("value") / 100).cast("double").alias("price"),
    )


def _verdicts(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    out = replay.replayed(state.judged_stream(_packets(spark, sf_dir), 3600, OPENS))
    return out.where(F.col("verdict").isin(*names)).select("symbol", "session_date", "event_id", "verdict", "delta")


def _verdict_sql(*names: str) -> str:
    """The same by a recursive query: every tick leads from one state to the next."""
    listed = ", ".join(f"'{x}'" for x in names)
    return f"""with recursive p as (select event_type as symbol, cast(ts as date) as day, event_id, floor((floor(epoch(ts))::bigint - case when event_id % 11 = 0 then 7200 else 0 end) / 600)::bigint * 600 as traded,
      case when event_id % 17 = 0 then 0 else floor(floor(epoch(ts))::bigint % 86400 / 600)::bigint * 10 - case when event_id % 13 = 0 then 5 else 0 end end as total, cast(json_extract(props, '$.k') as bigint) % 3 as size, floor(value / 100) as price,
      row_number() over (partition by event_type, cast(ts as date) order by ts, event_id) as i from events),
    f(symbol, day, i, event_id, volume, bar, traded, total, size, price, verdict, delta) as (
      select symbol, day, 0::bigint, null::bigint, null::bigint, null::bigint, null::bigint, null::bigint, null::bigint, null::double, '', null::bigint from p where i = 1
      union all
      select symbol, day, i, event_id,
        case when verdict in ('no_trade_today', 'pre_open', 'repeated_last_trade', 'duplicate', 'trade') then total_ else volume end, case when verdict in ('duplicate', 'trade') then traded_ // 3600 else bar end,
        case when verdict = 'trade' then traded_ else traded end, case when verdict = 'trade' then total_ else total end, case when verdict = 'trade' then size_ else size end, case when verdict = 'trade' then price_ else price end,
        verdict, case when verdict = 'trade' then total_ - coalesce(volume, total_) end
      from (select f.symbol, f.day, p.i, p.event_id, f.volume, f.bar, f.traded, f.total, f.size, f.price, p.traded as traded_, p.total as total_, p.size as size_, p.price as price_,
        case when p.total = 0 and coalesce(f.volume, 0) = 0 then 'no_trade_today'
          when p.traded % 86400 < {OPENS} then case when p.total < f.volume then 'volume_regressed' else 'pre_open' end
          when p.traded // 3600 < f.bar then case when f.volume is null or p.total = f.volume then 'repeated_last_trade' else 'late' end
          when p.total < f.volume then 'volume_regressed'
          when p.traded = f.traded and p.total = f.total and p.size = f.size and p.price = f.price then 'duplicate' else 'trade' end as verdict
        from f join p on p.symbol = f.symbol and p.day = f.day and p.i = f.i + 1) n)
    select symbol, day as session_date, event_id, verdict, delta from f where verdict in ({listed})"""


#: What each query reports of the ticks' verdicts.
VERDICTS = {
    "str_03": ("late", "repeated_last_trade"), "str_04": ("trade", "volume_regressed"), "str_05": ("duplicate",), "str_06": ("pre_open", "no_trade_today"),
    "str_09": ("no_trade_today", "pre_open", "trade", "late"),
}


GRACE = 3
MARK = f"(select epoch_ms(max(ts)) - {1000 * GRACE} from events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.option("pathGlobFilter", "events.parquet").parquet(sf_dir).schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.select("user_id", "event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("session_date"), F.hour("ts").alias("slot"), F.col("value").alias("price"))


def _streamed(rows: DataFrame, name: str) -> DataFrame:
    """Rows that Spark has made, as a stream over a file of them."""
    path = f"{replay.shared_dir(rows.sparkSession)}/{name}"
    rows.coalesce(1).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def _keyed(operator: keyed.Keyed, rows: DataFrame, at: str) -> DataFrame:
    return replay.replayed(operator.stream(rows, at, f"{GRACE} seconds"))


def _bucketed(operator: keyed.Keyed, rows: DataFrame, at: str) -> DataFrame:
    return replay.replayed(operator.bucketed(rows, at, f"{GRACE} seconds"))


def str_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("session_date", "ts", F.when(F.col("event_id") % 11 == 0, F.col("slot") - 12).otherwise(F.col("slot")).alias("bucket"), F.col("slot").alias("now"))
    return _keyed(keyed.pending(), e, "ts")


STR_08 = f"""with {duckdb_tables(['ticks'])}, p as (select session_date, slot as now, case when event_id % 11 = 0 then slot - 12 else slot end as bucket from ticks)
  select session_date, count(case when bucket >= now - 10 then 1 end) as kept, count(case when bucket < now - 10 then 1 end) as dropped from p group by session_date having epoch_ms(session_date + interval 1 day) < {MARK}"""


def str_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("symbol in ('click', 'view')").select(F.col("user_id").cast("string").alias("subject"), "ts")
    return _bucketed(keyed.freshness(), e, "ts")


STR_10 = """with r as (select cast(user_id as varchar) as subject, cast(floor(epoch(ts)) as bigint) as moment from events where event_type in ('click', 'view')), w as (select max(epoch_ms(ts)) - 3000 as mark from events where event_type in ('click', 'view')),
  g as (select subject, moment, lag(moment) over (partition by subject order by moment) as before, lead(moment) over (partition by subject order by moment) as later from r)
  select subject, moment, 'FRESH' as status from g where before is null or moment - before >= 86400
  union all select subject, moment + 86400, 'STALE' from g cross join w where later - moment >= 86400 or later is null and 1000 * (moment + 86400) < mark"""


def str_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = market(spark, sf_dir, ["bars"])["bars"]
    at = lambda hours: F.expr(f"timestamp_seconds(unix_date(session_date) * 86400L + ({hours}) * 1800L)")
    live = b.where("slot % 5 <> 2").select("symbol", "session_date", F.col("slot").cast("int").alias("slot"), "close", F.lit("live").alias("source"), at("slot").alias("at"))
    history = b.where("slot < 12 and slot % 4 <> 3").select("symbol", "session_date", F.col("slot").cast("int").alias("slot"), (F.col("close") + 1).alias("close"), F.lit("history").alias("source"), at("24 + slot").alias("at"))
    return _keyed(keyed.backfilled(), _streamed(live.unionByName(history), "bars"), "at")


STR_11 = f"""with {duckdb_tables(['bars'])}, live as (select symbol, session_date, slot, close from bars where slot % 5 <> 2), history as (select symbol, session_date, slot, close + 1 as close from bars where slot < 12 and slot % 4 <> 3),
  w as (select max(moment) - 3 as mark from (select date_diff('day', date '1970-01-01', session_date) * 86400 + slot * 1800 as moment from live union all select date_diff('day', date '1970-01-01', session_date) * 86400 + (24 + slot) * 1800 from history) x),
  k as (select symbol, session_date, slot from live union select symbol, session_date, slot from history)
  select k.symbol, k.session_date, cast(k.slot as int) as slot, coalesce(h.close, l.close) as close, case when h.close is not null and l.close is null then 'FILLED' when h.close is not null then 'REPLACED' else 'LIVE' end as origin
  from k left join live l on l.symbol = k.symbol and l.session_date = k.session_date and l.slot = k.slot left join history h on h.symbol = k.symbol and h.session_date = k.session_date and h.slot = k.slot
  cross join w where (date_diff('day', date '1970-01-01', k.session_date) + 1) * 86400 < mark"""


def str_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("price") > 100, 3).when(F.col("price") > 50, 2).otherwise(1)
    e = _events(spark, sf_dir).select(F.concat_ws(":", "user_id", "symbol").alias("subject"), "ts", severity.alias("severity"))
    return _bucketed(keyed.cooldown(6 * 3600), e, "ts")


STR_12 = """with recursive v as (select user_id || ':' || event_type as subject, cast(floor(epoch(ts)) as bigint) as moment, case when value > 100 then 3 when value > 50 then 2 else 1 end as severity,
    row_number() over (partition by user_id, event_type order by cast(floor(epoch(ts)) as bigint), case when value > 100 then 3 when value > 50 then 2 else 1 end) as i from events),
  f(subject, i, moment, severity, last_moment, last_severity, fires) as (
    select subject, i, moment, severity, moment, severity, true from v where i = 1
    union all select v.subject, v.i, v.moment, v.severity,
      case when v.moment - f.last_moment >= 21600 or v.severity > f.last_severity then v.moment else f.last_moment end, case when v.moment - f.last_moment >= 21600 or v.severity > f.last_severity then v.severity else f.last_severity end,
      v.moment - f.last_moment >= 21600 or v.severity > f.last_severity from f join v on v.subject = f.subject and v.i = f.i + 1)
  select subject, moment, severity from f where fires"""


def str_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = market(spark, sf_dir, ["snapshots"])["snapshots"]
    readings = s.select("underlying", F.expr("timestamp_seconds(unix_date(session_date) * 86400L)").alias("at"), F.round("price", 2).alias("price"), F.round("oi", 2).alias("oi"))
    return _keyed(keyed.buildup(3 * 86400), _streamed(readings, "readings"), "at")


STR_15 = f"""with {duckdb_tables(['snapshots'])}, r as (select underlying, date_diff('day', date '1970-01-01', session_date) * 86400 as moment, round(price, 2) as price, round(oi, 2) as oi from snapshots),
  l as (select *, lag(moment) over w as before, lag(price) over w as p, lag(oi) over w as o from r window w as (partition by underlying order by moment))
  select underlying, cast(moment as bigint) as moment, case when before is null or moment - before >= 259200 then 'UNKNOWN' when price > p and oi > o then 'LONG_BUILDUP' when price < p and oi > o then 'SHORT_BUILDUP' when price < p and oi < o then 'LONG_UNWINDING'
    when price > p and oi < o then 'SHORT_COVERING' else 'NEUTRAL' end as buildup from l"""


def str_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replayed(keyed.sessions(_events(spark, sf_dir), "1 day", f"{GRACE} seconds"))


STR_18 = f"""with t as (select user_id, ts, case when ts - lag(ts) over w < interval 1 day then 0 else 1 end as new_ from events window w as (partition by user_id order by ts)),
  s as (select user_id, ts, sum(new_) over (partition by user_id order by ts rows unbounded preceding) as k from t) select user_id, min(ts) as session_start, max(ts) as last_tick, count(*) as n from s group by user_id, k having max(ts) + interval 1 day <= {UPTO}"""


def str_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = market(spark, sf_dir, ["ticks"])["ticks"].groupBy("session_date", "slot").agg(F.count("*").alias("n"))
    counter = F.sum("n").over(W.partitionBy("session_date", F.col("slot") < 12).orderBy("slot"))  # it begins anew at noon
    readings = t.select("session_date", F.expr("timestamp_seconds(unix_date(session_date) * 86400L + slot * 3600L)").alias("at"), counter.alias("counter"))
    return _keyed(keyed.sampler(), _streamed(readings, "counters"), "at")


STR_19 = f"""with {duckdb_tables(['ticks'])}, m as (select session_date, slot, count(*) as n from ticks group by session_date, slot), c as (select session_date, slot, sum(n) over (partition by session_date, slot < 12 order by slot) as counter from m),
  d as (select session_date, slot, case when counter >= coalesce(lag(counter) over w, 0) then counter - coalesce(lag(counter) over w, 0) else counter end as step from c window w as (partition by session_date order by slot))
  select session_date, cast(max(step) as bigint) as most, cast(sum(step) as bigint) as total, count(*) as n from d group by session_date
  having (date_diff('day', date '1970-01-01', session_date) + 1) * 86400 < (select max(date_diff('day', date '1970-01-01', session_date) * 86400 + slot * 3600) - 3 from m)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "str_01": lambda s, d: replay.replayed(t.closed_bars(t.tick_stream(s, d), "1 minute")),
        "str_08": str_08, "str_10": str_10, "str_11": str_11, "str_12": str_12, "str_15": str_15, "str_18": str_18, "str_19": str_19,
        "str_02": lambda s, d: replay.replayed(t.closed_bars(t.tick_stream(s, d), "1 hour")),
        "str_14": lambda s, d: replay.followed(t.closed_bars(t.tick_stream(s, d), "1 hour"), t.breadth),
        "str_17": lambda s, d: replay.replayed(t.trailing(t.tick_stream(s, d), "3 hours", "1 hour")),
        **{name: lambda s, d, names=names: _verdicts(s, d, *names) for name, names in VERDICTS.items()},
    }


def oracle_sql() -> dict[str, str]:
    return {
        "str_01": BARS.replace("'hour'", "'minute'").replace("1 hour", "1 minute"),
        "str_08": STR_08, "str_10": STR_10, "str_11": STR_11, "str_12": STR_12, "str_15": STR_15, "str_18": STR_18, "str_19": STR_19,
        "str_02": BARS,
        "str_14": f"select bar_start, count(*) filter (where close > open) as rising, count(*) filter (where close < open) as falling, count(*) as symbols from ({BARS}) b group by bar_start",
        "str_17": f"""select event_type as symbol, date_trunc('hour', ts) + to_hours(k) as window_end, min(value) as low, max(value) as high, round(avg(value), 6) as mean_price,
          cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as volume, count(*) as n from events cross join (select unnest([1, 2, 3]) as k) x
          where date_trunc('hour', ts) + to_hours(k) <= {UPTO} group by 1, 2""",
        **{name: _verdict_sql(*names) for name, names in VERDICTS.items()},
    }
