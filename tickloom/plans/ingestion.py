"""Queries of the binary stream and of fetching history: each writes stand-in files to the shared folder and reads them back."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources import files
from tickloom.sources.binary_stream import FIELDS, read_stream, write_streams
from tickloom.sources.bootstrap import Bootstrap
from tickloom.sources.log import Log
from tickloom.sources.market import duckdb_tables, market
from tickloom.sources.shared import fresh_path

#: Hours of the stand-in are minutes from 09:15 in India.
T0 = "unix_date(session_date) * 86400L + (555 + slot) * 60L - 19800L"
T0_DUCK = "date_diff('day', date '1970-01-01', session_date) * 86400 + (555 + slot) * 60 - 19800"
SESSIONS = 20


def src_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The desk's bars as three binary streams, read again: of all but one instrument, from the fifth of the month on."""
    b = market(spark, sf_dir, ["desk_bars"])["desk_bars"]
    rows = b.select(F.concat(F.lit("S"), F.col("symbol")).alias("instrument"), F.lit("EQ").alias("kind"), F.concat(F.lit("SEC"), F.col("symbol") % 3).alias("sector"), F.lit("OK").alias("status"), F.expr(T0).cast("double").alias("time"), *FIELDS[1:])
    path = fresh_path(spark, "streams")
    write_streams(rows, path, 3, 60, block=64)
    names = ",".join(f"S{k}" for k in range(12) if k != 7)
    read = read_stream(spark, path, instruments=names).where(F.col("day") >= F.lit(19727))
    return read.groupBy("instrument", "kind", "sector", "status", "day").agg(F.count("*").alias("rows"), F.round(F.sum("close"), 4).alias("closes"), F.round(F.sum("volume"), 4).alias("volume"), F.min("time").cast("long").alias("first_time"), F.max("high").alias("high"))


SRC_11 = f"""with {duckdb_tables(['desk_bars'])} select 'S' || symbol as instrument, 'EQ' as kind, 'SEC' || (symbol % 3) as sector, 'OK' as status, cast(date_diff('day', date '1970-01-01', session_date) as int) as day, count(*) as rows,
  round(sum(close), 4) as closes, round(sum(cast(volume as double)), 4) as volume, cast(min({T0_DUCK}) as bigint) as first_time, max(high) as high from desk_bars where symbol <> 7 and date_diff('day', date '1970-01-01', session_date) >= 19727 group by symbol, session_date"""


def served(folder: str) -> Callable:
    """A history server over files: the rows of a symbol between two days."""

    def fetch(symbol: str, first: str, last: str) -> list[tuple]:
        rows = [json.loads(line) for path, _ in files.listed(f"{folder}/symbol={symbol}", ".txt") for line in files.read(path).decode().splitlines()]
        return [tuple(r) for r in rows if first <= r[0] <= last]

    return fetch


def src_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sessions of the desk, fetched from served files and assembled into an archive."""
    b = market(spark, sf_dir, ["desk_bars"])["desk_bars"]
    folder, root = fresh_path(spark, "served"), fresh_path(spark, "bootstrap")
    line = F.to_json(F.array(*[F.col(c).cast("string") for c in ("session_date", "slot", "open", "high", "low", "close", "volume")]))
    b.select(F.col("symbol").cast("string").alias("symbol"), line.alias("value")).repartition("symbol").write.partitionBy("symbol").text(folder)
    x = Bootstrap(spark, root, f"{root}/archive", span_days=9)
    x.run(b.select("session_date"), b.select(F.col("symbol").cast("string").alias("symbol")).distinct(), SESSIONS, served(folder))
    table = Log(spark, x.archive).table()
    return table.select(F.to_date("session_date").alias("session_date"), F.col("symbol").cast("int").alias("symbol"), F.col("minute").alias("slot"), "open", "high", "low", "close", "volume")


SRC_24 = f"""with {duckdb_tables(['desk_bars'])}, d as (select session_date, row_number() over (order by session_date desc) as k from (select distinct session_date from desk_bars) x)
  select b.session_date, symbol, cast(slot as bigint) as slot, open, high, low, close, cast(volume as double) as volume from desk_bars b join d on d.session_date = b.session_date where k <= {SESSIONS}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"src_11": src_11, "src_24": src_24}


def oracle_sql() -> dict[str, str]:
    return {"src_11": SRC_11, "src_24": SRC_24}
