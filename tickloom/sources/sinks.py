"""Writers of the market archive. Repeating a write changes nothing; each says what it did as a DataFrame or a boolean.

A table is a folder of Parquet, JSON or CSV files under a root; a day has a folder `session_date=<date>` in it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.archive import END, FIELDS, number
from tickloom.sources.log import Log


def _replaced(df: DataFrame, root: str) -> DataFrame:
    """df in place of all that the table at root held, by one version of its log."""
    log = Log(df.sparkSession, root)
    entry = {uuid.uuid4().hex: {"path": log.written(df)}}
    log.changed(lambda _: (entry, True))
    return log.rows(entry, df.schema)


def write_days(rows: DataFrame, root: str) -> DataFrame:
    """Writes each day's rows unless the day is archived with more: session_date, rows and written of each day.

    All days of a write come in with one version of the table's log, which tells their rows, so older days are neither read nor
    rewritten. One file of gzip CSV a day would be one task's; Parquet is splittable.
    """
    log = Log(rows.sparkSession, root)
    path = log.written(rows, "session_date")
    schema = rows.schema
    # A row a day.
    counts = {str(x["session_date"]): x["rows"] for x in log.spark.read.schema(schema).parquet(path).groupBy("session_date").agg(F.count("*").alias("rows")).toLocalIterator()}
    fuller: dict[str, dict] = {}

    def change(old: dict[str, dict]) -> tuple[dict[str, dict], bool]:
        fuller.clear()
        fuller.update({d: {"path": f"{path}/_by={d}", "rows": n} for d, n in counts.items() if n >= old.get(d, {}).get("rows", 0)})
        return fuller, False

    log.changed(change)
    kind = schema["session_date"].dataType.simpleString()
    told = log.spark.createDataFrame([(d, n, d in fuller) for d, n in counts.items()], "session_date string, rows long, written boolean")
    return told.withColumn("session_date", F.col("session_date").cast(kind))


def live_tables(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candles, reference) of live payloads (column json): session_date, symbol, security_id and the candle's fields; previous_close and today_open."""
    candle = "struct<timestamp: string, open: string, high: string, low: string, close: string, volume: string>"
    stock = f"struct<security_id: string, previous_close: string, today_open: string, candles_1m: array<{candle}>>"
    rows = payloads.select(F.from_json("json", f"session struct<date: string>, stocks map<string, {stock}>").alias("p")).where("p.session.date is not null")
    rows = rows.select(F.col("p.session.date").alias("session_date"), F.explode("p.stocks").alias("symbol", "stock"))
    reference = rows.select("session_date", "symbol", "stock.security_id", *[number(F.col(f"stock.{c}")).alias(c) for c in ("previous_close", "today_open")])
    candles = rows.select("session_date", "symbol", "stock.security_id", F.explode("stock.candles_1m").alias("c"))
    return candles.select("session_date", "symbol", "security_id", "c.timestamp", *[number(F.col(f"c.{c}")).alias(c) for c in FIELDS]), reference


def manifest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """session_date, rows and sha256 of each day: of the sorted digests of its rows, so the order of files doesn't count."""
    said = F.sha2(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    # Digests are first gathered by their beginnings, so no day is gathered whole.
    parts = rows.select("session_date", said.alias("h")).groupBy("session_date", F.substring("h", 1, 3).alias("part")).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256)
    return parts.groupBy("session_date").agg(F.sum("rows").alias("rows"), whole.alias("sha256"))


def append_blocks(rows: DataFrame, root: str, columns: list[str], minute: str = "minute") -> None:
    """A text file for each minute of rows: header, its rows and the end marker; a minute written already stays as it is.

    Which minutes there are, the folders' names say.
    """
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(where):
        had = [(x.getPath().getName().removeprefix("part="),) for x in files.listStatus(where) if x.getPath().getName().startswith("part=")]
        rows = rows.join(spark.createDataFrame(had, "had string"), F.col(minute).cast("string") == F.col("had"), "left_anti")
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    made = rows.groupBy(minute).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.concat(F.array(F.lit(",".join(columns))), "lines", F.array(F.concat(F.lit(f"{END} "), F.col(minute).cast("string"), F.lit(" "), F.size("lines").cast("string")))), "\n")
    made.select(F.col(minute).alias("part"), F.concat(text, F.lit("\n")).alias("value")).repartition("part").write.mode("append").partitionBy("part").text(root)


def compacted(stream: DataFrame, root: str, day: str) -> DataFrame:
    """A finished day's rows as one table of the archive; the same rows give the same table, however often it is called."""
    return _replaced(stream.coalesce(1), f"{root.rstrip('/')}/session_date={day}")


def expired(folders: DataFrame, today: Column, retention: int) -> DataFrame:
    """Of stream folders (day, compacted) those past retention that are in the archive, and those that are to be compacted first."""
    age = F.date_diff(today, "day")
    return folders.where(age > 0).select("day", (~F.col("compacted")).alias("to_compact"), (age > retention).alias("to_delete"))


def within_budget(rows: DataFrame, day: str, order: str, size: str, budget: int) -> DataFrame:
    """The rows of each day that an append takes: those before which the day has less than `budget` bytes."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum(size).over(W.partitionBy(day).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < budget).drop("before")


def add_new(rows: DataFrame, root: str, key: str, digest: str | None = None) -> DataFrame:
    """Adds rows whose key isn't stored yet, once each, and returns them: repeating an add adds nothing.

    With `digest`, a stored key with another digest is an error. Of writers at the same time one adds first, and the others look
    again at what is new.
    """
    log = Log(rows.sparkSession, root)
    once = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("x")).select(key, "x.*")

    def change(old: dict[str, dict]) -> tuple[dict[str, dict], bool]:
        new = once
        if old:
            had = log.rows(old, once.schema)
            if digest is not None:
                wrong = F.raise_error(F.concat(F.lit("another one is stored for "), F.col(key).cast("string"))).cast("boolean")
                is_new = F.when(F.col("_old").isNull(), F.lit(True)).when(F.col("_old") == F.col(digest), F.lit(False)).otherwise(wrong)
                new = new.join(had.select(F.col(key), F.col(digest).alias("_old")), key, "left").where(is_new).drop("_old")
            else:
                new = new.join(had.select(key), key, "left_anti")
        return {uuid.uuid4().hex: {"path": log.written(new)}}, False

    return log.rows(log.changed(change), once.schema)


def save_once(rows: DataFrame, root: str, key: str, digest: str) -> DataFrame:
    """Adds rows of new keys and returns them; a stored key with another digest is an error, and nothing is added."""
    return add_new(rows, root, key, digest)


def derived(inputs: list[DataFrame], settings: str, root: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` makes of inputs by settings, made once for each state of these: a table's version bears a digest of the settings and all rows read."""
    log = Log(inputs[0].sparkSession, root)
    marks = [x.agg(F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64(*x.columns)), F.bit_xor(F.xxhash64(F.lit("second"), *x.columns)))).head()[0] for x in inputs]
    key = hashlib.sha256("|".join([settings, *marks]).encode()).hexdigest()
    _, had = log.snapshot()
    if key not in had:
        entry = {key: {"path": log.written(make())}}
        log.changed(lambda now: ({} if key in now else entry, False))
        _, had = log.snapshot()
    return log.rows({key: had[key]})


def json_lines(rows: DataFrame) -> DataFrame:
    """Each row as a JSON text: nulls are said, NaN and infinite numbers are null."""
    finite = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("json"))


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header=True, compression="gzip").csv(path)


def backup(spark: SparkSession, root: str, to: str) -> DataFrame:
    """A copy of a table, in place of an older copy; readers see the old or the new one."""
    return _replaced(spark.read.parquet(root), to)


BARS = ["session_date", "symbol", *FIELDS]
