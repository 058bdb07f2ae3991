"""The selector over all sessions in order of date, kept day by day: a rerun only makes the days whose inputs have changed.

Each stage has a table of its own, a log of days. A day's entry bears the key of its inputs, a digest of its own rows and of those of the sessions that
it looks back on, so a changed day makes the days after it anew as far as they look, and a run that was ended goes on with what
is missing of each stage.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.sources.log import Log

DAY = "session_date"


def day_keys(inputs: list[DataFrame], span: int) -> dict[str, str]:
    """session_date -> a digest of its rows in all inputs and of those of the `span` sessions before. A row a day comes to the driver."""
    marks = None
    for k, x in enumerate(inputs):
        own = x.groupBy(DAY).agg(F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64(*x.columns)), F.bit_xor(F.xxhash64(F.lit("second"), *x.columns))).alias(f"m{k}"))
        marks = own if marks is None else marks.join(own, DAY, "full")
    mine = F.concat_ws("|", DAY, *[F.coalesce(f"m{k}", F.lit("")) for k in range(len(inputs))])
    before = W.orderBy(DAY).rowsBetween(-span, 0)
    keys = marks.select(DAY, mine.alias("mine")).withColumn("key", F.sha2(F.array_join(F.collect_list("mine").over(before), "\n"), 256))
    return {str(r[DAY]): r["key"] for r in keys.select(DAY, "key").toLocalIterator()}


class Days:
    """A stage's table: one entry a day, with the key of its inputs."""

    def __init__(self, spark, root: str) -> None:
        self.log = Log(spark, root)

    def stale(self, keys: dict[str, str]) -> list[str]:
        _, entries = self.log.snapshot()
        return sorted(d for d, key in keys.items() if entries.get(d, {}).get("key") != key)

    def put(self, rows: DataFrame, keys: dict[str, str], days: list[str]) -> None:
        """rows, of these days only, with one version; a day without rows is told, too."""
        path = self.log.written(rows, DAY)
        there = {str(r[0]) for r in self.log.spark.read.schema(rows.schema).parquet(path).select(DAY).distinct().toLocalIterator()}
        told = {d: {"path": f"{path}/_by={d}" if d in there else None, "key": keys[d]} for d in days}
        self.log.changed(lambda _: (told | {"_schema": {"path": None, "key": rows.schema.json()}}, False))

    def rows(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Rows of the days from first to last; none of the days may have any."""
        _, entries = self.log.snapshot()
        schema = StructType.fromJson(json.loads(entries["_schema"]["key"]))
        some = {d: x for d, x in entries.items() if x["path"] and (first is None or d >= first) and (last is None or d <= last)}
        return self.log.rows(some, schema) if some else self.log.spark.createDataFrame([], schema)


def reconstructed(
    spark, root: str, keys: dict[str, str], lookback: int, history: int, rows_of: Callable[[str, list[str]], DataFrame], sums_of: Callable[[DataFrame], DataFrame], scored_of: Callable[[DataFrame, DataFrame], DataFrame], decided_of: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """All days' decisions, after whatever is missing has been made.

    rows_of(first, days): the rows of days, from inputs of first and later sessions; sums_of(rows): their sums of products;
    scored_of(rows, sums): predictions from the sums of earlier days; decided_of(scored): decisions of all days in scored.
    """
    order = sorted(keys)
    before = lambda d, n: order[max(0, order.index(d) - n)]
    tables = {name: Days(spark, f"{root}/{name}") for name in ("rows", "sums", "scored", "decisions")}

    def made(name: str, make: Callable[[list[str]], DataFrame]) -> None:
        days = tables[name].stale(keys)
        if days:
            tables[name].put(make(days).where(F.col(DAY).cast("string").isin(days)), keys, days)

    made("rows", lambda days: rows_of(before(days[0], lookback), days))
    read = lambda name, first=None, last=None: tables[name].rows(first, last)
    some = lambda name, days: read(name, days[0], days[-1]).where(F.col(DAY).cast("string").isin(days))
    made("sums", lambda days: sums_of(some("rows", days)))
    made("scored", lambda days: scored_of(some("rows", days), read("sums", before(days[0], history), days[-1])))
    made("decisions", lambda days: decided_of(read("scored", before(days[0], history), days[-1])))
    return read("decisions")
