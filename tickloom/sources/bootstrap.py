"""Fetching history in stages that can stop anywhere: requests are planned once, fetched once each, and assembled into the archive.

The plan is a version of a log, so of two runs one plans. Every answer is a file of its own that is there whole or not at all, named by its request:
what is fetched is what is there. Days come into the archive with one version of its log. A run after a failure goes on with what
is missing, and asks for nothing that it has.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources import files
from tickloom.sources.archive import request_windows
from tickloom.sources.log import Conflict, Log
from tickloom.sources.sinks import write_days

#: symbol, first and last day (texts) -> rows of (day, minute, open, high, low, close, volume).
Fetch = Callable[[str, str, str], list[tuple[str, int, float, float, float, float, float]]]
ROWS = "session_date string, minute long, open double, high double, low double, close double, volume double"


class Bootstrap:
    def __init__(self, spark: SparkSession, root: str, archive: str, span_days: int = 85, workers: int = 4) -> None:
        """root: where plans and answers are; archive: the table of days (sinks.write_days); workers: tasks that fetch at a time."""
        self.spark, self.root, self.archive = spark, root.rstrip("/"), archive
        self.span_days, self.workers = span_days, workers
        self.plans = Log(spark, f"{self.root}/plans")

    def missing(self, calendar: DataFrame, sessions: int) -> list[str]:
        """Of the last `sessions` days of the calendar (session_date) those that the archive doesn't have."""
        _, archived = Log(self.spark, self.archive).snapshot()
        wanted = [str(r[0]) for r in calendar.select("session_date").distinct().orderBy(F.desc("session_date")).limit(sessions).collect()]
        return sorted(set(wanted) - set(archived))

    def plan(self, calendar: DataFrame, symbols: DataFrame, sessions: int) -> DataFrame | None:
        """The requests (request, symbol, first_day, last_day) of the batch at work, or of a new one; None if no day is missing.

        A batch whose days are all missing still goes on before another begins.
        """
        while True:
            missing = self.missing(calendar, sessions)
            if not missing:
                return None
            seen, batches = self.plans.snapshot()
            for x in batches.values():
                if set(x["sessions"]) <= set(missing):
                    return self.plans.rows({"plan": x})
            spans = symbols.select("symbol", F.lit(missing[0]).cast("date").alias("first"), F.lit(missing[-1]).cast("date").alias("last"))
            windows = request_windows(spans, "symbol", span_days=self.span_days, overlap_days=0, lead=False)
            requests = windows.select("symbol", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))
            requests = requests.select(F.sha2(F.concat_ws("|", "symbol", "first_day", "last_day"), 256).alias("request"), "symbol", "first_day", "last_day")
            try:
                self.plans.commit(seen, {f"{missing[0]}_{missing[-1]}": {"path": self.plans.written(requests), "sessions": missing}})
            except Conflict:
                continue

    def _answer(self, request: str) -> str:
        return f"{self.root}/answers/{request}.json.gz"

    def fetch(self, requests: DataFrame, fetch: Fetch) -> DataFrame:
        """Fetches each request that has no answer yet: request and rows of each. An answer is kept before the next request is made."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for request, symbol, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    path = f"{root}/answers/{request}.json.gz"
                    if files.there(path):
                        continue
                    rows = fetch(symbol, first, last)
                    files.written(path, gzip.compress("".join(json.dumps({"symbol": symbol, "row": list(r)}) + "\n" for r in rows).encode(), mtime=0))
                    yield pa.RecordBatch.from_arrays([pa.array([request]), pa.array([len(rows)])], ["request", "rows"])

        return requests.repartition(self.workers, "request").mapInArrow(run, "request string, rows long")

    def status(self, requests: DataFrame) -> dict[str, int]:
        """How many requests are planned and fetched, by the files that are there."""
        there = {p.rsplit("/", 1)[1].removesuffix(".json.gz") for p, _ in files.listed(f"{self.root}/answers", ".json.gz")}
        known = requests.select("request").where(F.col("request").isin(list(there))).count() if there else 0
        return {"planned": requests.count(), "fetched": known}

    def assemble(self, requests: DataFrame, sessions: list[str]) -> DataFrame:
        """Writes the answers' days into the archive, each minute of a symbol once: session_date, rows and written of each day.

        An answer that is missing is an error, and nothing is written.
        """
        paths = [self._answer(r.request) for r in requests.select("request").toLocalIterator()]
        if gone := [p for p in paths if not files.there(p)]:
            raise RuntimeError(f"{len(gone)} of {len(paths)} requests have no answer")
        told = self.spark.read.schema("symbol string, row array<string>").json(paths)
        names = [c.split(" ") for c in ROWS.split(", ")]
        rows = told.select("symbol", *[F.get("row", F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate(names)]).where(F.col("session_date").isin(sessions))
        once = rows.groupBy("session_date", "symbol", "minute").agg(*[F.min(c).alias(c) for c, _ in names[2:]])
        return write_days(once, self.archive)

    def run(self, calendar: DataFrame, symbols: DataFrame, sessions: int, fetch: Fetch) -> DataFrame | None:
        """All stages, as far as they aren't done; the days that were assembled, None if none was missing."""
        requests = self.plan(calendar, symbols, sessions)
        if requests is None:
            return None
        self.fetch(requests, fetch).write.format("noop").mode("overwrite").save()
        missing = self.missing(calendar, sessions)
        _, batches = self.plans.snapshot()
        planned = next(x["sessions"] for x in batches.values() if set(x["sessions"]) <= set(missing))
        return self.assemble(requests, planned)
