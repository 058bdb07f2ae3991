"""Registries of features, measures and signals: a name, what it means, and how it is made of columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec



def _day() -> WindowSpec:
    return W.partitionBy("symbol", "session_date").orderBy("slot")


def _so_far() -> WindowSpec:
    return _day().rowsBetween(W.unboundedPreceding, 0)


def _last(n: int) -> WindowSpec:
    return _day().rowsBetween(1 - n, 0)


def _full(agg: Column, x: str, n: int) -> Column:
    return F.when(F.count(x).over(_last(n)) == n, agg.over(_last(n)))


def _log(x: Column, y: Column) -> Column:
    return F.when((x > 0) & (y > 0), F.log(x / y))


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    unit: str
    min_bars: int
    purpose: str
    column: Callable[[], Column]


def _ret(n: int) -> Callable[[], Column]:
    return lambda: _log(F.col("close"), F.lag("close", n).over(_day()))


#: Twenty features of a stock at a bar.
FEATURES = {
    x.name: x
    for x in (
        FeatureSpec("ret_1", "log", 2, "last move", _ret(1)),
        FeatureSpec("ret_3", "log", 4, "short move", _ret(3)),
        FeatureSpec("ret_5", "log", 6, "move", _ret(5)),
        FeatureSpec("ret_open", "log", 1, "move since the open", lambda: _log(F.col("close"), F.first("open", True).over(_so_far()))),
        FeatureSpec("acceleration", "log", 11, "change of the move", lambda: _ret(5)() - _log(F.lag("close", 5).over(_day()), F.lag("close", 10).over(_day()))),
        FeatureSpec("range_place", "share", 1, "place in the day's range", lambda: (F.col("close") - F.min("low").over(_so_far())) / F.nullif(F.max("high").over(_so_far()) - F.min("low").over(_so_far()), F.lit(0.0))),
        FeatureSpec("range_pct", "percent", 1, "the day's range", lambda: 100 * (F.max("high").over(_so_far()) - F.min("low").over(_so_far())) / F.nullif(F.first("open", True).over(_so_far()), F.lit(0.0))),
        FeatureSpec("bar_range", "price", 1, "the bar's range", lambda: F.col("high") - F.col("low")),
        FeatureSpec("body", "price", 1, "the bar's body", lambda: F.col("close") - F.col("open")),
        FeatureSpec("volatility_5", "log", 6, "spread of the last moves", lambda: F.when(F.count(F.col("r")).over(_last(5)) == 5, F.stddev_pop("r").over(_last(5)))),
        FeatureSpec("volume_ratio", "ratio", 10, "volume of the last five bars against the five before", lambda: F.sum("volume").over(_last(5)) / F.nullif(F.sum("volume").over(_day().rowsBetween(-9, -5)), F.lit(0))),
        FeatureSpec("volume_so_far", "shares", 1, "the day's volume", lambda: F.sum("volume").over(_so_far())),
        FeatureSpec("vwap_gap", "share", 1, "distance to the day's average price", lambda: F.col("close") / F.nullif(F.sum(F.col("close") * F.col("volume")).over(_so_far()) / F.nullif(F.sum("volume").over(_so_far()), F.lit(0)), F.lit(0.0)) - 1),
        FeatureSpec("mean_gap_5", "share", 5, "distance to the mean", lambda: F.col("close") / F.nullif(_full(F.avg("close"), "close", 5), F.lit(0.0)) - 1),
        FeatureSpec("high_gap", "share", 1, "distance to the day's high", lambda: F.col("close") / F.nullif(F.max("high").over(_so_far()), F.lit(0.0)) - 1),
        FeatureSpec("low_gap", "share", 1, "distance to the day's low", lambda: F.col("close") / F.nullif(F.min("low").over(_so_far()), F.lit(0.0)) - 1),
        FeatureSpec("up_share_5", "share", 5, "rising bars of the last five", lambda: F.avg(F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0)).over(_last(5))),
        FeatureSpec("breakout", "flag", 4, "above the highest of the three bars before", lambda: (F.col("close") > F.max("high").over(_day().rowsBetween(-3, -1))).cast("int").cast("double")),
        FeatureSpec("gap_bars", "bars", 1, "bars since the one before", lambda: (F.col("slot") - F.lag("slot").over(_day())).cast("double")),
        FeatureSpec("bars", "bars", 1, "bars so far", lambda: F.count("close").over(_so_far()).cast("double")),
    )
}


def features(bars: DataFrame, names: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """The named features at every bar (symbol, session_date, slot, open, high, low, close, volume); null where there are too few bars, never NaN."""
    rows = bars.withColumn("r", _ret(1)())
    return rows.select("symbol", "session_date", "slot", *[(F.round(FEATURES[n].column(), 6) + (F.lit(0) if n == "volume_so_far" else F.lit(0.0))).alias(n) for n in names])


@dataclass(frozen=True)
class Measure:
    """A feature against its baseline: of the same slot in the sessions before, on a scale."""

    feature: str
    transform: Callable[[Column], Column]


MEASURES = {
    "return": Measure("ret_open", lambda c: c),
    "volume": Measure("volume_so_far", lambda c: F.log1p(c.cast("double"))),
    "range": Measure("range_pct", lambda c: F.log1p(c)),
}


def scored(rows: DataFrame, measure: str, least: int = 10) -> DataFrame:
    """symbol, session_date, slot and z: the distance to the mean of earlier sessions in their deviations."""
    m = MEASURES[measure]
    before = W.partitionBy("symbol", "slot").orderBy("session_date").rowsBetween(W.unboundedPreceding, -1)
    x = rows.select("symbol", "session_date", "slot", m.transform(F.col(m.feature)).alias("x"))
    z = (F.col("x") - F.avg("x").over(before)) / F.nullif(F.stddev_pop("x").over(before), F.lit(0.0))
    return x.select("symbol", "session_date", "slot", F.lit(measure).alias("measure"), F.when(F.count("x").over(before) >= least, F.round(z, 4) + F.lit(0.0)).alias("z"))


#: Signals: what a rule says of rows that hold the features.
SIGNALS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "momentum": lambda rows: rows.where("ret_5 > 0 and breakout = 1"),
    "reversal": lambda rows: rows.where("ret_5 < 0 and range_place < 0.2"),
    "surge": lambda rows: rows.where("volume_ratio > 1.5"),
}


def signalled(rows: DataFrame, names: tuple[str, ...] = tuple(SIGNALS)) -> DataFrame:
    out = None
    for n in names:
        some = SIGNALS[n](rows).select("symbol", "session_date", "slot", F.lit(n).alias("signal"))
        out = some if out is None else out.unionByName(some)
    return out


def clusters(points: DataFrame, key: str, place: str, price: str, merge_pct: float) -> DataFrame:
    """key, price, n and last place of runs of prices: each joins the run before it if it lies within merge_pct of the run's mean so far.

    A fold over one key's points by rising price: swing points of one instrument, so an array of them is small.
    """
    v = points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(price).cast("double").alias("price"), F.col(place).cast("long").alias("place")))).alias("v"))
    run = "struct<total:double,n:bigint,last:bigint>"
    start = F.struct(F.array().cast(f"array<{run}>").alias("done"), F.lit(None).cast(run).alias("open"))

    def step(s: Column, x: Column) -> Column:
        mean = s["open"]["total"] / s["open"]["n"]
        joins = s["open"].isNotNull() & (F.abs(x["price"] - mean) <= mean * merge_pct / 100)
        grown = F.struct((s["open"]["total"] + x["price"]).alias("total"), (s["open"]["n"] + 1).alias("n"), F.greatest(s["open"]["last"], x["place"]).alias("last"))
        new = F.struct(x["price"].alias("total"), F.lit(1).cast("long").alias("n"), x["place"].alias("last"))
        done = F.when(joins | s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(done.alias("done"), F.when(joins, grown).otherwise(new).cast(run).alias("open"))

    runs = F.aggregate("v", start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    return v.select(key, F.explode(runs).alias("c")).select(key, F.round(F.col("c.total") / F.col("c.n"), 6).alias("price"), F.col("c.n").alias("n"), F.col("c.last").alias("last"))
