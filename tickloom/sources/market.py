"""Stand-in market tables over the generic ones: each a named operator over others, down to Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.dialect import Operator

PARQUET = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")

TABLES: dict[str, Operator] = {
    x.name: x
    for x in (
        Operator("ticks", "select event_type as symbol, ts, value as price, @json_int(props, k) as size, user_id, event_id, cast(ts as date) as session_date, hour(ts) as slot from {events}"),
        Operator(
            "bars",
            """select symbol, session_date, slot, min_by(price, ts) as open, max(price) as high, min(price) as low, max_by(price, ts) as close,
            cast(sum(size) as bigint) as volume, count(*) as n from {ticks} group by symbol, session_date, slot""",
        ),
        Operator("slots", "select cast(slot as int) as slot from (select @each(0, 23) as slot) x"),
        Operator(
            "grid",
            """select k.symbol, k.session_date, k.slot, b.open, b.high, b.low, b.close, b.volume
            from (select symbol, session_date, slot from (select distinct symbol from {bars}) s cross join (select distinct session_date from {bars}) d cross join {slots}) k
            left join {bars} b on b.symbol = k.symbol and b.session_date = k.session_date and b.slot = k.slot""",
        ),
        Operator(
            "daily",
            """select user_id as symbol, session_date, @first_by(price, ts) as open, max(price) as high, min(price) as low, @last_by(price, ts) as close,
            cast(sum(size) as bigint) as volume, count(*) as n, cast(user_id % 7 as int) as sector from {ticks} group by user_id, session_date""",
        ),
        Operator("market", "select session_date, slot, avg(price) as level from {ticks} group by session_date, slot"),
        Operator(
            "chain",
            """select cast(l_suppkey % 5 as int) as underlying, l_quantity as strike, case when l_linestatus = 'F' then 'CE' else 'PE' end as side,
            round(sum(l_extendedprice), 2) as oi, round(sum(l_quantity), 2) as volume, avg(l_discount) as iv, count(*) as n
            from {lineitem} group by l_suppkey % 5, l_quantity, l_linestatus""",
        ),
        Operator("spots", "select cast(l_suppkey % 5 as int) as underlying, avg(l_quantity) as spot from {lineitem} group by l_suppkey % 5"),
        Operator(
            "book",
            """select l_partkey as security, side, level, price, quantity from (
              select l_partkey, 'bid' as side, l_extendedprice as price, l_quantity as quantity,
                cast(row_number() over (partition by l_partkey order by l_extendedprice, l_orderkey, l_linenumber) as int) as level from {lineitem}
              union all
              select l_partkey, 'ask' as side, l_extendedprice as price, l_quantity as quantity,
                cast(row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber) as int) as level from {lineitem}) x where level <= 5""",
        ),
        Operator(
            "returns",
            """select symbol, session_date, slot, open, close, volume, case when slot = 0 then @ln(@over(close, open))
            else @ln(@over(close, lag(close) over (partition by symbol, session_date order by slot))) end as r from {grid}""",
        ),
        # A desk of a dozen stocks in three sectors, dense enough for windows within a session.
        Operator("desk_ticks", "select cast(user_id % 12 as int) as symbol, ts, price, size, event_id, user_id, session_date, cast(slot as int) as slot from {ticks}"),
        Operator("desk_universe", "select distinct symbol, cast(symbol % 3 as int) as sector from {desk_ticks}"),
        Operator(
            "desk_bars",
            """select symbol, session_date, slot, min_by(price, ts) as open, max(price) as high, min(price) as low, max_by(price, ts) as close,
            cast(sum(size) as bigint) as volume from {desk_ticks} group by symbol, session_date, slot""",
        ),
        Operator("desk_index_bars", "select 1 as priority, session_date, slot, min_by(price, ts) as open, max_by(price, ts) as close from {desk_ticks} where symbol % 2 = 0 group by session_date, slot union all select 2, session_date, slot, min_by(price, ts), max_by(price, ts) from {desk_ticks} group by session_date, slot"),
        # What is known besides bars, and from which slot on. The open comes from another record than the bars, for some stocks.
        Operator(
            "desk_facts",
            """with d as (select symbol, session_date, min(slot) as first_slot, min_by(open, slot) as open, max_by(close, slot) as close from {desk_bars} group by symbol, session_date),
            f as (select symbol, session_date, slot, avg(size) as depth, @over((max(price) - min(price)), avg(price)) as spread, sum(case when event_id % 2 = 0 then size else -size end) / (1e0 * nullif(sum(size), 0)) as flow, avg(price) as mean from {desk_ticks} group by symbol, session_date, slot),
            m as (select session_date, slot, avg(size) / 100 as iv, @over(stddev_pop(price), avg(price)) as ratio, avg(price) as mean from {desk_ticks} group by session_date, slot)
            select session_date, symbol, 'previous_close' as name, 0 as known_slot, lag(close) over (partition by symbol order by session_date) as value from d
            union all select session_date, symbol, 'today_open', first_slot, open from d where symbol % 4 != 0
            union all select session_date, symbol, 'spread_bps', slot + 1, 100 * spread from f where slot % 2 = 0 union all select session_date, symbol, 'depth5', slot + 1, depth from f
            union all select session_date, symbol, 'imbalance1', slot + 1, flow from f where slot % 3 = 0 union all select session_date, symbol, 'ofi_norm', slot + 2, flow / 2 from f where symbol % 2 = 0 union all select session_date, symbol, 'signed_flow', slot + 1, -flow from f
            union all select f.session_date, f.symbol, 'response_gap', f.slot + 1, @over((m.mean - f.mean), m.mean) from f join m on m.session_date = f.session_date and m.slot = f.slot
            union all select f.session_date, f.symbol, 'response_gap_sigma', f.slot + 1, @over((m.mean - f.mean), m.mean) / nullif(m.ratio, 0) from f join m on m.session_date = f.session_date and m.slot = f.slot
            union all select f.session_date, f.symbol, 'pending_response_sigma', f.slot + 3, @over((m.mean - f.mean), m.mean) / 2 from f join m on m.session_date = f.session_date and m.slot = f.slot
            union all select session_date, null, 'nifty_atm_iv', slot + 1, iv from m where slot % 3 = 0 union all select session_date, null, 'nifty_budget_ratio', slot + 1, ratio from m where slot % 4 = 1
            union all select session_date, null, 'market_state_code', slot + 1, case when ratio > 1 then 2e0 when iv > 45e-2 then 1e0 else 0e0 end from m""",
        ),
        # Option legs of two underlyings, in snapshots of every third hour; IV in percent or as a fraction, and quotes, deltas or open interest missing here and there.
        Operator(
            "desk_legs",
            """with t as (select cast(user_id % 2 as int) as underlying, session_date, slot, cast(floor(price / 10) * 10 as double) as strike, case when event_id % 2 = 0 then 'CE' else 'PE' end as side, price, size, event_id from {desk_ticks} where slot % 3 = 0),
            s as (select underlying, session_date, slot, avg(price) as spot from t group by underlying, session_date, slot),
            l as (select underlying, session_date, slot, strike, side, avg(price) as price, sum(size) as oi, avg(size) as mean, count(*) as n, min(event_id) as id from t group by underlying, session_date, slot, strike, side)
            select l.underlying, l.session_date, l.slot, @add_days(l.session_date, 6 - @weekday(l.session_date)) as expiry, s.spot, l.strike, l.side,
              case when id % 7 = 0 then null when id % 3 = 0 then 10 + mean / 5 else (10 + mean / 5) / 100 end as iv, case when id % 11 = 0 or l.underlying = 1 and l.slot % 2 = 0 then null when l.side = 'CE' then (s.spot - l.strike) / (4 * s.spot) + 3e-1 else (s.spot - l.strike) / (4 * s.spot) - 3e-1 end as delta,
              case when id % 5 = 0 then null else l.price * 99e-2 end as bid, l.price * 101e-2 as ask, l.price as last_price, cast(oi as double) as oi, case when id % 4 = 0 then null else cast(oi - n as double) end as previous_oi
            from l join s on s.underlying = l.underlying and s.session_date = l.session_date and s.slot = l.slot where l.session_date <> date '2024-01-09'""",
        ),
        Operator("desk_returns", "select underlying, session_date, slot, ln(close / open) / 100 as r from (select cast(user_id % 2 as int) as underlying, session_date, slot, min_by(price, ts) as open, max_by(price, ts) as close from {desk_ticks} group by user_id % 2, session_date, slot) x where open > 0 and close > 0"),
        Operator("desk_futures", "select cast(user_id % 2 as int) as underlying, session_date, slot, avg(price) * (1 + avg(size) / 1e4) as price, avg(price) as spot from {desk_ticks} where event_id % 3 <> 0 group by user_id % 2, session_date, slot"),
        Operator("snapshots", "select o_orderpriority as underlying, cast(o_orderdate as date) as session_date, sum(o_totalprice) as oi, avg(o_totalprice) as price, count(*) as n from {orders} group by o_orderpriority, cast(o_orderdate as date)"),
    )
}


def market(spark: SparkSession, sf_dir: str, names: list[str], made: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """DataFrames of the named tables, lazily."""
    made = {} if made is None else made
    for name in names:
        if name in made:
            continue
        if name in PARQUET:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        elif TABLES[name].inputs():
            op = TABLES[name]
            market(spark, sf_dir, op.inputs(), made)
            made[name] = op(**{x: made[x] for x in op.inputs()})
        else:
            from tickloom.plans.dialect import spelled

            made[name] = spark.sql(spelled(TABLES[name].sql, 0))
    return {x: made[x] for x in names}


def duckdb_tables(names: list[str]) -> str:
    """The named tables and what they stand on, as the beginning of a DuckDB query."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in PARQUET or name in order:
            return
        for x in TABLES[name].inputs():
            add(x)
        order.append(name)

    for x in names:
        add(x)
    return ", ".join(f"{x} as ({TABLES[x].in_duckdb()})" for x in order)


def duckdb_query(op: Operator) -> str:
    tables, sql = duckdb_tables(op.inputs()), op.in_duckdb().strip()
    if not tables:
        return sql
    recursive = "recursive " if re.match("with recursive", sql) else ""
    if sql.startswith("with "):
        return f"with {recursive}{tables}, {sql.removeprefix('with ').removeprefix('recursive ')}"
    return f"with {tables} {sql}"
