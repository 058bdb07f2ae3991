"""Sharding by sampled splitters.

Keys are drawn with a chance that follows their record's size, their quantiles become splitters, records are range
partitioned by them, ranges that come out too large are subdivided, and exact prefix sums over the ranges place every
record. Equal texts have equal keys up to the id, so a group of copies stays together unless it has to be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import whole

#: Bits of the checksum that name a cell of splitters.
CELL_BITS = 12


def shard_by_splitters(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    range_bytes: int = 1 << 20,
    max_ranges: int = 1 << 16,
    draws_per_range: int = 8,
) -> DataFrame:
    """Places every record of docs in one of `shards` shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus `overhead`), text_crc32, shard and slot (0, 1, ... in the shard).
    A null text counts as an empty one, a null id sorts first; repeated rows get a slot each; an empty table gives an
    empty result. Only id and text are read, so other columns may have any name. `range_bytes` is the aim for one
    range, `max_ranges` bounds the splitters and with them everything that is broadcast.
    """
    text = whole(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).head()["b"]
    ranges = int(min(max_ranges, max(8 * shards, -(-total // range_bytes))))
    limit = 4 * max(1, total // ranges)
    key = F.struct(F.col("text_crc32").alias("c"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"))

    # Size-weighted draws: a record is in the sample with a chance of size * draws / total.
    u = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(8)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(u < F.col("size") * F.lit(draws_per_range * ranges / max(total, 1))).select(key.alias("k"))
    placed = drawn.select("k", (F.percent_rank().over(W.orderBy("k")) * ranges).cast("int").alias("q"))
    splits = placed.groupBy("q").agg(F.min("k").alias("k")).where("q > 0")
    shift = 32 - CELL_BITS
    cells = splits.groupBy(F.shiftright(F.col("k.c"), shift).alias("cell")).agg(F.array_sort(F.collect_list("k")).alias("own"))
    cells = rows.sparkSession.range(1 << CELL_BITS).select(F.col("id").alias("cell")).join(cells, "cell", "left")
    before = F.coalesce(F.sum(F.size("own")).over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("cell", F.coalesce("own", F.array().cast("array<struct<c:bigint,d:bigint>>")).alias("own"), before.alias("before"))
    cells = cells.select("cell", "own", F.greatest("before", F.lit(0)).alias("before"))

    # max_ranges splitters at most: a bounded broadcast.
    ranged = rows.withColumn("k", key).withColumn("cell", F.shiftright("text_crc32", shift)).join(F.broadcast(cells), "cell")
    ranged = ranged.select("doc_id", "size", "text_crc32", "k", (F.col("before") + F.size(F.filter("own", lambda s: s <= F.col("k")))).alias("part"))

    # Overfull ranges are subdivided by a hash of the key.
    sums = ranged.groupBy("part").agg(F.sum("size").alias("b"))
    parts = sums.where(F.col("b") > limit).select("part", F.ceil(F.col("b") / F.lit(limit // 4)).alias("pieces"))
    ranged = ranged.join(F.broadcast(parts), "part", "left").withColumn(
        "sub", F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("pieces")), F.lit(0))
    )
    units = ranged.groupBy("part", "sub").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    order = W.orderBy("part", "sub")
    units = units.select(
        "part", "sub", (F.sum("b").over(order) - F.col("b")).alias("b0"), (F.sum("n").over(order) - F.col("n")).alias("n0")
    )
    within = W.partitionBy("part", "sub").orderBy("k", "size")
    at = ranged.select(
        "doc_id", "size", "text_crc32", "part", "sub",
        (F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("b"),
        (F.row_number().over(within).cast("long") - 1).alias("n"),
    )
    at = at.join(units, ["part", "sub"])
    middle = (F.col("b0") + F.col("b")) + F.expr("size div 2")
    at = at.select(
        "doc_id", "size", "text_crc32", (F.col("n0") + F.col("n")).alias("at"),
        F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards / max(total, 1)))).cast("int").alias("shard"),
    )
    first = at.groupBy("shard").agg(F.min("at").alias("first"))
    return at.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
