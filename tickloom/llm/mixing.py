"""Mixing sources to target weights.

Every record gets a hash-random key; within each source records stand in key order, spread over ranges of the key;
distributed prefix sums of the word counts say where each source's budget is cut, after whole epochs where it needs some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, whole, words, written

#: Hexadecimal digits of the key that name a range: 4096 ranges a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Per source (a row each, with source and source_size): its target.

    Weights go round the sources in code-point order, null last. A target stops at `most` times the source's size and
    the excess is shared anew by weight until none is above: sources in order of size / weight fill up first, so the
    level is found by prefix sums.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.select("source", "source_size", F.element_at(F.lit(weights), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double").alias("w"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    rising, every = W.orderBy("ratio", F.col("source").asc_nulls_last()), W.partitionBy()
    upto = rising.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(share)).alias("all"),
        F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("full"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))).alias("open"),
    )
    level = (F.col("all") - F.col("full")) / F.col("open")
    s = s.withColumn("level", F.max(F.when(level <= F.col("ratio"), level)).over(every))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def mix_sources(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes of every record, repeats counted.

    Returns doc_id, source, text_hash, key, size, source_size, target, epochs and taken. A null text has no words, null sources form one source
    that sorts last, repeated rows are taken one by one, an empty table gives an empty result; other columns are not
    read. Whole epochs take every word of a source; the last one takes records in key order and cuts at the budget, so
    each source's words come to the whole part of its target, and no record exceeds `most` times its size.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(whole(text_col))).cast("long").alias("size"), F.xxhash64(whole(text_col)).alias("text_hash")
    ).withColumn("key", _key(F.col("doc_id")))
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("b"))
    before = F.sum("b").over(W.partitionBy("source").orderBy("range")) - F.col("b")
    ranges = ranges.select("source", "range", before.alias("b0"), F.sum("b").over(W.partitionBy("source")).alias("source_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.max("source_size").alias("source_size")), weights, share, most)
    ranges = ranges.join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    at = rows.withColumn("b", F.sum("size").over(within) - F.col("size"))
    other = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), "b0", "source_size", "target")
    at = at.join(other, at["source"].eqNullSafe(other["s"]) & (at["range"] == other["r"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    at = at.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("b0") - F.col("b")))
    return at.select("doc_id", "source", "text_hash", "key", "size", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[int], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as mixed: every row as often as its words are taken, rounded to whole documents; all columns stay.

    A source's epochs and its cut, a place in the order of the keys, say how often each of its rows comes: texts are
    neither shuffled nor joined one by one. Rows alike in id and text come equally often. Rows without words go with
    those at their place in the order; a source without any words comes once. Null texts, ids and sources are values
    like others, an empty table gives an empty result, columns may have any names.
    """
    mix = mix_sources(docs, weights, id_col=id_col, text_col=text_col, source_col=source_col)
    place = ("key", "doc_id", "size", "text_hash")
    alike = mix.groupBy("source", "source_size", "epochs", *place).agg(F.floor(F.try_divide(F.sum("taken"), F.sum("size")) + 0.5).alias("times"))
    cut = F.max(F.when(F.col("times") > F.col("epochs"), F.struct(*place)))
    name, epochs, last, size = (fresh(docs, x) for x in ("of_source", "epochs", "last", "source_size"))
    # One row a source, written so that its size is known before the join is planned.
    cuts = written(alike.groupBy(F.col("source").alias(name), F.col("source_size").alias(size), F.col("epochs").alias(epochs)).agg(cut.alias(last)), "cuts")
    doc_id = F.col(id_col).cast("long")
    at = F.struct(_key(doc_id).alias("key"), doc_id.alias("doc_id"), F.size(words(whole(text_col))).cast("long").alias("size"), F.xxhash64(whole(text_col)).alias("text_hash"))
    times = F.col(epochs) + F.when(F.col(last).isNotNull() & (at <= F.col(last)), 1).otherwise(0)
    times = F.when(F.col(size) == 0, F.lit(1)).otherwise(times).cast("int")
    rows = docs.join(cuts, F.col(source_col).cast("string").eqNullSafe(F.col(name)))
    return rows.withColumn(name, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
