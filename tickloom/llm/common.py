"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The whole text, a null as the empty one."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only on one machine where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tickloom-"))
    return named or sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tickloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Buckets of keys that say which rows may be meant: as many at most are broadcast, whatever the number of keys.
BUCKETS = 1 << 20


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like `name` that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def told_apart(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of `keys`, rows that surely have none); key is a long, keys has one column of them.

    Many keys fill the buckets and put more rows on the first side, which costs time, not results; no text is shuffled.
    """
    bucket = fresh(docs, "bucket")
    full = F.broadcast(keys.toDF("key").select(F.pmod("key", F.lit(BUCKETS)).alias(bucket)).distinct())
    same = F.pmod(key, F.lit(BUCKETS)) == F.col(bucket)
    return docs.join(full, same, "left_semi"), docs.join(full, same, "left_anti")
