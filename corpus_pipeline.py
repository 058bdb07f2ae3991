"""A corpus pipeline of five stages over `documents`; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table, written
from tickloom.llm.mixing import mixed_documents
from tickloom.llm.ngram_join import first_of_each
from tickloom.llm.packing import pack_documents
from tickloom.llm.quality_rules import kept_documents
from tickloom.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kept_documents(docs, good)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, a similarity of 0.8 or more."""
    return first_of_each(docs, size=5, num=8, den=10)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return redact_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixed_documents(docs, [3, 1, 2])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixture),
    ("best-fit packing", packed),
]
#: SQL can't express the packing by a tokenizer's ids; the tests hold every stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each reading the table that the one before it wrote.

    Null and empty texts fall to the quality rules, rows without an id pass the join of near duplicates, rows alike are
    one there; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
