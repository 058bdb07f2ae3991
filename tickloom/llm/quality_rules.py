"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus.

Word unigrams and bigrams are hashed to buckets; the counts of each bucket in the trusted documents and in all documents,
these brought to the size of the trusted side, give two multinomials smoothed alike, so an n-gram too rare to be expected
there has a ratio near 1 whatever the sizes. A document's score is the mean over its n-grams of the logarithm of their
ratio, so it doesn't follow the length, and one fixed threshold decides on every document. A trusted document is scored
against the counts of the others. All of it is DataFrame functions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import whole, words

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
#: Logarithms are rounded to 1 / SCALE.
SCALE = 1 << 20
#: At most so many trusted documents, those of the lowest hashes, make up the target; their ids are broadcast.
TARGET_DOCUMENTS = 20_000
#: Added to the count of a bucket in the trusted documents and to the count expected there.
PRIOR = 4.0
#: In nats an n-gram.
THRESHOLD = -0.1


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def _grams(w: Column) -> Column:
    """Buckets of all words and all pairs of neighbours."""
    # BUCKETS is a power of two.
    bucket = lambda *x: F.xxhash64(*x).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    one = F.transform(w, lambda x: bucket(x))
    two = F.transform(F.slice(w, 2, F.size(w)), lambda x, i: bucket(F.get(w, i), x))
    return F.concat(one, two)


def target_ids(trusted: DataFrame) -> DataFrame:
    """`target_id` of the documents that make up the target, TARGET_DOCUMENTS at most."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("target_id")).where("target_id is not null").distinct()
    return ids.orderBy(F.xxhash64("target_id"), "target_id").limit(TARGET_DOCUMENTS).withColumn("trusted", F.lit(1))


def count_table(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, `raw` and `own`, its counts in all documents and in those of ids; BUCKETS rows at most."""
    rows = docs.select(F.col(id_col).cast("long").alias("target_id"), words(whole(text_col)).alias("w"))
    rows = rows.join(F.broadcast(ids), "target_id", "left").select("trusted", "w")
    grams = rows.select("trusted", F.explode(_grams(F.col("w"))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.coalesce(F.sum("trusted"), F.lit(0)).alias("own"))


def _literal(values: list[int]) -> Column:
    """Numbers as one array literal: BUCKETS of them whatever the corpus, so they may pass the driver."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _sorted_windows(hashes: Column) -> Column:
    """(hash, place) of a text's 3-word windows, sorted; none where no hash is there twice, as in most texts."""
    pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0))


def _repeated_words(sorted_windows: Column) -> Column:
    """Places of the 3-word windows found twice or more. sorted_windows: (hash, place), sorted."""
    s = sorted_windows
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) & (i > 0) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def quality_verdicts(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    keep: list[str] | None = None,
) -> DataFrame:
    """Judges every document of docs; trusted: ids of documents known to be good.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept, and the
    columns named in `keep` under their own names prefixed with `in_`. A null text has no words and so is rejected;
    null ids are judged like others; repeated rows are judged each; an empty table gives an empty result. Only the named
    columns are read, so any others may clash.
    """
    ids = target_ids(trusted)
    raw, own = [0] * BUCKETS, [0] * BUCKETS
    for x in count_table(docs, ids, id_col, text_col).collect():
        raw[x["bucket"]], own[x["bucket"]] = x["raw"], x["own"]
    all_raw, all_own = sum(raw), sum(own)
    share = all_own / max(all_raw, 1)
    table = _literal([round(math.log((x + PRIOR) / (y * share + PRIOR)) * SCALE) for x, y in zip(own, raw, strict=True)])
    raws, owns = _literal(raw), _literal(own)
    kept_columns = [F.col(c).alias(f"in_{c}") for c in keep or []]
    names = [f"in_{c}" for c in keep or []]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("t"), *kept_columns)
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("target_id"), "left").drop("target_id")
    rows = rows.withColumn("w", words(F.col("t")))
    w, t = F.col("w"), F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, WHITE) != "")
    windows = F.transform(F.slice(w, 3, F.size(w)), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
    rows = rows.select(
        "doc_id", *names, "w", F.size("w").cast("long").alias("n_words"),
        F.length(_without(t, WHITE)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        "trusted", _grams(w).alias("grams"), lines.alias("lines"), windows.alias("windows"),
    )
    rows = rows.withColumn("sorted", F.when(F.col("trusted").isNotNull(), F.sort_array("grams"))).withColumn("s", _sorted_windows(F.col("windows")))
    g = F.col("sorted")
    rows = rows.select(
        "doc_id", *names, "n_words", "word_chars", "n_symbols", "trusted", "grams", "sorted",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("s")).alias("at"),
        F.filter(F.transform(g, lambda x, i: F.when((i == 0) | (F.get(g, i - 1) != x), i)), lambda i: i.isNotNull()).alias("firsts"),
    )
    at, firsts, n = F.col("at"), F.col("firsts"), F.size("grams")
    # Against the counts of the other documents, each bucket of a trusted one as often as it has it.
    rest = (F.lit(all_own) - n) / F.greatest(F.lit(all_raw) - n, F.lit(1))
    runs = F.transform(firsts, lambda p, i: F.struct(F.get(g, p).alias("b"), (F.coalesce(F.get(firsts, i + 1), n) - p).alias("c")))
    ratio = lambda x: F.log((F.get(owns, x["b"]) - x["c"] + PRIOR) / ((F.get(raws, x["b"]) - x["c"]) * rest + PRIOR))
    left_out = F.aggregate(runs, F.lit(0).cast("long"), lambda acc, x: acc + F.round(ratio(x) * SCALE).cast("long") * x["c"])
    summed = F.aggregate("grams", F.lit(0).cast("long"), lambda acc, g: acc + F.get(table, g))
    covered = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    rows = rows.select(
        "doc_id", *names, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_repeat_words"),
        # Whole numbers: no order of adding changes the sum.
        F.coalesce(F.try_divide(F.when(F.col("trusted").isNotNull(), left_out).otherwise(summed), n * F.lit(float(SCALE))), F.lit(0.0)).alias("score"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score",
        (~failed & (F.col("score") >= F.lit(threshold))).alias("kept"),
    )


def kept_documents(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that quality_verdicts keeps; their texts aren't shuffled."""
    judged = quality_verdicts(docs, trusted, id_col, text_col, keep=docs.columns)
    # A condition that isn't a function of the row stays above the projections: pushed below, every place would split the text anew.
    judged = judged.withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return judged.where("kept").select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])
