"""Tests of what the third round's findings named among the training-data operators."""

from pyspark.sql import functions as F

from tickloom.llm import quality_rules


def test_url_verdicts_are_those_of_the_contract(spark):
    from tickloom.llm.url_filter import judge_urls

    urls = ["http://net/de/", "http://a.example.net/de/7", "http://example.net/de/81", "http://x.org/es/1", "http://x.com/en/1", "http://example.com/en/70"]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {
        0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("org/es/", "block"), 4: ("com/en/", "block"), 5: ("example.com/en/7", "allow"),
    }


def test_windows_are_sorted_only_where_one_is_there_twice(spark):
    rows = spark.createDataFrame([([5, 3, 9],), ([5, 3, 5],), ([],)], "h array<long>").select(quality_rules._sorted_windows(F.col("h")).alias("s"))
    assert [[tuple(x) for x in r.s] for r in rows.collect()] == [[], [(3, 1), (5, 0), (5, 2)], []]


def test_bucket_hashes_are_the_remainders(spark):
    w = F.split(F.lit("a b c d e"), " ")
    plain = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(quality_rules.BUCKETS)).cast("int"))
    got, want = spark.range(1).select(F.slice(quality_rules._grams(w), 1, 5), plain).first()
    assert got == want
