"""Secret scans with corpus-wide ownership frequency.

Patterns find secrets in every text. A wider pattern proposes random-looking tokens besides; the hashes of all
candidates are counted by distinct repositories and owners over the corpus. A proposal held by few repositories of a
single owner looks live and is added to the spans; what many owners or many repositories hold is a widely copied example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, told_apart, whole, written

#: Fixed values. The keyword is taken in either case.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
#: Proposals: long tokens that mix letters with digits.
PROPOSED = r"([A-Za-z0-9+_-]{20,})"
KINDS = ("assign", "access", "hex", "owned")
#: Owners and repositories that a live value has at most.
MOST_OWNERS, MOST_REPOSITORIES = 1, 8
#: Parts into which the rows of one value are dealt where its counts are looked up.
SALTS = 16
SPAN = "array<struct<start:int,kind:int,end:int,value:string,base:boolean>>"


def _found(t: Column, kind: int, pattern: str, least: int) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches whose group 1 has `least` characters or more."""
    gaps = F.transform(F.split(t, pattern, -1), lambda g: F.length(g))
    whole_match, value = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    parts = F.transform(F.arrays_zip(whole_match.alias("m"), value.alias("v")), lambda x, i: F.struct(F.length(x["m"]).alias("n"), x["v"].alias("v")))
    steps = F.zip_with(parts, gaps, lambda p, g: F.struct(g.alias("gap"), p["n"].alias("n"), p["v"].alias("v")))
    steps = F.filter(steps, lambda x: x["n"].isNotNull())
    empty = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["n"]).alias("end"), x["v"].alias("value"), F.lit(kind < 3).alias("base"))
        return F.struct((start + x["n"]).alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(t.rlike(pattern), spans).otherwise(empty)


def _candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """doc_id, text_hash, owner and spans of the documents that have any."""
    t = F.col("t")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), whole(text_col).alias("t"))
    rows = rows.where(t.rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{PROPOSED}"))
    base = F.concat(_found(t, 0, ASSIGN, 6), _found(t, 1, ACCESS, 20), _found(t, 2, HEX, 24))
    rows = rows.select("doc_id", "owner", F.xxhash64("t").alias("text_hash"), base.alias("base"), _found(t, 3, PROPOSED, 20).alias("more"))
    base, more = F.col("base"), F.col("more")
    mixed = F.filter(more, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    apart = F.filter(mixed, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.select("doc_id", "owner", "text_hash", F.concat(base, apart).alias("spans")).where(F.size("spans") > 0)


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    most_owners: int = MOST_OWNERS,
    most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """Per document with candidates: doc_id, text_hash and `found`, its sorted spans (start, kind, end, live, base).

    A document is a repository and its source the owner; a null source counts as an owner. `live` says of every span
    whether its value has at most `most_owners` owners and `most_repositories` repositories. Spans of base kinds are
    always there, proposals only if they look live. A null text is empty; repeated rows come once and count as one
    repository; an empty table gives an empty result. Texts are searched once and not shuffled.
    """
    spans = written(_candidates(docs, id_col, text_col, owner_col), "candidates").select("doc_id", "text_hash", "owner", F.explode("spans").alias("s"))
    spans = spans.select("doc_id", "text_hash", "owner", "s", F.sha2(F.col("s.value"), 256).alias("hash"))
    # By distinct repositories, then owners: each step is summed before it is shuffled.
    held = spans.groupBy("hash", "owner", "doc_id", "text_hash").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    # A value without a row here has one owner and one repository.
    held = held.where("repositories > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = spans.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")).join(held, ["hash", "salt"], "left").na.fill(1, ["owners", "repositories"])
    spans = spans.withColumn("live", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))
    spans = spans.where(F.col("s.base") | F.col("live"))
    found = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "live", F.col("s.base").alias("base"), "owners", "repositories")
    return spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(found)).alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """All documents with what was found in them.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live and n_example. A null text is an empty
    one; null ids and owners count as values; repeated rows are reported each; an empty table gives an empty result.
    """
    found = secret_spans(docs, id_col, text_col, owner_col).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "found")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("text_hash"))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["text_hash"] == found["h"]), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,base:boolean,owners:bigint,repositories:bigint>>")
    rows = rows.select("doc_id", F.coalesce("found", none).alias("found"))
    found = F.col("found")
    count = lambda f: F.size(F.filter(found, f)).cast("long")
    of_kind = lambda k: count(lambda x: x["kind"] == k)
    return rows.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(F.filter(found, lambda x: x["base"])), 256).alias("base_sha256"),
        _joined(found).alias("spans"),
        count(lambda x: x["kind"] == 3).alias("n_owned"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_example"),
    )


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of every text replaced by the mark; overlapping spans get one mark.

    All rows and columns stay, whatever their names; a null text stays null, null ids and owners count as values, rows
    alike are changed alike, an empty table gives an empty result. Only rows that may hold a span are shuffled.
    """
    key, known, held = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("text_hash")), fresh(docs, "known"), fresh(docs, "held")
    found = written(secret_spans(docs, id_col, text_col, owner_col).select(F.struct("doc_id", "text_hash").alias(known), F.col("found").alias(held)), "spans")
    some, rest = told_apart(docs, F.xxhash64(F.col(id_col), F.xxhash64(whole(text_col))), found.select(F.xxhash64(F.col(f"{known}.doc_id"), F.col(f"{known}.text_hash"))))
    t = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        upto = F.substring(t, acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        new = F.concat(acc["out"], upto, F.when(x["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), new.alias("out"))

    clean = F.aggregate(held, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    some = some.join(found, key == F.col(known), "left").withColumn(text_col, F.when(F.col(held).isNotNull(), clean).otherwise(t))
    return rest.unionByName(some.select(*[F.col(f"`{c}`") for c in docs.columns]))
