"""N-gram Jaccard self-join with prefix filters under several global orders.

If two sets have a Jaccard similarity of t, each shares a token among the first n - ceil(t n) + 1 of any order of all
tokens. Texts with one and the same set are one node from the start. Orders come one after the other, each over what the
ones before it left:

1. A hash-drawn part of the tokens first, rare ones before frequent ones, by counts over the corpus: a set whose prefix
   holds only tokens of no other set is out. That leaves near copies and what much resembles them.
2. All tokens of the sets left, rare ones first by counts among these: prefixes are indexed and joined.
3. Two orders by hash: a pair must share prefix tokens under both, and a sketch of the sets must allow the similarity,
   before the sets themselves are compared.

Links only matter up to connected components: every list of sets with a common prefix token is first compared with the
one that has the fewest tokens of its own, and then only pairs are left that aren't in one component yet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, told_apart, whole, written
from tickloom.llm.components import connected
from tickloom.llm.wordhash import mixed, shingles, texts

#: Seeds of the orders by hash.
SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
#: Bits of a set's sketch: bit k is odd if an odd number of the set's tokens fall on it.
SKETCH_BITS = 1024
#: The part of the tokens that the first order counts holds so many times a prefix.
PREFIXES = 2.5
#: Parts into which the rows of one and the same set are dealt where their component is looked up.
SALTS = 16


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefix(num: int, den: int) -> Column:
    return F.expr(f"n + 1 - (({num} * n + {den - 1}) div {den})")


def _own_prefix(num: int, den: int) -> Column:
    """The part of a prefix that suffices for the smaller one of two sets."""
    return F.expr(f"n + 1 - (({2 * num} * n + {num + den - 1}) div {num + den})")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, bytes]]:
    """(batch, row, tokens, digest of the set) of every text in column 0."""
    for b in batches:
        for row, words in texts(b.column(0)):
            tokens = np.unique(shingles(words, size))
            yield b, row, tokens, hashlib.md5(tokens.tobytes()).digest()


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_most: int) -> Iterator[pa.RecordBatch]:
    """Rows of (weight, values...) as record batches of about `at_most` weight."""
    held: list[tuple] = []
    weight = 0
    for w, *row in rows:
        held.append(tuple(row))
        weight += w
        if weight >= at_most:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _summaries(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n and digest of the set (null without words) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((1, b.column(1)[row].as_py(), b.column(2)[row].as_py(), len(tokens), digest if len(tokens) else None) for b, row, tokens, digest in _sets(batches, size))
        yield from _batches(rows, schema, 10_000)

    return docs.select("text", "doc_id", "text_hash").mapInArrow(run, "doc_id long, text_hash long, n long, digest binary")


def _mark(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _marked(rows: DataFrame) -> DataFrame:
    """rows with `mark`, the first 64 bits of their digest."""
    return rows.withColumn("mark", F.expr("cast(conv(hex(substring(digest, 1, 8)), 16, -10) as long)"))


def _drawn_tokens(docs: DataFrame, size: int, every: int) -> DataFrame:
    """token, mark: one token in `every`, the same ones in all sets, with the first 64 bits of the set's digest; a set at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        marks: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (held, marks)], ["token", "mark"])

        weight = 0
        for _, _, tokens, digest in _sets(batches, size):
            if digest in seen:
                continue
            seen.add(digest)
            drawn = tokens[tokens % np.uint64(every) == 0].view(np.int64)
            held.append(drawn)
            marks.append(np.full(len(drawn), _mark(digest)))
            weight += len(drawn)
            if weight > 200_000:
                yield out()
                held, marks, weight = [], [], 0
        if weight:
            yield out()

    return docs.select("text").mapInArrow(run, "token long, mark long")


def _chosen_sets(docs: DataFrame, chosen: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """digest, n, tokens, sketch and prefixes under the orders by hash of the sets of `chosen` (doc_id, digest).

    Only their texts are shuffled. A set may come more than once.
    """
    some, _ = told_apart(docs, F.xxhash64("doc_id"), chosen.select(F.xxhash64("doc_id")))
    some = some.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("tokens", "sketch", "second", "third"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def rows() -> Iterator[tuple]:
            for _, _, tokens, digest in _sets(batches, size):
                n = len(tokens)
                if not n or digest in seen:
                    continue
                seen.add(digest)
                odd = np.bincount((tokens >> np.uint64(32)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
                p = prefix_length(n, num, den)
                orders = [np.sort(mixed(tokens ^ seed))[:p].view(np.int64) for seed in SEEDS]
                yield n, digest, n, tokens.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64), *orders

        yield from _batches(rows(), schema, 200_000)

    found = some.select("text").mapInArrow(run, "digest binary, n long, tokens array<long>, sketch array<long>, second array<long>, third array<long>")
    return found.join(chosen.select("digest").distinct(), "digest", "left_semi")


def _postings(sets: DataFrame, num: int, den: int) -> DataFrame:
    """token, digest, n, unshared, own: those prefix tokens under the order of rare ones first that another set has too.

    `unshared` is the number of the set's tokens that no other one has; `own` says whether the token is in the part of the
    prefix that suffices for the smaller one of two sets.
    """
    sets = _marked(sets)
    rows = sets.select("mark", F.explode("tokens").alias("token"))
    common = rows.groupBy("token").agg(F.count("*").alias("c"), F.min("mark").alias("x"), F.max("mark").alias("y")).where("x != y").select("token", "c")
    shared = rows.join(common, "token").groupBy("mark").agg(F.collect_set(F.struct("c", F.xxhash64("token").alias("h"), "token")).alias("shared"))
    shared = shared.join(sets.select("mark", "digest", "n").distinct(), "mark")
    # All tokens that no other set has come before these.
    shared = shared.withColumn("unshared", F.col("n") - F.size("shared")).withColumn("left", _prefix(num, den) - F.col("unshared")).where("left > 0")
    first = F.slice(F.sort_array("shared"), F.lit(1), F.col("left").cast("int"))
    shared = shared.select("digest", "n", "unshared", (_own_prefix(num, den) - F.col("unshared")).alias("most"), F.posexplode(first).alias("k", "x"))
    return shared.select(F.col("x.token").alias("token"), "digest", "n", "unshared", (F.col("k") < F.col("most")).alias("own"))


def _alike(num: int, den: int) -> Column:
    """Whether lengths and sketches of a and b allow the similarity: two sets differ by as many tokens at least as their sketches by bits."""
    apart = sum((F.bit_count(F.get("a_sketch", F.lit(i)).bitwiseXOR(F.get("b_sketch", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return F.expr(f"{num} * greatest(a_n, b_n) <= {den} * least(a_n, b_n)") & ((num + den) * apart <= (den - num) * (F.col("a_n") + F.col("b_n")))


def _smaller_has_it() -> Column:
    """Whether the common token is one that suffices for the smaller set of a and b, for a if they are of one size."""
    return F.expr("case when a_n <= b_n then a_own else b_own end")


def _first_common() -> Column:
    """Whether no smaller token makes the same pair, so that a pair comes once, however many tokens it shares."""
    common = F.when(F.col("a_n") <= F.col("b_n"), F.array_intersect("a_owned", "b_listed")).otherwise(F.array_intersect("b_owned", "a_listed"))
    return F.col("token") == F.array_min(common)


def _side(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.select(F.col("digest").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under both orders by hash and whose sets are as similar as asked."""
    orders = pairs
    for x in ("a", "b"):
        orders = orders.join(_side(sets, x, "n", "sketch", "second", "third"), x)
    orders = orders.where(_alike(num, den)).where(F.arrays_overlap("a_second", "b_second")).where(F.arrays_overlap("a_third", "b_third"))
    both = written(orders.select("a", "b", "a_n", "b_n").distinct(), "candidates")
    for x in ("a", "b"):
        both = both.join(_side(sets, x, "tokens"), x)
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return both.where(den * shared >= num * (F.col("a_n") + F.col("b_n") - shared)).select("a", "b").distinct()


def _classes(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, text_hash, n and digest of every row; digest, least, copies and component of every set."""
    rows = written(_summaries(docs, size), "summaries")
    named = rows.where("digest is not null and doc_id is not null")
    classes = written(named.groupBy("digest", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")

    # The first order.
    every = max(1, int(den / (PREFIXES * (den - num))))
    drawn = _drawn_tokens(docs.where("doc_id is not null"), size, every)
    single = drawn.groupBy("token").agg(F.min("mark").alias("mark"), F.max("mark").alias("other")).where("mark = other")
    single = single.groupBy("mark").agg(F.count("*").alias("single"))
    left = _marked(classes).join(single, "mark", "left").where(_prefix(num, den) > F.coalesce("single", F.lit(0)))
    chosen = written(left.select(F.col("least").alias("doc_id"), "digest"), "chosen")

    # The second one.
    sets = written(_chosen_sets(docs, chosen, size, num, den), "sets")
    posted = written(_postings(sets, num, den), "postings")
    # A list's hub is the set with the fewest tokens of its own: what copies were made of has none.
    hubs = posted.groupBy("token").agg(F.min(F.struct("unshared", "digest", "n", "own")).alias("hub"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high")
    star = posted.join(hubs, "token").where("digest != hub.digest")
    star = star.select(F.col("hub.digest").alias("a"), F.col("hub.n").alias("a_n"), F.col("hub.own").alias("a_own"), F.col("digest").alias("b"), F.col("n").alias("b_n"), F.col("own").alias("b_own"))
    star = star.where(_smaller_has_it()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(_links(star, sets, num, den), "links")
    parts = written(connected(links), "components")

    # What is left: pairs of one list that aren't in one component.
    members = posted.join(parts.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    several = members.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x != y and c > 2")
    members = members.join(several.select("token"), "token", "left_semi").join(sets.select("digest", "sketch").dropDuplicates(["digest"]), "digest")
    tokens = members.groupBy("digest").agg(F.collect_set("token").alias("listed"), F.collect_set(F.when(F.col("own"), F.col("token"))).alias("owned"))
    members = written(members.join(tokens, "digest"), "members")
    sides = [members.select("token", *[F.col(c).alias(f"{x}_{c}" if c != "digest" else x) for c in ("digest", "n", "own", "component", "sketch", "listed", "owned")]) for x in ("a", "b")]
    rest = sides[0].join(sides[1], "token").where(F.expr("a < b and a_component != b_component") & _smaller_has_it() & _alike(num, den) & _first_common())
    rest = rest.select("a", "b").join(star, ["a", "b"], "left_anti")
    more = written(_links(rest, sets, num, den), "links")
    if not more.isEmpty():
        # Components of components.
        for x in ("a", "b"):
            at = parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component"))
            more = more.join(at, x, "left").withColumn(f"{x}_component", F.coalesce(f"{x}_component", x))
        joined = connected(more.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
        joined = written(joined.select(F.col("node").alias("component"), F.col("component").alias("into")), "components")
        alone = joined.join(parts.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("into").alias("component"))
        parts = parts.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component")).unionByName(alone)
    # A component goes by its smallest doc_id.
    found = classes.join(parts.withColumnRenamed("node", "digest"), "digest", "left").withColumn("part", F.coalesce("component", "digest")).drop("component")
    least = found.where("digest != part").groupBy("part").agg(F.min("least").alias("low"))
    tops = found.where("digest = part").join(least, "part", "left").select("part", F.least("least", "low").alias("component"))
    return rows, written(found.join(tops, "part").select("digest", "least", "copies", "component"), "classes")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"), F.xxhash64(whole(text_col)).alias("text_hash"))


def _placed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with least and component of their set, where it has copies or links; a set of many rows is dealt over many tasks."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    known = classes.where("copies > 1 or component != least").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(known.select("digest", "salt", "least", "component"), ["digest", "salt"], "left").drop("salt")


def ngram_join(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links documents whose sets of `size`-word shingles have a Jaccard similarity of num / den or more.

    Returns doc_id, n_shingles and component_id, the smallest id reachable by links. Words are runs of characters that
    aren't ASCII white space, A-Z like a-z; with fewer words the whole sequence is the one shingle. Null and empty texts
    have no shingle and no link; a null id has a null component and no link; rows are documents of their own, so those of
    one id are linked by their texts only, and reported each; an empty table gives an empty result. Only id and text are
    read, so other columns may clash. Tokens are 64-bit hashes.
    """
    rows, classes = _classes(_rows(docs, id_col, text_col), size, num, den)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return _placed(rows, classes).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def first_of_each(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, that of the smallest id, of each group that ngram_join links; all columns stay.

    Rows without an id or without words stay. Where the smallest id has several rows in the group, one text stays, that
    of the lowest hash, and of its rows the one whose columns come first as JSON. An empty table gives an empty result;
    columns may have any names. Only rows that may go are shuffled.
    """
    rows, classes = _classes(_rows(docs, id_col, text_col), size, num, den)
    placed = _placed(rows.where("digest is not null and doc_id is not null"), classes).where("component is not null")
    placed = placed.groupBy("doc_id", "text_hash", "component").agg(F.count("*").alias("times"))
    # Of each component, one text of the smallest id stays.
    stays = placed.where("doc_id = component").groupBy("component").agg(F.min("text_hash").alias("text_hash")).select(F.col("component").alias("doc_id"), "text_hash", F.lit(True).alias("stays"))
    placed = written(placed.join(stays, ["doc_id", "text_hash"], "left").select(F.struct("doc_id", "text_hash").alias("key"), F.coalesce("stays", F.lit(False)).alias("stays"), "times"), "placed")
    gone, again = placed.where("not stays"), placed.where("stays and times > 1")
    texts_ = F.xxhash64(whole(text_col))
    key, known = F.struct(F.col(id_col).cast("long").alias("doc_id"), texts_.alias("text_hash")), fresh(docs, "known")
    some, rest = told_apart(docs, F.xxhash64(F.col(id_col).cast("long"), texts_), gone.unionByName(again).select(F.xxhash64("key.doc_id", "key.text_hash")))
    # Null ids have no key there.
    some = some.join(gone.select(F.col("key").alias(known)), key == F.col(known), "left_anti")
    repeated = some.join(again.select(F.col("key").alias(known)), key == F.col(known), "left_semi")
    some = some.join(again.select(F.col("key").alias(known)), key == F.col(known), "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = repeated.groupBy(key.alias("key")).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return rest.unionByName(some).unionByName(repeated)
