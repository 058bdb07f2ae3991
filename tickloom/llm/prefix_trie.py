"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of first turns; conversations that start with it are its members, and its smallest member
owns it. Down a conversation's path the members only get fewer, so what a conversation owns is a suffix of its path, and
every node has one owner. What is saved below a node is then a sum over its members alone: the words of a member's turns
from the node on, minus those it owns. So are the leaves: a member counts one if it owns a childless node. Nodes are never
walked: one group-by of all prefixes gives owners, a second one the sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES, whole, written

#: Turns of one conversation that are numbered or summed in one group; longer ones are dealt over several. A power of two.
BLOCK_BITS = 12
#: Members whose ids are joined in one group, by ranges of ids.
ENDS_BITS = 12
NODE = ("depth", "p", "q")


def _words(text: Column) -> Column:
    """How many words; without making an array of them twice."""
    parts = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACES)
    return F.when(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == "", 0).otherwise(F.size(parts)).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_key and words of every turn, texts left behind.

    Turns stand in order of `turn`, null first; of one number they go by role and then by the md5 of the text. Equal
    rows are counted before they are shuffled; a long conversation is numbered in blocks of turn numbers whose sizes are summed up.
    """
    role, text = whole("role"), whole("text")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.concat(role, F.lit(" "), F.md5(text.cast("binary"))).alias("tie"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_key"),
        _words(text).alias("words"),
    )
    rows = rows.groupBy("conv_id", "turn", "tie", "turn_key", "words").agg(F.count("*").alias("times"))
    rows = rows.withColumn("block", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62))))
    within = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "tie", "turn_key").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("last", F.sum("times").over(within))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("times").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("conv_id", "block", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    rows = rows.join(blocks, ["conv_id", "block"])
    first = F.col("ahead") + F.col("last") - F.col("times") + 1
    return rows.select("conv_id", F.explode(F.sequence(first, first + F.col("times") - 1)).alias("pos"), "turn_key", "words")


def grafted(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(ids, turns) of rebuilt conversations: conversation c gets the first h turns of c - c % every for its own first h.

    h is crc32 of the decimal id modulo `most`, so at most `most` - 1 turns of each base are copied, to fewer than `every` others.
    """
    ids = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    ids = ids.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)))
    ids = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    length = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    ids = ids.join(length, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    ids = written(ids.select("conv_id", "base", "h", "taken"), "trie-ids")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    copied = ids.join(heads, "base").where("pos <= h").select("conv_id", "pos", "turn_key", "words")
    own = turns.join(ids, "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "words")
    return ids.select("conv_id"), copied.unionByName(own)


def paths(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, p, q, up_p, up_q, words and before of every prefix of every conversation, the empty one included.

    p and q are two 64-bit hashes of the first `depth` turns: the exclusive or of a hash of each turn and its place, which
    blocks of a long conversation can sum up apart. up_p and up_q are those of the prefix one turn shorter, `before` the
    words of all turns before the last.
    """
    rows = turns.select(
        "conv_id",
        F.col("pos").alias("depth"),
        "words",
        F.xxhash64("pos", "turn_key").alias("x"),
        F.xxhash64("turn_key", "pos", F.lit("second")).alias("y"),
        F.shiftright("pos", BLOCK_BITS).alias("block"),
    )
    sums = (F.bit_xor("x"), F.bit_xor("y"), F.sum("words"))
    within = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({k: s.over(within) for k, s in zip(("rx", "ry", "rw"), sums, strict=True)})
    blocks = rows.groupBy("conv_id", "block").agg(*[s.alias(k) for k, s in zip(("bx", "by", "bw"), sums, strict=True)])
    ahead = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("conv_id", "block", *[F.coalesce(s.over(ahead), zero).alias(k) for k, s in (("ax", F.bit_xor("bx")), ("ay", F.bit_xor("by")), ("aw", F.sum("bw")))])
    rows = rows.join(blocks, ["conv_id", "block"])
    p, q = F.col("rx").bitwiseXOR(F.col("ax")), F.col("ry").bitwiseXOR(F.col("ay"))
    rows = rows.select(
        "conv_id",
        "depth",
        p.alias("p"),
        q.alias("q"),
        p.bitwiseXOR(F.col("x")).alias("up_p"),
        q.bitwiseXOR(F.col("y")).alias("up_q"),
        "words",
        (F.col("aw") + F.col("rw") - F.col("words")).alias("before"),
    )
    tops = ids.select("conv_id", *[zero.alias(c) for c in ("depth", "p", "q")], *[F.lit(None).cast("long").alias(c) for c in ("up_p", "up_q")], zero.alias("words"), zero.alias("before"))
    return tops.unionByName(rows)


def _digests(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of its ending members' ids, ascending.

    Ids are joined by ranges of ids, so no group holds more than a range; a node's ranges are then hashed one after the
    other as they stream by, none held.
    """
    parts = ends.groupBy(*NODE, F.shiftright("conv_id", ENDS_BITS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for b in batches:
            for *at, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if at == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                state.update(ids.encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*NODE, "ends"])
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*NODE, "ends"])

    parts = parts.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "range", "ids")
    return parts.mapInArrow(run, "depth long, p long, q long, ends string")


def trie_nodes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """The prefix trie of conversations: ids (conv_id, one row each) and their turns (conv_id, pos from 1, turn_key, words).

    Returns a row per node: conv_id (the owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Conversations without turns are members of the root. Without ids there is no node.
    """
    rows = written(paths(ids, turns), "trie-paths")
    # Owners: the first group-by over all prefixes.
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("up_p", "up_q", "words")])
    nodes = written(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    # What each conversation owns of its path; a conversation that owns none has a smaller one's path, or a part of it.
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("words").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole_ = rows.groupBy("conv_id").agg(F.sum("words").alias("all"), F.max("depth").alias("last"))
    of = whole_.join(owned, "conv_id", "left").select("conv_id", "last", (F.col("all") - F.coalesce("owned", F.lit(0))).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marked = rows.join(of, "conv_id")
    # The second group-by: the shared part of a path from the node on, and leaves.
    sums = marked.groupBy(*NODE).agg(F.sum(F.greatest(F.lit(0), F.col("shared") - F.col("before"))).alias("saved"), F.sum("leaf").alias("n_leaves"))
    ends = _digests(marked.where("depth = last").select(*NODE, "conv_id"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("owner").alias("parent"))
    out = nodes.join(sums, list(NODE)).join(ends, list(NODE), "left")
    out = out.join(above, ["depth", "up_p", "up_q"], "left")
    return out.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The prefix trie of rebuilt conversations: each has the first turns of another for its own first ones.

    Rows without conv_id take no part; a null role or text counts as an empty one and a null turn comes first; turns of
    one number go by role and the md5 of the text, repeated rows are turns each; an empty table gives no node. Other
    columns are not read.
    """
    turns = written(ordered_turns(conversations), "trie-turns")
    return trie_nodes(*grafted(turns, every, most))
