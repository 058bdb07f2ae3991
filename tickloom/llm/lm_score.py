"""Scores by a log-bilinear language model trained with noise-contrastive estimation.

The model predicts the next token from the two before it, in two steps: a node, then a class of that node; frequent words
are classes of their own, the others are dealt by hash over the tail classes, within which a word has its add-one share of
the class's counts. The number of classes grows with the vocabulary up to a bound, and counts are those of all training
tokens. Every partition trains on its own documents, minibatches against noise words drawn node by node, and the
parameters are averaged after each round; each token of each training document is used once. Scores are exactly
normalised: batched matrix products give the scores of all nodes, and of all classes of the node a token is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import whole, written
from tickloom.llm.wordhash import texts

#: Nodes, and classes of a node, at most: that bounds the model, not the vocabulary.
MOST_NODES = 64
#: Words of the vocabulary for each class.
WORDS_A_CLASS = 8
WIDTH = 16
#: Words whose counts are broadcast; the others' are joined.
HOT = 1 << 17
BATCH, NOISE, NODE_NOISE, RATE, ROUNDS = 8192, 32, 16, 0.1, 2
END = 0


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for row, h in texts(batch.column(1)):
            yield row, h.view(np.int64), batch


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, count: words, summed over some megabytes at a time."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], ["hash", "count"])

    for _, h, _ in _words(batches):
        held.append(h)
        size += len(h)
        if size > 2_000_000:
            yield out()
            held, size = [], 0
    if size:
        yield out()


class Classes:
    """The classes of words: 0 is the end of a text, then come frequent words by falling count, then the tail, by hash.

    Class k belongs to node k % nodes.
    """

    def __init__(self, vocabulary: int, words: np.ndarray, counts: np.ndarray) -> None:
        """words: the hashes of the most frequent ones, by falling count."""
        self.nodes = int(np.clip(np.ceil(np.sqrt(vocabulary / WORDS_A_CLASS)), 4, MOST_NODES))
        self.number = self.nodes**2
        self.tail = self.number // 4
        self.own = min(len(words), self.number - self.tail - 1)
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.classes = np.where(order < self.own, order + 1, self.of_tail(self.words))

    def of_tail(self, h: np.ndarray) -> np.ndarray:
        return self.number - self.tail + h % self.tail

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count) of each word, count 0 where it isn't among the most frequent ones."""
        if not len(self.words):
            return self.of_tail(h), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        return np.where(hit, self.classes[at], self.of_tail(h)), np.where(hit, self.counts[at], 0)


def start(shares: np.ndarray, nodes: int) -> dict[str, np.ndarray]:
    """Parameters from which the model predicts the shares of the classes whatever the context."""
    rng = np.random.default_rng(6)
    some = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
    of_node = np.bincount(np.arange(len(shares)) % nodes, shares)
    within = shares / of_node[np.arange(len(shares)) % nodes]
    return {
        "first": some(len(shares)), "second": some(len(shares)), "node": some(nodes), "out": some(len(shares)),
        "node_bias": np.log(of_node).astype(np.float32), "bias": np.log(within).astype(np.float32),
    }


def _spread(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    order = np.argsort(index, kind="stable")
    sorted_index = index[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_index[1:] != sorted_index[:-1]]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[sorted_index[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _pull(score: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(score)), without overflow."""
    return 1 / (1 + np.exp(np.clip(score, -60, 60)))


def train(p: dict[str, np.ndarray], shares: np.ndarray, nodes: int, classes: Iterator[np.ndarray], seed: int) -> int:
    """Noise-contrastive steps over texts given as classes, each ending in END; p changes in place. Returns the tokens seen.

    All tokens of a minibatch have their noise nodes in common, those of a node their noise classes, so that noise scores
    are matrix products. The last minibatch may be smaller and then weighs less.
    """
    rng = np.random.default_rng(seed)
    n = len(shares)
    of_node = np.bincount(np.arange(n) % nodes, shares)
    edges = np.cumsum(of_node)
    within = [shares[k::nodes] / of_node[k] for k in range(nodes)]
    inner = [np.cumsum(x) for x in within]
    squares = {k: np.full_like(v, 1e-4) for k, v in p.items()}
    seen = 0

    def contrast(context: np.ndarray, out: np.ndarray, bias: np.ndarray, q: np.ndarray, word: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, ...]:
        """Derivatives of -log s(good) - sum log(1 - s(bad)): by context, by each good score, by each noise row of out, and by each noise score summed."""
        offset = np.log(len(noise) * q).astype(np.float32)
        target, other = out[word], out[noise]
        g = -_pull((context * target).sum(1) + bias[word] - offset[word])
        b = _pull(-(context @ other.T + (bias - offset)[noise]))
        return g[:, None] * target + b @ other, g, b.T @ context, b.sum(0)

    def step(text: np.ndarray) -> None:
        word, one, two = text[2:], text[1:-1], text[:-2]
        context = p["first"][one] + p["second"][two]
        at = word % nodes
        noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), nodes - 1)
        to_context, g, rows, sums = contrast(context, p["node"], p["node_bias"], of_node, at, noise)
        grad = {"node": _spread(at, g[:, None] * context, nodes), "node_bias": np.bincount(at, g, nodes) + np.bincount(noise, sums, nodes)}
        np.add.at(grad["node"], noise, rows)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(nodes + 1))
        goods = np.zeros(len(word), np.float32)
        extra, extra_bias = np.zeros((n, WIDTH), np.float32), np.zeros(n)
        for k in np.flatnonzero(np.diff(bounds)):
            mine = order[bounds[k] : bounds[k + 1]]
            drawn = np.minimum(np.searchsorted(inner[k], rng.random(NODE_NOISE)), len(inner[k]) - 1)
            more, g, rows, sums = contrast(context[mine], p["out"][k::nodes], p["bias"][k::nodes], within[k], word[mine] // nodes, drawn)
            to_context[mine] += more
            goods[mine] = g
            np.add.at(extra, drawn * nodes + k, rows)
            np.add.at(extra_bias, drawn * nodes + k, sums)
        grad["out"] = _spread(word, goods[:, None] * context, n) + extra
        grad["bias"] = np.bincount(word, goods, n) + extra_bias
        grad["first"], grad["second"] = _spread(one, to_context, n), _spread(two, to_context, n)
        for k, d in grad.items():
            d = (d / BATCH).astype(np.float32)
            squares[k] += d * d
            p[k] -= RATE * d / np.sqrt(squares[k])

    held, size = [np.full(2, END)], 0
    for text in classes:
        held.append(text)
        size += len(text)
        while size >= BATCH:
            joined = np.concatenate(held)
            step(joined[: BATCH + 2])
            seen += BATCH
            held, size = [joined[BATCH:]], size - BATCH
    if size:
        step(np.concatenate(held))
        seen += size
    return seen


def _log_total(scores: np.ndarray) -> np.ndarray:
    most = scores.max(1)
    return most + np.log(np.exp(scores - most[:, None]).sum(1))


def log_probabilities(p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log of the probability of each class `word` after the classes one and, before it, two."""
    nodes = len(p["node"])
    out = np.empty(len(word), np.float64)
    for lo in range(0, len(word), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        context, at = p["first"][one[part]] + p["second"][two[part]], word[part] % nodes
        scores = context @ p["node"].T + p["node_bias"]
        logs = scores[np.arange(len(at)), at] - _log_total(scores)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(nodes + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            mine = order[bounds[k] : bounds[k + 1]]
            scores = context[mine] @ p["out"][k::nodes].T + p["bias"][k::nodes]
            logs[mine] += scores[np.arange(len(mine)), word[part][mine] // nodes] - _log_total(scores)
        out[part] = logs
    return out


def text_scores(p: dict[str, np.ndarray], texts_: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each text given as classes, END last; two END stand before it."""
    sizes = [len(x) for x in texts_]
    word = np.concatenate(texts_)
    first = np.cumsum([0, *sizes[:-1]])
    one, two = np.roll(word, 1), np.roll(word, 2)
    one[first] = two[first] = END
    second = first[np.array(sizes) > 1] + 1
    two[second] = END
    return np.add.reduceat(log_probabilities(p, one, two, word), first) / np.log(10)


def score_texts(docs: DataFrame, held_out: int = 2, of: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text; the model learns from those whose crc32(id as text) mod `of` isn't `held_out`.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (add-one unigram) and score,
    the model's log10 probability. A null or empty text is the end alone; a null id counts as an empty text there;
    repeated rows are scored each; an empty table gives an empty result. Only id and text are read.
    """
    spark = docs.sparkSession
    mod = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(of))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"), (mod == held_out).alias("held_out"), mod.alias("part"))
    learned = rows.where(~F.col("held_out"))
    counts = learned.mapInArrow(lambda b: _counted(b.select(["doc_id", "text"]) for b in b), "hash long, count long")
    counts = written(counts.groupBy("hash").agg(F.sum("count").alias("count")), "counts")
    ends = learned.count()
    sums = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    all_tokens, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    top = counts.orderBy(F.desc("count"), "hash").limit(HOT).toArrow()  # HOT rows at most
    top = top.take(np.lexsort((top.column(0).to_numpy(), -top.column(1).to_numpy())))
    hot = Classes(sums["v"], top.column(0).to_numpy(), top.column(1).to_numpy())
    # Of each tail class, the counts and the number of its words: a row for each class.
    tail = counts.groupBy((F.lit(hot.number - hot.tail) + F.pmod("hash", F.lit(hot.tail))).alias("class")).agg(F.sum("count").alias("n"), F.count("*").alias("v"))
    of_class, of_words = np.zeros(hot.number), np.zeros(hot.number)
    for x in tail.collect():
        of_class[x["class"]], of_words[x["class"]] = x["n"], x["v"]
    own, own_counts = top.column(0).to_numpy()[: hot.own], top.column(1).to_numpy()[: hot.own]
    np.subtract.at(of_class, hot.of_tail(own), own_counts)
    np.subtract.at(of_words, hot.of_tail(own), 1)
    of_class[1 : 1 + hot.own] = own_counts
    of_class[END] = ends
    shares = (of_class + 1) / (of_class.sum() + hot.number)
    # In a tail class there is one unknown word more: add-one shares of its words sum to 1.
    log_sizes = np.zeros(hot.number)
    log_sizes[hot.number - hot.tail :] = np.log10((of_class + of_words + 1)[hot.number - hot.tail :])
    shared = spark.sparkContext.broadcast(hot)

    p = start(shares, hot.nodes)
    names = list(p)
    shapes = [p[k].shape for k in names]
    for turn in range(ROUNDS):
        told = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            mine = {k: v.copy() for k, v in told.value.items()}
            classes = (np.append(shared.value.find(h)[0], END) for _, h, _ in _words(b.select(["doc_id", "text"]) for b in batches))
            weight = train(mine, shares, hot.nodes, classes, TaskContext.get().partitionId())
            flat = np.concatenate([mine[k].ravel() for k in names]).astype(np.float64) * weight
            if weight:
                n = len(flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(flat), pa.array(np.full(n, float(weight)))], ["i", "x", "w"])

        # As many rows come to the driver as the model has parameters.
        chosen = learned.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn)
        means = chosen.mapInArrow(run, "i long, x double, w double").groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).toArrow()
        if means.num_rows:
            flat = np.empty(means.num_rows, np.float32)
            flat[means.column(0).to_numpy()] = means.column(1).to_numpy()
            cuts = np.cumsum([int(np.prod(x)) for x in shapes])[:-1]
            p = {k: x.reshape(shape) for k, x, shape in zip(names, np.split(flat, cuts), shapes, strict=True)}

    model = spark.sparkContext.broadcast(p)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, sum_known double, sum_tail double, score double, rare array<long>, times array<long>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            held: list[np.ndarray] = []
            scores: list[np.ndarray] = []
            size = 0
            for row, h, _ in _words(iter([batch.select(["doc_id", "text"])])):
                classes, n = shared.value.find(h)
                rare, times = np.unique(h[n == 0], return_counts=True)
                in_tail = classes >= shared.value.number - shared.value.tail
                values = (
                    k + row, len(h) + 1, int((n > 0).sum()) + (ends > 0), float(np.log10(n[n > 0] + 1.0).sum()) + np.log10(ends + 1.0),
                    float(np.log10(n[in_tail] + 1.0).sum() - log_sizes[classes].sum()), rare, times.astype(np.int64), None,
                )
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                held.append(np.append(classes, END))
                size += len(h) + 1
                if size > 1 << 18:
                    scores.append(text_scores(model.value, held))
                    held, size = [], 0
            if held:
                scores.append(text_scores(model.value, held))
            k += batch.num_rows
            out[7] = np.concatenate(scores) if scores else []
            rows_, n_tokens, n_known, known, tails, rare, times, scored = out
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(x, t) for x, t in zip((rows_, n_tokens, n_known, known, tails, scored, rare, times), kinds, strict=True)]
            columns[1:1] = [batch.column(0), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    scored = written(rows.select("doc_id", "text", "held_out").mapInArrow(score, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("hash"), F.col("x.times").alias("times"))
    found = rare.join(counts, "hash").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("sum_more"))
    out = scored.drop("rare", "times").join(found, "row", "left").na.fill(0, ["more", "sum_more"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(int(all_tokens)).cast("long").alias("train_tokens"),
        (F.col("sum_known") + F.col("sum_more") - F.col("n_tokens") * F.lit(float(np.log10(all_tokens + distinct + 1)))).alias("base_score"),
        # Words beyond the most frequent ones are all in the tail.
        (F.col("score") + F.col("sum_tail") + F.col("sum_more")).alias("score"),
    )
