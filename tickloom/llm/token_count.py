"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer.

A text falls into pieces at places that a few neighbouring characters decide. Within a piece the tokenization of every
prefix ends in one token, and which one follows from the tokens at which the places stood where a token may have begun
that is still open. Those places, with the counts of tokens since, are a state; reading a byte leads to another state
and changes the count of tokens by a fixed amount. States and transitions are compiled when first met and kept by the
worker, as regular-expression engines do, and the store starts anew when it is full.

Texts are cut into chunks that run side by side. A chunk's map from entry state to exit state and count is constant if
a piece begins in it; the prefix scan composes the maps, so that every chunk's head, the part before its first
piece, is run from the state the chunks before it lead to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import whole

#: Bytes of a chunk, and characters looked at together.
CHUNK = 512
BLOCK = 1 << 22
#: States kept.
STATES = 1 << 17
#: Tokens that go on from a place, up to which it is known which of them fit.
FEW = 64
LETTER, NUMBER, SPACE, WHITE, OTHER, NEW = range(6)
_BIAS = 64  # a transition is the next state * 128 + the change of the count + 64


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """The compiled part of the tokenizer; tokens go by their ids, of which a lower one was merged earlier."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        letters = _byte_letters()
        self.special = [x["content"] for x in said["added_tokens"]]
        vocabulary = said["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        order = {c: k for k, c in enumerate(letters)} | {a + b: len(letters) + k for k, (a, b) in enumerate(merges)}
        self.joins = {(order[a], order[b]): order[a + b] for a, b in merges}
        self.halves = [(k, k) for k in range(len(letters))] + [(order[a], order[b]) for a, b in merges]
        self.whole: dict[int, bool] = {}
        self.bytes_of = {letters[c]: k for c, k in order.items() if len(c) == 1}
        # A trie of the tokens: node 0 is the empty text.
        self.next: list[dict[int, int]] = [{}]
        self.token = [-1]
        below: list[list[int]] = [[]]
        for text, k in order.items():
            if text not in vocabulary:
                raise ValueError(f"a merge makes {text!r}, which is no token")
            node = 0
            for c in text:
                below[node].append(k)
                node = self.next[node].setdefault(letters[c], len(self.next))
                if node == len(self.token):
                    self.next.append({})
                    self.token.append(-1)
                    below.append([])
            self.token[node] = k
        #: Tokens that go on from a node, where they are few.
        self.below = [x if len(x) <= FEW else None for x in below]
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.kinds = np.full(0x110000, NEW, np.uint8)
        self.kinds[ord(" ")] = SPACE
        self.restart()

    def restart(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full((1024, 256), -1, np.int32)
        self.left: dict[tuple, tuple[int, ...] | int] = {}
        self.state(((0, -1, 0),))

    def state(self, state: tuple) -> int:
        if (k := self.ids.get(state)) is None:
            k = self.ids[state] = len(self.states)
            self.states.append(state)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return k

    def is_whole(self, token: int) -> bool:
        """Whether the token's own bytes come out as that token."""
        if (yes := self.whole.get(token)) is None:
            a, b = self.halves[token]
            yes = self.whole[token] = a == b == token or self.is_whole(a) and self.is_whole(b) and self.apart(a, b, token)
        return yes

    def apart(self, one: int, two: int, until: int = 1 << 60) -> bool:
        """Whether no merge before the token `until` joins the end of one with the beginning of two.

        Both are taken apart, the one that was merged last first; a pair of parts that meet would be joined if that
        comes before the merge by which either part grew on.
        """
        while True:
            joined = self.joins.get((one, two), until)
            if joined < until:
                return False
            if one > two:
                until, one = one, self.halves[one][1]
                if one == until:
                    return True
            else:
                # On equal terms the left merge goes first.
                until, first = two + 1, self.halves[two][0]
                if first == two:
                    until, second = one, self.halves[one][1]
                    if second == one:
                        return True
                    one = second
                else:
                    two = first

    def fits(self, before: int, token: int) -> bool:
        """Whether the token stays whole after that one; before is -1 where a piece begins."""
        return self.is_whole(token) and (before < 0 or self.apart(before, token))

    def narrowed(self, node: int, allowed: int | tuple[int, ...]) -> int | tuple[int, ...]:
        """What a place needs to know at a node: the token before it, or where few tokens go on, which of them fit."""
        few = self.below[node]
        if few is None:
            return allowed
        if (known := self.left.get((node, allowed))) is None:
            fit = (t for t in few if (self.fits(allowed, t) if isinstance(allowed, int) else t in allowed))
            known = self.left[node, allowed] = tuple(fit)
        return known

    def compile(self, k: int, byte: int) -> int:
        """The transition: open places go on if a token may still begin there; one of them closes the last token."""
        places, change, last = [], None, -1
        for node, allowed, since in self.states[k]:
            node = self.next[node].get(byte, -1)
            if node < 0:
                continue
            token = self.token[node]
            if change is None and token >= 0 and (self.fits(allowed, token) if isinstance(allowed, int) else token in allowed):
                change, last = 1 - since, token
            if (left := self.narrowed(node, allowed)) != ():
                places.append((node, left, since))
        if change is None or not -_BIAS < change < _BIAS:
            raise ValueError("the tokens of a vocabulary must be made by its merges")
        to = self.state((*((n, x, d + change) for n, x, d in places), (0, last, 0)))
        self.table[k, byte] = to * 128 + change + _BIAS
        return int(self.table[k, byte])

    def step(self, state: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = state * 256 + data
        found = self.table.ravel()[at]
        if len(found) and found.min() < 0:
            for x in np.unique(at[found < 0]).tolist():
                self.compile(x >> 8, x & 255)
            found = self.table.ravel()[at]
        return found >> 7, ((found & 127) - _BIAS).astype(np.int8)

    def begins(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where a piece begins. points: code points of texts on end; first: where a text begins."""
        kind = self.kinds[points]
        if (kind == NEW).any():
            for p in np.unique(points[kind == NEW]).tolist():
                c = chr(p)
                self.kinds[p] = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.split(x + c)) == 1), WHITE)
            kind = self.kinds[points]
        n = len(points)
        blank = (kind == SPACE) | (kind == WHITE)
        before, after = np.empty_like(kind), np.zeros(n, bool)
        before[0], before[1:] = OTHER, kind[:-1]
        was_blank = np.concatenate([[False], blank[:-1]])
        after[:-1] = ~blank[1:] & ~first[1:]  # something follows in the same text
        out = first | np.where(blank, ~was_blank | after, np.where(was_blank, before != SPACE, kind != before))
        # Endings after an apostrophe that begins a piece are pieces of their own.
        marks = np.flatnonzero((points == ord("'")) & out)
        for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
            m = marks[marks + len(ending) < n]
            for j, c in enumerate(ending, 1):
                m = m[(points[m + j] == ord(c)) & ~first[m + j]]
            out[m + 1] = False
            m = m + len(ending) + 1
            out[m[m < n]] = True
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; texts hold no special string."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(points) + 1, bool)
        first[0] = True
        first[ends] = True
        begins = self.begins(points, first[:-1])
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        places = np.concatenate([[0], np.cumsum(widths)])
        pieces = np.zeros(len(data), bool)
        pieces[places[:-1][begins]] = True
        total = np.concatenate([[0], np.cumsum(self.changes(data, pieces), dtype=np.int64)])
        bounds = np.concatenate([[0], places[ends]])
        return total[bounds[1:]] - total[bounds[:-1]]

    def changes(self, data: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """By how much each byte changes the count of tokens."""
        if len(self.states) > STATES:
            self.restart()
        n, lanes = len(data), -(-len(data) // CHUNK)
        size = lanes * CHUNK
        rows = np.zeros(size, np.int64)
        rows[:n] = data
        new = np.ones(size, bool)
        new[:n] = pieces
        rows, new = np.ascontiguousarray(rows.reshape(lanes, CHUNK).T), np.ascontiguousarray(new.reshape(lanes, CHUNK).T)
        out = np.zeros((CHUNK, lanes), np.int8)
        constant = new.any(axis=0)
        head = np.where(constant, new.argmax(axis=0), CHUNK)
        state = np.zeros(lanes, np.int64)
        for j in range(CHUNK):  # every chunk from its first piece on
            on = head <= j
            if on.all():
                state[new[j]] = 0
                state, out[j] = self.step(state, rows[j])
            elif on.any():
                state[new[j]] = 0
                to, change = self.step(state[on], rows[j][on])
                state[on], out[j][on] = to, change
        # The scan: heads run from the exit state of the chunk before, once that is constant or has been composed.
        entry = np.concatenate([[0], state[:-1]])
        ready = np.concatenate([[True], constant[:-1]])
        todo = np.flatnonzero(ready & (head > 0))
        while len(todo):
            run = entry[todo]
            if len(todo) < 4:
                for lane, s in zip(todo.tolist(), run.tolist(), strict=True):
                    out[: head[lane], lane], s = self.scalar(s, rows[: head[lane], lane].tolist())
                    if not constant[lane]:
                        state[lane] = s
            else:
                for j in range(int(head[todo].max())):
                    on = head[todo] > j
                    to, change = self.step(run[on], rows[j][todo[on]])
                    run[on] = to
                    out[j, todo[on]] = change
                open_ = ~constant[todo]
                state[todo[open_]] = run[open_]
            after = todo[~constant[todo]] + 1
            after = after[after < lanes]
            entry[after] = state[after - 1]
            todo = after[head[after] > 0]
        return out.T.ravel()[:n]

    def scalar(self, state: int, data: list[int]) -> tuple[list[int], int]:
        out = []
        for byte in data:
            found = int(self.table[state, byte])
            if found < 0:
                found = self.compile(state, byte)
            state = found >> 7
            out.append((found & 127) - _BIAS)
        return out, state


_compiled: dict[str, Transducer] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    machine = _compiled[path]
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    for batch in batches:
        texts = batch.column(1).to_pylist()
        counts = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owners: list[int] = []
        held = 0
        for k, text in enumerate([*texts, None]):
            if held > BLOCK or text is None:
                np.add.at(counts, owners, machine.counts(parts))
                parts, owners, held = [], [], 0
            if text is None:
                break
            pieces = [text]
            for special in machine.special:
                if special in text:
                    pieces = [x for p in pieces for x in p.split(special)]
            counts[k] += len(pieces) - 1  # each special string is a token
            parts += pieces
            owners += [k] * len(pieces)
            held += len(text)
        sizes = np.array([len(t.encode()) for t in texts], np.int64)
        columns = [batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)]
        yield pa.RecordBatch.from_arrays(columns, names)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text by the byte-level BPE tokenizer in the file `path`, special strings as special tokens.

    Returns doc_id, n_bytes, n_tokens and over_limit. A null or empty text has none; null ids stay null; repeated rows
    are counted each; an empty table gives an empty result. Only id and text are read; there is no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _count(b, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
