"""Ranked search, fingerprints and the prefix trie against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, item_id int, rank int, score string, term string, stretch int, guest int"


def brute_ranking(docs, items, k):
    terms = [TERM.findall((t or "").translate(AZ)) for _, t in docs]
    n_docs, total = sum(map(bool, terms)), sum(map(len, terms))
    df = collections.Counter(x for t in terms for x in set(t))
    asked = collections.defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(TERM.findall((text or "").translate(AZ)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for (doc_id, _), t in zip(docs, terms, strict=True):
            tf = collections.Counter(t)
            m = 50 + (50 * len(t) * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in wanted if tf[x])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item, r, None if null else doc_id, -s) for r, (s, null, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def random_texts(rng, n, words, vocabulary=60):
    return [" ".join(f"w{int(v)}" for v in rng.zipf(1.4, int(rng.integers(0, words))) % vocabulary) for _ in range(n)]


@pytest.mark.parametrize("entries", [1 << 21, 64])
@pytest.mark.parametrize("pairs", [1 << 20, 20])
def test_ranked_search(spark, monkeypatch, entries, pairs):
    from tickloom.llm import ranked_search as r
    from tickloom.llm import wordhash

    monkeypatch.setattr(r, "ENTRIES", entries)
    monkeypatch.setattr(r, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    texts = [*random_texts(rng, 120, 40), None, "", "?!", "W1 w1,W2;w3", "é-À É", "x" * 3000, "w1 " * 9000, "only1 here2", "same tie", "same tie", "same tie"]
    docs = [(k, t, 1, 2, "s", "t", 0, 0) for k, t in enumerate(texts)] + [(5, texts[5], 1, 2, "s", "t", 0, 0), (None, "same tie", 1, 2, "s", "t", 0, 0), (-3, "same tie", 1, 2, "s", "t", 0, 0)]
    items = [(k, t, None) for k, t in enumerate(random_texts(rng, 12, 15))] + [(20, None, 1), (21, "!!", 1), (22, "Same, same tie nowhere", 1), (23, "é À É w2", 1), (None, "w1", 1), (0, "only1 here2", 1), (24, "w1 w2 w3", 1)]
    docs_, items_ = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string, doc_id int")
    got = r.ranked_search(docs_, items_, k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_ranking([x[:2] for x in docs], [x[:2] for x in items], 7)
    assert r.ranked_search(docs_.limit(0), items_).count() == 0 and r.ranked_search(docs_, items_.limit(0)).count() == 0
    assert list(wordhash.blocks(docs_.limit(0).select("text").toArrow().column(0).combine_chunks())) == []


def test_terms_of_texts_longer_than_a_block(monkeypatch):
    import pyarrow as pa

    from tickloom.llm import ranked_search, wordhash

    texts = pa.array(["a,b c", "", "d" * 200 + ". e", "one-Two " * 40])
    whole = [h.tolist() for _, _, h in ranked_search.term_hashes(texts)]
    monkeypatch.setattr(wordhash, "BLOCK", 50)
    assert [x for _, _, h in ranked_search.term_hashes(texts) for x in h.tolist()] == [x for h in whole for x in h]
    assert len(sum(whole, [])) == 3 + 2 + 80


def test_radix_order_sorts():
    from tickloom.llm.ranked_search import radix_order

    keys = np.random.default_rng(0).integers(0, 1 << 50, 5000)
    assert (keys[radix_order(keys)] == np.sort(keys)).all() and radix_order(keys[:0]).tolist() == []


def pieces(text):
    """Paragraphs as the module says them, byte by byte, with their number among equal ones."""
    from tickloom.llm.fingerprints import MOST_BYTES, ONE_IN, _FACTOR
    from tickloom.llm.wordhash import mixed

    data, cuts, seen, out = text.encode(), [0], collections.Counter(), set()
    for i in range(1, len(data) + 1):
        cut = data[i - 1] == 10
        if data[i - 1] == 32:
            before = 0
            for j in range(2, 6):
                before = before << 8 | (data[i - j] if i - j >= 0 else 0)
            cut = chr(before >> 24) in ".!?" or int(mixed(np.array([before], np.uint64) * _FACTOR)[0]) % ONE_IN == 0
        if cut or i == len(data) or i - cuts[-1] == MOST_BYTES:
            cuts.append(i)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            out.add((data[a:b], seen[data[a:b]]))
            seen[data[a:b]] += 1
    return out


def near(a, b):
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize(("chunk", "rows"), [(1 << 20, 512), (300, 4)])
def test_fingerprints(spark, monkeypatch, chunk, rows):
    from tickloom.llm import fingerprints as f

    monkeypatch.setattr(f, "CHUNK", chunk)
    monkeypatch.setattr(f, "ROWS", rows)
    monkeypatch.setattr(f, "DRAWS", 1)
    rng = np.random.default_rng(5)
    texts = [*random_texts(rng, 40, 80, 4000), None, "", "a", "é", "ab", "line\n" * 30, "x" * 2000, "y. " * 400, "One two! Three four? Five.\n\nSix \U0001f600 seven", "same text here", "same text here"]
    texts += [" ".join(f"long{i}" for i in range(20_000))]
    table = [(k * 3 % 101, t, 1, 2, "s", "t", 0, 0) for k, t in enumerate(texts)] + [(None, "no id", 1, 1, "x", "y", 1, 1), (None, None, 1, 1, "x", "y", 1, 1), (7, "again one of its own", 1, 1, "x", "y", 1, 1)]
    table += [table[3], table[3]]
    docs = spark.createDataFrame(table, SCHEMA).repartition(5)
    order = docs.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()
    order = sorted(order, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = []
    for k, r in enumerate(order):
        follow = order[(k + 1) % len(order)].text
        half = len(r.text) // 2
        new = r.text[: len(r.text) - half] + follow[:half]
        a, b, c = pieces(r.text), pieces(new), pieces(follow)
        want.append((r.doc_id, len(r.text), hashlib.sha256(new.encode()).hexdigest(), round(near(a, b), 9), round(near(a, c), 9), len(a), len(a - b), len(b - a)))
    got = f.fingerprint_edits(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), r.n_paragraphs, r.n_lost, r.n_gained) for r in got), key=str) == sorted(want, key=str)
    by_text = collections.defaultdict(set)
    for r, x in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(table, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        if r.doc_id not in (None, 7):
            by_text[x[1] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
    assert max(r.cells for r in got) > f.CELLS == min(r.cells for r in got)
    assert f.fingerprint_edits(docs.limit(0)).count() == 0
    one = f.fingerprint_edits(docs.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    alone = {r.doc_id: r.fingerprint for r in f.fingerprint_texts(docs.where("doc_id != 7")).collect()}
    assert all(alone[r.doc_id] == r.fingerprint for r in got if r.doc_id not in (None, 7))


def test_differing_paragraphs_of_versions(spark):
    from tickloom.llm.fingerprints import Versions, compare_versions, likeness

    old = "First sentence stands. " + "Second one. " * 5 + "The third is long and goes on and on. End."
    new = old.replace("Second one. ", "", 1).replace("goes on", "goes off")
    rng = np.random.default_rng(1)
    big = " ".join(f"v{int(x)}" for x in rng.integers(0, 10**6, 5000))
    pairs = spark.createDataFrame([(1, old, new, 1), (2, old, old, 1), (3, None, old, 1), (4, None, "", 1), (5, big, big[: len(big) // 2], 1), (None, old, None, 1)], "doc_id long, old string, new string, near int")
    got = {r.doc_id: r for r in compare_versions(pairs).collect()}
    a, b = pieces(old), pieces(new)
    assert (len(got[1].lost), len(got[1].gained)) == (len(a - b), len(b - a)) and abs(got[1].near - near(a, b)) < 1e-12
    assert got[2].near == got[4].near == 1.0 and got[2].lost == got[2].gained == [] and got[3].near == got[None].near == 0.0 and got[3].gained == got[None].lost
    assert len(got[5].lost) > 500 and got[5].cells > 1000 and len(set(got[5].lost)) == len(got[5].lost)
    v = Versions([x.encode() for x in (old, new, big, "")])
    names = v.tables.strings(v.n)
    assert abs(likeness(names[0], names[1]) - near(a, b)) < 1e-12 and likeness(names[0], names[0]) == likeness(names[3], names[3]) == 1.0
    assert likeness(names[0], names[2]) is None
    assert compare_versions(pairs.limit(0)).count() == 0


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, f"{role or ''} {hashlib.md5((text or '').encode()).hexdigest()}", role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = collections.defaultdict(set)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = [c for c in sorted(m) if len(rebuilt[c]) == len(node)]
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below),
            sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below),
            sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, p int, words int, owner string"


@pytest.mark.parametrize("bits", [12, 1])
def test_prefix_trie(spark, monkeypatch, bits):
    from tickloom.llm import prefix_trie as t

    monkeypatch.setattr(t, "BLOCK_BITS", bits)
    monkeypatch.setattr(t, "ENDS_BITS", bits)
    rng = np.random.default_rng(2)
    rows = [(int(c), k, "ua"[k % 2], "hello  there\tyou" if rng.random() < 0.6 else f"say {int(rng.integers(0, 3))}") for c in [*range(0, 70), 105, 121] for k in range(int(rng.integers(1, 7)))]
    rows += [(20, None, None, None), (21, 2, "u", "tie b"), (21, 2, "u", "tie a"), (22, 3, "u", None), (22, 3, "u", None), (None, 1, "u", "nobody"), (-5, 1, "u", "  "), (-25, 9, None, "x"), (40, 5, "u", "w " * 5000), (300, 1, "u", "alone")]
    rows += [(c, 0, "u", "one and the same") for c in range(400, 460)] + [(500, k, "u", f"long {k}") for k in range(40)] + [(c, 0, "u", "short") for c in (601, 602, 603, 604, 605, 606)]
    table = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], CONVERSATIONS).repartition(4)
    got = t.prefix_trie(table)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)
    assert t.prefix_trie(table.limit(0)).count() == 0 and t.prefix_trie(table.where("conv_id is null")).count() == 0
