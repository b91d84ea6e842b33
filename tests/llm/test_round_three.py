"""Alignment, sharding and prefix tries against plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandex.llm import op11_alignment, op12_sharding, op13_prefix_trie

from test_operators import frame, odd, sentence  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


# alignment


def plain_alignment(docs, voc):
    per, held = [], Counter()
    for d, t in docs:
        row = None
        if t:
            a, b = voc.a.encode(" " + t, add_special_tokens=False).ids, voc.b.encode(t)
            x, y, whole = [voc.bytes_a[i] for i in a], [voc.bytes_b[i] for i in b], (" " + t).encode()
            if b"".join(x) == whole == b"".join(y):
                ends_a, ends_b = (list(itertools.accumulate(map(len, z))) for z in (x, y))
                links = [(a[i], b[j]) for i, e in enumerate(ends_a) for j, f in enumerate(ends_b) if e - len(x[i]) < f and f - len(y[j]) < e]
                groups, i, j = [], 0, 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
                    groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
                    i, j = k, m
                row = (len(a), len(b), groups, links)
                held.update(set(links))
        per.append((d, row))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [
        (d, 0, 0, 0, 0, 0, 0, "") if r is None else (d, r[0], r[1], len(r[2]), len(r[3]), sum(held[x] == best[x[0]] for x in r[3]), sum(held[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest())
        for d, r in per
    ]


def test_alignment(spark):
    """Against whole texts: white space of all kinds, special tokens' strings, U+2581, copies, a null id, long segments; small blocks."""
    rng = random.Random(4)
    bits = ["a", "the", "The", " ", "  ", "\n", "\t", "\r", " a", "　", "\xa0", ".", "'s", "1", "23", "é", "日本", "\U0001f600", "▁", "<s>", "<|endoftext|>", "\x00", "\x1c", "\x85", "http://x.y/z", " '", "{\r", "  }", "ﬁ", "́"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([1, 2, 3, 8, 30])))) for i in range(1500)]
    docs += [(9000, None), (9001, ""), (9002, " "), (9003, "x " * 3), (9004, "z" * 900), (9004, "z" * 900), (None, "hi there")]
    voc = op11_alignment.Vocabularies(*op11_alignment.vocabularies())
    assert voc.split
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = Counter(plain_alignment(docs, voc))
    for block in (500, op11_alignment.BLOCK):
        assert Counter(map(tuple, op11_alignment.alignment(df, block=block).collect())) == want


def test_alignment_without_splits(spark, monkeypatch):
    """Vocabularies that merge across spaces leave texts whole."""
    docs = [(1, "one two  three\n four"), (2, "one two"), (3, "one two")]
    voc = op11_alignment.Vocabularies(*op11_alignment.vocabularies())
    monkeypatch.setattr(op11_alignment, "loaded", lambda paths: voc)
    monkeypatch.setattr(voc, "split", False)
    assert op11_alignment.segments("a b", False) == ["a b"] and op11_alignment.segments(" a  b", True) == [" a", " b"]
    got = op11_alignment.alignment(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(plain_alignment(docs, voc))


def test_odd_texts_aligned(spark, odd):  # noqa: F811
    assert op11_alignment.alignment(frame(spark, [])).count() == 0
    got = op11_alignment.alignment(frame(spark, odd)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd)
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in got if r.doc_id in (103, 104))


# sharding


def plain_lpt(sizes, shards):
    heap, out = [(0, i) for i in range(shards)], []
    for s in sizes:
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + s, i))
        out.append(i)
    return out


def loads(rows, shards):
    out = [0] * shards
    for r in rows:
        out[r.shard] += r.size
    return out


def checked(rows, docs, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(0 <= s < shards for s in slots)
    assert all(len(v) == 1 for v in homes.values())


@pytest.mark.parametrize("exact", [1000, 3])
def test_sharding(spark, monkeypatch, exact):
    """As plain LPT where all groups are placed one by one; close to it where most go by classes."""
    monkeypatch.setattr(op12_sharding, "EXACT", exact)
    rng = random.Random(5)
    docs = [(i, sentence(rng, rng.choice([1, 3, 40, 300]))) for i in range(1200)]
    docs += [(2000 + i, "a copy of one text") for i in range(300)] + [(5000, None), (5001, ""), (None, "no id"), (None, "no id"), (7, "again"), (7, "again")]
    rows = op12_sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 8).collect()
    checked(rows, docs, 8)
    groups = defaultdict(lambda: [0, []])
    for d, t in docs:
        groups[t or ""][0] += len((t or "").encode()) + 16
        groups[t or ""][1].append(-1 if d is None else d)
    order = sorted(groups.values(), key=lambda g: (-g[0], min(g[1])))
    want = [0] * 8
    for (size, _), shard in zip(order, plain_lpt([g[0] for g in order], 8), strict=True):
        want[shard] += size
    got = loads(rows, 8)
    if exact == 1000:
        assert got == want
    assert max(got) - min(got) <= max(want) - min(want) + 64


def test_water_level():
    rng = np.random.default_rng(6)
    for _ in range(200):
        loads_, n, size = rng.integers(0, 500, 6).astype(float), int(rng.integers(1, 80)), float(rng.integers(1, 40))
        got = op12_sharding.level(loads_, n, size)
        heap = [(x, i) for i, x in enumerate(loads_)]
        heapq.heapify(heap)
        want = np.zeros(6, int)
        for _ in range(n):
            load, i = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (load + size, i))
        assert got.sum() <= n and (got <= want).all() and (want - got <= 1).all()


def test_one_hot_text_in_shards(spark):
    """A text that holds most rows stays together, its slots are gapless, and the other shards share the rest."""
    docs = [(i, "hot" if i % 3 else f"text {i} " + "x" * (i % 50)) for i in range(6000)]
    rows = op12_sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    checked(rows, docs, 4)
    rest = sorted(loads(rows, 4))[:3]
    assert rest[2] - rest[0] < 100


def test_odd_texts_sharded(spark, odd):  # noqa: F811
    assert op12_sharding.sharded(frame(spark, [])).count() == 0
    checked(op12_sharding.sharded(frame(spark, odd), 5).collect(), [(r[0], r[1]) for r in odd], 5)


# prefix trie


def plain_trie(seqs):
    members, kids, out = defaultdict(list), defaultdict(list), []
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)

    def walk(s):
        saved, leaves = (len(members[s]) - 1) * (len(WORD.findall(s[-1][1])) if s else 0), 0 if kids[s] else 1
        for k in kids[s]:
            a, b = walk(k)
            saved, leaves = saved + a, leaves + b
        ends = ",".join(map(str, sorted(c for c in members[s] if len(seqs[c]) == len(s))))
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(kids[s]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return saved, leaves

    if seqs:
        walk(())
    return out


def plain_sequences(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in by.items()}


def plain_rebuilt(rows):
    own = plain_sequences(rows)
    cut = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, ())[: cut[c]] + s[cut[c] :] for c, s in own.items()}


@pytest.mark.parametrize("parts", [1, 3, 29])
def test_prefix_trie(spark, parts):
    """Over one partition and over many, so that most nodes are stitched; equal conversations, long ones, null turns, roles and texts."""
    rng, rows = random.Random(parts), []
    for c in range(250):
        said = [(rng.choice("ab"), rng.choice(["x y", "z", ""])) for _ in range(rng.choice([1, 1, 2, 3, 9]))] if c % 3 else [("a", "x y")] * rng.choice([2, 30])
        rows += [(c - 40, i or None, r, x or None) for i, (r, x) in enumerate(said)]
    rows += [(None, 1, "a", "lost"), (900, 0, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = op13_prefix_trie.prefix_trie(df).collect()
        again = op13_prefix_trie.trie(op13_prefix_trie.rebuilt(df.selectExpr("*", "'x' as key", "1 as base", "2 as n"))).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert Counter(map(tuple, got)) == Counter(plain_trie(plain_sequences(rows)))
    assert Counter(map(tuple, again)) == Counter(plain_trie({c: (*s,) for c, s in truncated(rows).items()}))


def truncated(rows):
    """As plain_rebuilt, with the remainder of the sign of the id, as in SQL."""
    own = plain_sequences(rows)
    cut = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    rest = lambda c: c % 20 if c >= 0 else -(-c % 20)
    return {c: own.get(c - rest(c), ())[: cut[c]] + s[cut[c] :] for c, s in own.items()}


def test_turnless_and_empty(spark):
    assert op13_prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    # 21 has one turn, three are to come from 20, which isn't there
    c = next(c for c in range(21, 1000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(c, 0, "user", "hello"), (c + 2000, 0, "user", "hello")]
    assert Counter(map(tuple, op13_prefix_trie.trie(op13_prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS))).collect())) == Counter(plain_trie(plain_rebuilt(rows)))
    only = [(c, 0, "user", "hello")]
    assert [tuple(r) for r in op13_prefix_trie.trie(op13_prefix_trie.rebuilt(spark.createDataFrame(only, TURNS))).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_repeated_rows_are_turns(spark):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (2, 0, "a", "x")]
    got = sorted(tuple(r)[:5] for r in op13_prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect())
    assert got == sorted(r[:5] for r in plain_trie({1: (("a", "x"),) * 2, 2: (("a", "x"),)}))


def test_common_prefixes():
    rng = random.Random(7)
    w = op13_prefix_trie.WIDTH
    for _ in range(300):
        a, b = ([rng.choice("xy") * w for _ in range(rng.randrange(5))] for _ in range(2))
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert op13_prefix_trie.shared("".join(a), "".join(b)) == want
