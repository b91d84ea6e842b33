"""What used to depend on size: short items, long contexts, samples of a hot id; and a plain form of the quality model."""

import random
import time

import numpy as np
import pytest
from test_operators import DOCS, WORD, distance, labels

from strandex.llm import common, op01_quality_rules, op02_quality_mil, op04_decontaminate, op05_pii


def edited(rng, item, edits, letters):
    x = list(item)
    for _ in range(edits):
        k = rng.randrange(len(x))
        x[k : k + 1] = rng.choice([[], [rng.choice(letters)], [x[k], rng.choice(letters)]])
    return "".join(x)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz", "etaoin é日9,"])
def test_short_items_at_the_full_rate(letters):
    """Items of 4 to 40 characters are found where, and only where, a text holds them within a tenth of their characters in edits."""
    rng, found = random.Random(21), 0
    for size in range(4, 41):
        for _ in range(6):
            item = "x" + "".join(rng.choice(letters) for _ in range(size - 2)) + "y"
            words = "".join(map(chr, op04_decontaminate.normal(item)[0]))
            block = op04_decontaminate.Items([(0, item)])
            assert not len(words) >= 4 or block.edits[0] == len(words) // 10
            side = lambda: "".join(rng.choice(letters + " ") for _ in range(rng.randrange(0, 30)))
            text = side() + edited(rng, item, rng.randrange(0, size // 10 + 2), letters) + side()
            chars, codes, _ = op04_decontaminate.normal(text)
            got = [m[1] for m in block.search(chars, codes)]
            least = distance(words, "".join(map(chr, chars)))
            assert (min(got) == least) if least <= block.edits[0] else not got, (item, text)
            found += bool(got)
    assert found > 60


def test_short_items_beside_long_ones(spark):
    """The case of 20 characters with two edits, at a text's end too; long items, with an index of their own, are found as before."""
    items = spark.createDataFrame([(1, "abcdefghijklmnopqrst"), (2, "quick fox"), (3, "what is the capital of the largest country of the continent"), (4, "abc")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "abcdefXhijklmnopqrst", None, None, None), (2, "12 abcdXfghijklYnopqrst", None, None, None), (3, "a QUICK\tfox", None, None, None), (4, "what is the capital of that largest country of the continent abc", None, None, None), (5, "nothing at all", None, None, None), (6, "XbcdXfghijklYnopqrst", None, None, None)], DOCS)
    got = {(r.doc_id, r.item_id, r.start, r.end, r.edits) for r in op04_decontaminate.contamination(docs, items).collect()}
    assert got == {(1, 1, 0, 20, 1), (2, 1, 3, 23, 2), (3, 2, 2, 11, 0), (4, 3, 0, 60, 2)}
    assert {r.doc_id for r in op04_decontaminate.clean(docs, items).collect()} == {5, 6}


def test_copies_of_a_short_item_side_by_side():
    block = op04_decontaminate.Items([(0, "abcdefghij"), (1, "wxyz")])
    got = sorted(m[:4] for m in block.search(*op04_decontaminate.normal("abcdefghijabcdeXghijabcdefghij wxyzwxyz")[:2]))
    assert got == [(0, 0, 0, 10), (0, 0, 20, 30), (0, 1, 10, 20), (1, 0, 31, 35), (1, 0, 35, 39)]


def plain_contexts(text, start, end):
    """By all the words of the text on both sides."""
    before, after = WORD.findall(text[:start])[-2:], WORD.findall(text[end:])[:1]
    words = [w if len(w) <= op05_pii.WORD else "" for w in (*[""] * (2 - len(before)), *before, *(after or [""]))]
    two, one, after = map(op05_pii._lexical, words)
    if not one:
        return []
    if len(before) == 2 and len(before[1]) > op05_pii.WORD:
        two = ""
    return [*([f"L2|{two} {one}"] if two else []), f"L1|{one}|{op05_pii.shape(text[start:end])}", *([f"LR|{one}|{after}"] if after else [])]


def test_contexts_are_whole_words():
    rng = random.Random(22)
    for _ in range(3000):
        word = lambda: rng.choice("ab9.-") * rng.choice([1, 2, 5, 30, 63, 64, 65, 200, 255, 256, 257, 600])
        space = lambda: rng.choice(["", " ", "\n", "\t ", " " * 70, " " * 1500])
        left, right = "".join(space() + word() + space() for _ in range(rng.randrange(0, 4))), "".join(space() + word() for _ in range(rng.randrange(0, 3)))
        text = left + "u1@mail.com" + right
        at = len(left), len(left) + 11
        assert op05_pii.contexts(text, *at) == plain_contexts(text, *at), text
    long = "x" * 100
    assert op05_pii.contexts(f"my {long} 555-123-4999 today", 104, 116)[0] == f"L2|my {long}"
    assert op05_pii.shape("a1" * 40) != op05_pii.shape("a1" * 41)


@pytest.mark.parametrize("unit", ["1.2.3.4,", "a@b.c,", "a1234 ", "<12345>", " " * 5000 + "12345678"])
def test_contexts_are_linear(unit):
    text = unit * (500_000 // len(unit))
    began = time.monotonic()
    spans = op05_pii.base_spans(text)
    for s, e in [x[1:] for x in spans] + op05_pii.identifiers(text, spans):
        op05_pii.contexts(text, s, e)
    assert time.monotonic() - began < 20


def test_many_rows_of_one_labelled_id(spark):
    """30,000 documents under one id, some of them very long, give one training row; results cover every row all the same."""
    docs = spark.range(30_000).selectExpr("5L as doc_id", "concat('some words of text number ', id, if(id % 1000 = 0, repeat(' more', 40000), '')) as text").unionByName(spark.createDataFrame([(1, "a b c"), (2, None), (3, "x " * 50_000)], "doc_id long, text string"))
    lab = labels(spark, [(5, 1, 0), (5, 0, 1), (1, 0, 1), (2, 1, 0), (3, 1, 1), (None, 1, 1)])
    got = common.labelled_sample(docs, lab, "quality", 6_000).collect()
    assert sorted((r.doc_id, r.quality) for r in got) == [(1, 0), (2, 1), (5, 0)] and max(len(r.text or "") for r in got) < 1 << 16
    assert [r.text for r in got if r.doc_id == 5] == [r.text for r in common.labelled_sample(docs.repartition(7), lab, "quality", 6_000).collect() if r.doc_id == 5]
    assert op02_quality_mil.quality_mil(docs, lab).count() == 30_003
    assert op01_quality_rules.quality_rules(docs.limit(3000).unionByName(docs.where("doc_id < 5")), lab).count() == 3003


def plain_forward(m, bags):
    """Encoder, gated attention and output of each bag, passage by passage."""
    out = []
    for bag in bags:
        hs, gs = [], []
        for x in bag:
            z = [(float(v) - float(a)) / float(s) for v, a, s in zip(x, m.mean, m.scale, strict=True)]
            h = np.tanh([sum(z[i] * m.p["E"][i, j] for i in range(len(z))) + m.p["e"][j] for j in range(m.p["E"].shape[1])])
            t, s = np.tanh(h @ m.p["V"]), 1 / (1 + np.exp(-(h @ m.p["U"])))
            hs.append(h)
            gs.append(float(((t * s) @ m.p["a"])[0]))
        w = np.exp(gs) / np.exp(gs).sum()
        out.append(1 / (1 + np.exp(-(float((w @ np.array(hs)) @ m.p["c"][:, 0]) + float(m.p["b"][0])))))
    return np.array(out)


def test_attention_by_plain_sums():
    rng = np.random.default_rng(6)
    m = op02_quality_mil.Model(width=5, hidden=4, gate=3)
    sizes = [1, 4, 2, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(first[-1], 5)).astype(np.float32)
    assert np.allclose(m.forward(x, first)[-1], plain_forward(m, [x[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]), atol=1e-5)
