"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Every passage is encoded by a small network over its letter, sign and
repetition statistics; gated attention, learned from document labels alone, weighs the passages, and the weighted passage
representation is scored. Trained here in numpy on a bounded sample of labelled documents.

Defined cases: a null or empty text is one empty passage and is scored as such; a null doc_id counts as not held out; repeated
rows get a row each; without labels of both kinds every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PASSAGE, SHAPES = 64, 32
#: Bytes of text that are Python objects at a time.
SLICE = 1 << 20
#: Bytes by kind: small letter, capital, digit, other byte of a longer character, then single signs.
_KIND = np.full(256, 4, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
for _i, _signs in enumerate(("#*", "$%&", "|<>", "!?", ".,;:", "\"'()[]{}", "@/\\=+-_~^`")):
    _KIND[list(map(ord, _signs))] = 5 + _i
_KIND[32] = 12
KINDS = 13
WIDTH = KINDS + 8 + SHAPES


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH, index of each text's first passage and, last, their number). Texts without words have one zero passage."""
    w = common.Words(texts)
    counts = np.diff(w.first)
    pieces = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(pieces)])
    x = np.zeros((first[-1], WIDTH), np.float32)
    n = len(w.start)
    if not n:
        return x, first
    doc = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(n) - w.first[doc]
    piece = first[doc] + place // PASSAGE
    heads = np.nonzero(np.diff(piece, prepend=-1))[0]
    where = piece[heads]
    size = np.diff(np.append(heads, n)).astype(np.float32)
    begin = w.start[heads]
    kind = _KIND[w.buf]
    chars = np.diff(np.append(begin, len(w.buf))).astype(np.float32)
    for k in range(KINDS):
        x[where, k] = np.add.reduceat((kind == k).astype(np.float32), begin) / chars
    h = w.hashes(w.start, w.end, w.sums())
    for j, lag in enumerate((1, 2, 3, 4)):
        same = np.zeros(n, np.float32)
        if n > lag:
            same[lag:] = (h[lag:] == h[:-lag]) & (piece[lag:] == piece[:-lag])
        x[where, KINDS + j] = np.add.reduceat(same, heads) / size
    order = np.lexsort((h, piece))
    fresh = np.ones(n, np.float32)
    fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (piece[order[1:]] != piece[order[:-1]])
    x[where, KINDS + 4] = np.add.reduceat(fresh, heads) / size  # order keeps the passages in place
    length = (w.end - w.start).astype(np.float32)
    x[where, KINDS + 5] = np.add.reduceat(length, heads) / size / 10
    x[where, KINDS + 6] = np.add.reduceat((length > 12).astype(np.float32), heads) / size
    x[where, KINDS + 7] = size / PASSAGE
    shape = (kind[w.start].astype(np.int64) * 13 + kind[w.end - 1] * 5 + np.minimum(length, 11).astype(np.int64) // 4) % SHAPES
    grid = np.bincount(piece * SHAPES + shape, minlength=first[-1] * SHAPES).reshape(-1, SHAPES)
    x[where, KINDS + 8 :] = grid[where] / size[:, None]
    return x, first


class Model:
    """tanh encoder, gated attention and a logistic output; `fit` runs Adam on whole bags."""

    def __init__(self, width: int = WIDTH, hidden: int = 16, gate: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.p = {"E": r(width, hidden), "e": np.zeros(hidden, np.float32), "V": r(hidden, gate), "U": r(hidden, gate), "a": r(gate, 1), "c": r(hidden, 1), "b": np.zeros(1, np.float32)}
        self.trained = False

    def forward(self, x, first):
        p, bag = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        g = ((t * s) @ p["a"])[:, 0]
        w = np.exp(g - np.maximum.reduceat(g, first[:-1])[bag])
        w /= np.add.reduceat(w, first[:-1])[bag]
        m = np.add.reduceat(w[:, None] * h, first[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip((m @ p["c"])[:, 0] + p["b"][0], -30, 30)))
        return z, bag, h, t, s, w, m, y

    def score(self, x, first) -> np.ndarray:
        return self.forward(x, first)[-1].astype(np.float64) if self.trained else np.full(len(first) - 1, 0.5)

    def fit(self, x, first, y, epochs: int = 30, batch: int = 256, rate: float = 0.01, seed: int = 5):
        if len(y) < 2 or y.min() == y.max():
            return self
        self.trained, rng = True, np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) ** 0.5
        mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                sizes = first[rows + 1] - first[rows]
                own = np.concatenate([[0], np.cumsum(sizes)])
                take = np.repeat(first[rows] - own[:-1], sizes) + np.arange(own[-1])
                z, bag, h, t, s, w, m, out = self.forward(x[take], own)
                p = self.p
                dy = ((out - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                dm = dy[:, None] * p["c"][:, 0]
                dw = (h * dm[bag]).sum(1)
                dg = w * (dw - np.add.reduceat(w * dw, own[:-1])[bag])
                dt, ds = dg[:, None] * p["a"][:, 0] * s * (1 - t * t), dg[:, None] * p["a"][:, 0] * t * s * (1 - s)
                dh = (w[:, None] * dm[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
                grads = {"E": z.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ dg[:, None], "c": m.T @ dy[:, None], "b": dy.sum(keepdims=True)}
                step += 1
                for k, d in grads.items():
                    d = d + 1e-4 * p[k]
                    a, v = mom[k]
                    a += 0.1 * (d - a)
                    v += 0.001 * (d * d - v)
                    p[k] = p[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: int) -> Model:
    sample = common.labelled_sample(docs, labels, "quality", bound, ~held_out())

    def run(batches):
        for b in common.sliced(batches, SLICE):
            x, first = encode(common.texts(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary()), b.column(2)], names=["doc_id", "x", "quality"])

    rows = sample.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, "doc_id long, x binary, quality int").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]
    if not bags:
        return Model()
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Model().fit(np.concatenate(bags), first, np.array([float(r.quality == 1) for r in rows], np.float32))


def quality_mil(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> doc_id, held_out, score, predicted, n_passages. sample bounds the training documents."""
    model = train(docs, labels, sample)

    def run(batches):
        for b in common.sliced(batches, SLICE):
            x, first = encode(common.texts(b))
            s = model.score(x, first)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.diff(first))], names=["doc_id", "held_out", "score", "predicted", "n_passages"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long")


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
