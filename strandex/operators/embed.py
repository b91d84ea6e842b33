"""Hashed sub-word vectors: character n-grams of a token in 1024 buckets, compared by cosine in fixed point.

Each batch of terms is set against the few query vectors, held as a dense matrix. For documents, a task compares the distinct terms of
some at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..functions import tokenize as tk
from ..functions.fixedpoint import SCALE
from ..storage import tasks
from .bm25 import small

# Buckets, n-gram lengths, and the low ten bits of FNV-1a's basis and prime.
BUCKETS, SHORTEST, LONGEST, BASIS, PRIME = 1024, 3, 5, 805, 435
#: Query tokens that are compared with the vocabulary at a time.
BLOCK = 512


def token_buckets(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the token, bucket) of every feature: n-grams of <token>, and =token whole."""
    chars = [f"<{t}>" for t in tokens]
    grams = [(i, c[k : k + n].encode()) for i, c in enumerate(chars) if tokens[i] for n in range(SHORTEST, LONGEST + 1) for k in range(len(c) - n + 1)]
    grams += [(i, f"={t}".encode()) for i, t in enumerate(tokens) if t]
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, size = np.array([i for i, _ in grams]), np.array([len(g) for _, g in grams])
    buf, at = np.frombuffer(b"".join(g for _, g in grams), np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]])
    h, order = np.full(len(grams), BASIS, np.int64), np.argsort(-size, kind="stable")
    sorted_size = size[order]
    for p in range(int(size.max())):
        live = order[: int(np.searchsorted(-sorted_size, -p))]
        h[live] = ((h[live] ^ buf[at[live] + p]) * PRIME) & (BUCKETS - 1)
    return place, h


def vectors(tokens: list[str]) -> np.ndarray:
    place, bucket = token_buckets(tokens)
    return np.bincount(place * BUCKETS + bucket, minlength=len(tokens) * BUCKETS).reshape(len(tokens), BUCKETS)


def term_buckets(terms: DataFrame) -> DataFrame:
    """(term) -> (term, bucket, weight)."""

    def run(batches):
        for b in batches:
            t = b.column(0).to_pylist()
            place, bucket = token_buckets(t)
            key, n = np.unique(place * BUCKETS + bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([t[i] for i in key // BUCKETS], pa.string()), pa.array(key % BUCKETS), pa.array(n)], names=["term", "bucket", "weight"])

    return terms.select("term").mapInArrow(run, "term string, bucket long, weight long")


def cosine(dot: int, a: int, b: int) -> int:
    return 0 if dot <= 0 or not a or not b else min(SCALE, math.isqrt(dot * dot * 10**12 // (a * b)))


def cosines(terms: list[str], q: np.ndarray) -> np.ndarray:
    """Of terms (rows) and the vectors q of tokens (columns)."""
    v = vectors(terms)
    dot = v.astype(np.float64) @ q.T.astype(np.float64)  # counts are small: products are exact
    own, norm, out = (v * v).sum(1), (q * q).sum(1), np.zeros(dot.shape, np.int64)
    term, token = np.nonzero(dot)
    d, a, b = dot[term, token].astype(np.int64), own[term], norm[token]
    if (d < 3000).all():
        c = np.minimum(np.floor(np.sqrt((d**2 * 10**12 // (a * b)).astype(np.float64))).astype(np.int64), SCALE)
    else:
        c = np.array([cosine(int(x), int(y), int(z)) for x, y, z in zip(d, a, b, strict=True)], np.int64)
    out[term, token] = c
    return out


def term_cosines(vocabulary: DataFrame, tokens: list[str], least: int = 1, below: int = SCALE + 1) -> DataFrame:
    """(token, term, cosine) of the given tokens and all terms of the vocabulary, where the cosine is `least` or more, and under `below`.

    A pair whose dot product is too small for its norms is dropped before its cosine is computed, and none outside is written.
    """

    def run(batches, block):
        q = vectors(block).astype(np.float64)  # counts are small: products are exact
        norm = (q * q).sum(1)
        for b in batches:
            t = b.column(0).to_pylist()
            for i in range(0, len(t), 2048):
                part = t[i : i + 2048]
                v = vectors(part).astype(np.float64)
                dot = v @ q.T
                own = (v * v).sum(1)
                # one micro-unit of room for the rounding of the root
                term, token = np.nonzero(dot > max(least - 1, 0) / SCALE * np.sqrt(own[:, None] * norm[None, :]) * (1 - 1e-12))
                d, squares = dot[term, token], own[term] * norm[token]
                if (d < 3000).all():
                    ratio = d.astype(np.int64) ** 2 * 10**12 // squares.astype(np.int64)
                    c = np.minimum(np.floor(np.sqrt(ratio.astype(np.float64))).astype(np.int64), SCALE)
                else:
                    c = np.array([cosine(int(x), int(own[j]), int(norm[k])) for x, j, k in zip(d, term, token, strict=True)], np.int64)
                inside = (c >= least) & (c < below)
                term, token, c = term[inside], token[inside], c[inside]
                yield pa.RecordBatch.from_arrays([pa.array([block[k] for k in token], pa.string()), pa.array([part[j] for j in term], pa.string()), pa.array(c)], names=["token", "term", "cosine"])

    out = None
    for i in range(0, max(len(tokens), 1), BLOCK):
        part = vocabulary.select("term").mapInArrow(lambda batches, block=tokens[i : i + BLOCK]: run(batches, block), "token string, term string, cosine long")
        out = part if out is None else out.unionByName(part)
    return out


#: Cosines from which pairs count as near.
REACH = 150_000
#: Postings that one task gets, those compared at a time, and cosines that are held at a time.
DEALT, COMPARED, REMEMBERED = 1_000_000, 1 << 18, 1 << 22
#: Terms whose vectors are held at a time.
HELD = 1024


def arrow_buckets(terms: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """token_buckets() of an Arrow array, without a Python string for any term or n-gram."""
    n = len(terms)
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    size = np.diff(ends)
    start = ends[:-1] + 2 * np.arange(n)
    buf = np.full(len(raw) + 2 * n, ord("<"), np.int32)
    buf[np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, size)] = raw
    buf[start + size + 1] = ord(">")
    at = np.flatnonzero((buf & 0xC0) != 0x80)  # the first bytes of characters
    owner = np.searchsorted(start, at, "right") - 1
    last = np.cumsum(np.bincount(owner, minlength=n))[owner]
    upto = np.append(at, len(buf))
    wide, widest = np.diff(upto), int(np.diff(upto).max(initial=0))
    out, h = [], np.full(len(at), BASIS, np.int32)
    k = np.arange(len(at))
    for c in range(LONGEST):
        live = k + c < last
        k, last, h = k[live], last[live], h[live]
        for p in range(widest):
            if p == 0:
                h = ((h ^ buf[at[k + c]]) * PRIME) & (BUCKETS - 1)
            else:
                more = np.flatnonzero(wide[k + c] > p)
                h[more] = ((h[more] ^ buf[at[k[more] + c] + p]) * PRIME) & (BUCKETS - 1)
        if c + 1 >= SHORTEST:
            out.append((owner[k], h))
    order = np.argsort(-size, kind="stable")
    falling, first = size[order], ends[:-1][order]
    whole = np.full(n, ((BASIS ^ ord("=")) * PRIME) & (BUCKETS - 1), np.int32)
    for p in range(int(falling[0]) if n else 0):
        m = int(np.searchsorted(-falling, -p))
        whole[:m] = ((whole[:m] ^ raw[first[:m] + p]) * PRIME) & (BUCKETS - 1)
    some = falling > 0
    out.append((order[some], whole[some]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def arrow_cosines(terms: pa.StringArray, q: np.ndarray) -> np.ndarray:
    """cosines() of an Arrow array."""
    out, norm, across = np.zeros((len(terms), len(q)), np.int32), (q * q).sum(1), np.ascontiguousarray(q.T.astype(np.float64))
    v = np.zeros((HELD, BUCKETS))
    cells = v.reshape(-1)
    for lo in range(0, len(terms), HELD):
        part = terms.slice(lo, HELD)
        place, bucket = arrow_buckets(part)
        key, count = np.unique(place * BUCKETS + bucket, return_counts=True)
        cells[key] = count
        dot = v[: len(part)] @ across  # counts are small: products are exact
        cells[key] = 0
        own = np.bincount(key // BUCKETS, count * count, len(part)).astype(np.int64)
        term, token = np.nonzero(dot)
        d, a, b = dot[term, token].astype(np.int64), own[term], norm[token]
        if (d < 3000).all():
            c = np.minimum(np.floor(np.sqrt((d**2 * 10**12 // (a * b)).astype(np.float64))), SCALE)
        else:
            c = [cosine(int(x), int(y), int(z)) for x, y, z in zip(d, a, b, strict=True)]
        out[lo + term, token] = c
    return out


def nearest(postings: DataFrame, tokens: list[str], documents: DataFrame | None = None) -> DataFrame:
    """(id, token, best): the largest cosine of each token to any term of each document, above 0.

    With documents (id, terms), these are read as they are. Otherwise postings are dealt out by id, once. A task compares its own terms
    with the tokens, each once in a slice, and keeps the largest cosine of a document. So no pair of posting and token is ever written.
    """
    if documents is not None:
        held = documents.select("id", "terms")
    else:
        held = postings.select("id", "term")
        held = held.repartition(tasks(held, held.count(), DEALT), "id").sortWithinPartitions("id")
    out = None
    for i in range(0, len(tokens), BLOCK):
        block = tokens[i : i + BLOCK]
        part = held.mapInArrow(lambda batches, block=block: _best(batches, block), "id string, token string, best long")
        out = part if out is None else out.unionByName(part)
    return out


def _slices(batches, room: int):
    """Batches of (id, term) or (id, terms), sorted by id -> (ids, first, terms): slices of `room` terms, with where each id begins."""
    ids, sizes, terms, held = [], [], [], 0

    def slices():
        size, names, flat = np.concatenate(sizes), pa.concat_arrays(ids), pa.concat_arrays(terms)
        begin = np.cumsum(size) - size
        for lo in range(0, len(flat), room):
            a, z = int(np.searchsorted(begin, lo, "right")) - 1, int(np.searchsorted(begin, lo + room))
            yield names.slice(a, z - a).to_pylist(), np.maximum(begin[a:z] - lo, 0), flat.slice(lo, room)

    for b in batches:
        if pa.types.is_list(b.schema.field(1).type):
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(size)
            ids.append(b.column(0).take(pa.array(some)))
            sizes.append(size[some].astype(np.int64))
            terms.append(b.column(1).flatten())
        elif b.num_rows:
            code = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            ids.append(b.column(0).take(pa.array(first)))
            sizes.append(np.diff(np.append(first, len(code))))
            terms.append(b.column(1))
        held += len(terms[-1]) if terms else 0
        if held >= room:
            yield from slices()
            ids, sizes, terms, held = [], [], [], 0
    if held:
        yield from slices()


def _best(batches, block: list[str]):
    """Batches of (id, term) or (id, terms), sorted by id -> of (id, token, best)."""
    q, names = vectors(block), pa.array(block, pa.string())

    def out(ids: list, best: np.ndarray):
        doc, token = np.nonzero(best)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()).take(pa.array(doc)), names.take(pa.array(token)), pa.array(best[doc, token].astype(np.int64))], names=["id", "token", "best"])

    last, best = None, None  # the document that may go on in the next slice
    for ids, first, terms in _slices(batches, min(COMPARED, max(1, REMEMBERED // len(block)))):
        code = terms.dictionary_encode()
        most = np.maximum.reduceat(arrow_cosines(code.dictionary, q)[code.indices.to_numpy()], first)
        if last is not None:
            if ids[0] == last:
                most[0] = np.maximum(most[0], best)
            else:
                yield out([last], best[None, :])
        last, best = ids[-1], most[-1].copy()
        if len(ids) > 1:
            yield out(ids[:-1], most[:-1])
    if last is not None:
        yield out([last], best[None, :])


def similarities(postings: DataFrame, vocabulary: DataFrame, queries: DataFrame, hits: DataFrame | None = None, floor: int = 0, documents: DataFrame | None = None) -> DataFrame:
    """(qid, id, sim): the average, over a query's tokens with repeats, of the best cosine to any term of the document; above 0.

    With hits (qid, id): only of these, and of what reaches `floor`. documents (id, terms), if there are: the same as postings.
    """
    tokens = queries.select("qid", F.explode(tk.tokenize(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("times"))
    distinct = sorted(r.token for r in tokens.select("token").distinct().collect())  # a query's own words
    if not distinct:
        return postings.select(F.lit(0).cast("long").alias("qid"), "id", F.lit(0).cast("long").alias("sim")).limit(0)
    asked = small(tokens.join(tokens.groupBy("qid").agg(F.sum("times").alias("n")), "qid"))
    rows = nearest(postings, distinct, documents).join(asked, "token")
    if hits is None:
        return _averages(rows.withColumn("least", F.lit(1)))
    sims = _averages(rows.withColumn("least", F.lit(1))).join(hits.select("qid", "id", F.lit(True).alias("hit")), ["qid", "id"], "left")
    return sims.where(F.col("hit") | (F.col("sim") >= floor)).drop("hit")


def _averages(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("qid", "id", "n", "least").agg(F.sum(F.coalesce("best", F.lit(0)) * F.col("times")).alias("total"))
    return sums.select("qid", "id", fx.div("total", "n").alias("sim"), "least").where("sim >= least").drop("least")
