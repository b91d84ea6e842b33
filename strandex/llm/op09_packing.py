"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours for each seed document, which fill its window.

A document of WINDOW tokens or more is cut into full windows and a rest. The rests are put in an order of content and cut into
shards of about SHARD documents: a tree of centres, learnt from a bounded sample, gives each document a leaf, and within a leaf
documents are in the order of their nearness to its centre. So copies are side by side, however many they are, and documents of
one leaf share a shard or lie in adjacent ones. A shard holds an inverted index over all tokens of its documents with their frequencies; every
token counts with its idf, however frequent it is, with the document frequencies and the mean length of the whole corpus. The
longest unused document is the seed of the next window, its distinct tokens are the query; its neighbours in the order of their
BM25 score fill the room, and what room is left takes the longest unused that fit.

A seed asks its own shard only: a neighbour that the tree puts elsewhere isn't found. README has the measured share of nearest
documents that are.

Defined cases: a null or empty text is the end-of-text token alone; repeated rows are packed once for each row; a null doc_id
is returned as it is; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SHARD, END = 2048, 1500, 1
K1, B = 1.2, 0.75
#: Directions that documents are projected on; documents that the tree learns from, and of them for a leaf at least; leaves for a shard.
DIRECTIONS, SAMPLE, LEAST, LEAVES = 256, 30_000, 10, 3
#: A term that more than one in so many documents of a shard hold is scored by a matrix; the scores are the same.
HOT = 16
#: Texts of these characters only take the quick path, where both libraries agree on every class of characters.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_LOADED: dict = {}


def tokenizer(path: str):
    """text -> ids: the vocabulary of a tokenizers file; by the quicker library where the same vocabulary lies beside it as ranks."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        ranks, quick = path.removesuffix(".json") + ".tiktoken", None
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})

        def encode(text: str) -> list[int]:
            if quick is not None and not _PLAIN.search(text) and "<|" not in text:
                return quick.encode_ordinary(text)
            return exact.encode(text, add_special_tokens=False).ids

        _LOADED[path] = encode
    return _LOADED[path]


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, spread, tokens, crcs of the full windows and of the rest, terms, times: how often each occurs): spread is a hash that differs for repeated rows too."""

    def run(batches):
        encode, seen = tokenizer(path), 0
        part = TaskContext.get().partitionId()
        for b in batches:
            spread, tokens, crcs, terms, times = [], [], [], [], []
            for doc, t in zip(b.column(0).to_pylist(), common.texts(b), strict=True):
                ids = np.array([*encode(t), END], "<u4")
                tokens.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + WINDOW].tobytes()) for i in range(0, len(ids), WINDOW)])
                distinct, n = np.unique(ids, return_counts=True) if len(ids) % WINDOW else (ids[:0], ids[:0])
                terms.append(distinct.tobytes())
                times.append(n.astype("<u4").tobytes())
                spread.append(zlib.crc32(f"{doc}:{part}:{seen}".encode()))
                seen += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spread, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "spread", "tokens", "crcs", "terms", "times"])
            common.trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spread long, tokens long, crcs array<long>, terms binary, times binary")


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Stats:
    """Of a corpus (terms, tokens): idf by token ID, mean number of tokens of the documents."""

    def __init__(self, tokens: DataFrame):
        def counts(batches):
            total = np.zeros(0, np.int64)
            for b in batches:
                c = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"))
                total, c = (total, c) if len(total) >= len(c) else (c, total)
                total[: len(c)] += c
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

        rests = tokens.where(F.octet_length("terms") > 0)
        self.n, self.mean = rests.agg(F.count("*"), F.coalesce(F.avg("tokens"), F.lit(0.0))).first()
        table = rests.select("terms").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        term, n = table["term"].to_numpy(), table["n"].to_numpy()
        df = np.zeros(int(term.max()) + 1 if len(term) else 0, np.int64)
        df[term] = n
        self.idf = _idf(self.n, df)

    @classmethod
    def of(cls, n: int, mean: float, idf: np.ndarray) -> Stats:
        out = cls.__new__(cls)
        out.n, out.mean, out.idf = n, mean, idf
        return out


def directions(idf: np.ndarray) -> np.ndarray:
    """A row for each token ID: random signs times its idf."""
    signs = np.random.Generator(np.random.PCG64(9)).integers(0, 2, (len(idf), DIRECTIONS), np.int8)
    return (signs * np.float32(2) - 1) * idf.astype(np.float32)[:, None]


def vectors(terms: list[bytes], along: np.ndarray) -> np.ndarray:
    """Unit vectors whose products are about the cosines of the documents' idf vectors."""
    out = np.zeros((len(terms), DIRECTIONS), np.float32)
    for i, t in enumerate(terms):
        np.add.reduce(along[np.frombuffer(t, "<u4")], axis=0, out=out[i])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the centres are in the order of their first principal component."""
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        order = np.argsort(at, kind="stable")
        found, start = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        c[found] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    _, _, axes = np.linalg.svd(c - c.mean(0), full_matrices=False)
    return c[np.argsort(c @ axes[0], kind="stable")]


class Tree:
    """Two levels of centres over a sample, with about so many leaves."""

    def __init__(self, x: np.ndarray, leaves: int):
        leaves = max(1, min(len(x) // LEAST, leaves))
        k = max(1, round(leaves**0.5))
        self.top = centres(x, min(k, len(x)))
        at = (x @ self.top.T).argmax(1)
        groups = [x[at == i] for i in range(len(self.top))]
        self.below = [centres(g, max(1, min(len(g), round(leaves * len(g) / len(x))))) if len(g) else self.top[i : i + 1] for i, g in enumerate(groups)]

    @classmethod
    def of(cls, top: np.ndarray, below: list[np.ndarray]) -> Tree:
        out = cls.__new__(cls)
        out.top, out.below = top, below
        return out

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each document, and its nearness to the leaf's centre in 1/4096."""
        at = (x @ self.top.T).argmax(1)
        leaf, near = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in np.unique(at):
            here = np.nonzero(at == i)[0]
            s = x[here] @ self.below[i].T
            b = s.argmax(1)
            leaf[here], near[here] = (int(i) << 20) + b, np.rint(s[np.arange(len(here)), b] * 4096)
        return leaf, near


class Index:
    """BM25 over the documents of a shard.

    times: how often each of a document's terms occurs (once, if not given); stats: those of the corpus that the shard is part
    of; without them the shard is the corpus.
    """

    def __init__(self, terms: list[np.ndarray], stats: Stats | None = None, times: list[np.ndarray] | None = None):
        n = len(terms)
        size = np.array([len(t) for t in terms], np.float64)
        tf = np.concatenate([*(times or [np.ones(len(t)) for t in terms]), np.zeros(0)]).astype(np.float64)
        doc = np.repeat(np.arange(n), size.astype(np.int64))
        self.vocabulary, term = np.unique(np.concatenate([*terms, np.zeros(0, "<u4")]), return_inverse=True)
        self.of = np.split(term, np.cumsum(size.astype(np.int64))[:-1])
        order = np.argsort(term, kind="stable")
        self.docs = doc[order]
        df = np.bincount(term, minlength=len(self.vocabulary))
        self.head = np.concatenate([[0], np.cumsum(df)])
        idf = stats.idf[self.vocabulary] if stats else _idf(n, df)
        length = np.bincount(doc, tf, n) if n else size
        norm = K1 * (1 - B + B * length / max(stats.mean if stats else length.mean(), 1e-9)) if n else size
        self.weight = idf[term[order]] * tf[order] * (K1 + 1) / (tf[order] + norm[self.docs])
        # a term of one document tells of no other; those that many share are held as rows of a matrix, the others as postings
        hot = df > max(2, n // HOT)
        self.listed, at = (df > 1) & ~hot, np.nonzero(hot[term])[0]
        row = (np.cumsum(hot) - 1)[term[at]]
        self.has, self.shared = np.zeros((n, hot.sum())), np.zeros((hot.sum(), n))
        self.has[doc[at], row] = 1
        at = np.nonzero(hot[term[order]])[0]
        self.shared[(np.cumsum(hot) - 1)[term[order][at]], self.docs[at]] = self.weight[at]
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        t = self.of[seed]
        t = t[self.listed[t]]
        size = self.head[t + 1] - self.head[t]
        at = np.repeat(self.head[t] - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum())
        return np.round(np.bincount(self.docs[at], weights=self.weight[at], minlength=self.n) + self.has[seed] @ self.shared, 9)


def pack(sizes: np.ndarray, index: Index, window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of documents, every document in one."""
    n = len(sizes)
    free, by_size = np.ones(n, bool), np.argsort(-sizes, kind="stable")
    sorted_sizes, out = -sizes[by_size], []  # ascending
    for seed in by_size:
        if not free[seed]:
            continue
        free[seed] = False
        room, held = window - int(sizes[seed]), [int(seed)]
        if room > 0:
            s = index.scores(int(seed))
            near = np.nonzero(free & (s > 0) & (sizes <= room))[0]
            for d in near[np.lexsort((near, -s[near]))]:
                if sizes[d] <= room:
                    room -= int(sizes[d])
                    free[d] = False
                    held.append(int(d))
                    if not room:
                        break
            i = int(np.searchsorted(sorted_sizes, -room))
            while room and i < n:  # the longest unused that fit
                d = by_size[i]
                if free[d] and sizes[d] <= room:
                    room -= int(sizes[d])
                    free[d] = False
                    held.append(int(d))
                i += 1
        out.append(held)
    return out


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def placed(tokens: DataFrame, stats: Stats, shard: int = SHARD) -> DataFrame:
    """tokens with the columns leaf and near, which put documents in an order of content; documents without a rest are anywhere."""
    sc = tokens.sparkSession.sparkContext
    some = tokens.where(F.octet_length("terms") > 0).where(F.col("spread") < int(min(1.0, SAMPLE / max(stats.n, 1)) * (1 << 32))).orderBy("spread").select("terms").toArrow()
    sample = vectors(some["terms"].to_pylist(), directions(stats.idf)) if len(some) else np.zeros((1, DIRECTIONS), np.float32)
    tree = Tree(sample, LEAVES * stats.n // shard)
    held = sc.broadcast((tree.top, tree.below, stats.idf))  # arrays: workers that lack this package can't read its objects

    def run(batches):
        top, below, idf = held.value
        tree, along = Tree.of(top, below), directions(idf)
        for b in batches:
            leaf, near = tree.places(vectors(b.column("terms").to_pylist(), along))
            whole = np.array(b.column("terms").to_pylist(), object) == b""
            spread = b.column("spread").to_numpy()
            leaf[whole] = spread[whole] % len(tree.top) << 20
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(near)], names=[*b.schema.names, "leaf", "near"])
            common.trim()

    return tokens.mapInArrow(run, "doc_id long, spread long, tokens long, crcs array<long>, terms binary, times binary, leaf long, near long")


def packed(docs: DataFrame, path: str | None = None, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = common.saved(tokenised(docs, path or vocabulary()), "tokens", common.SCAN)
    stats, parts = Stats(tokens), max(1, -(-tokens.count() // (4 * shard)))
    ordered = common.saved(placed(tokens, stats, shard), "placed", common.SCAN).repartitionByRange(parts, "leaf", "near", "spread").sortWithinPartitions("leaf", "near", "spread", "doc_id", "tokens")
    held = docs.sparkSession.sparkContext.broadcast((stats.n, stats.mean, stats.idf))
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        ends, at, sequence = np.linspace(0, len(table), max(1, round(len(table) / shard)) + 1).astype(np.int64), 0, TaskContext.get().partitionId() << 32
        for end in ends[1:]:
            rows, sequence = one(table.slice(at, int(end) - at), sequence)
            at = int(end)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
            common.trim()

    def one(table: pa.Table, sequence: int):
        doc, n, crcs = table["doc_id"].to_pylist(), table["tokens"].to_numpy(), table["crcs"].to_pylist()
        rows = []
        for i in range(len(n)):
            for k in range(int(n[i]) // WINDOW):
                rows.append((doc[i], k * WINDOW, WINDOW, crcs[i][k], int(n[i]), sequence, 0))
                sequence += 1
        rest = np.nonzero(n % WINDOW)[0]
        sizes = (n % WINDOW)[rest]
        terms, times = ([np.frombuffer(x, "<u4") for x in table[c].take(rest).to_pylist()] for c in ("terms", "times"))
        for window in pack(sizes, Index(terms, Stats.of(*held.value), times)):
            at = 0
            for d in window:
                i, size = int(rest[d]), int(sizes[d])
                rows.append((doc[i], int(n[i]) - size, size, crcs[i][-1], int(n[i]), sequence, at))
                at += size
            sequence += 1
        return rows, sequence

    return ordered.mapInArrow(run, OUT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
