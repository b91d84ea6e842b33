"""Toxicity as severity grades by cumulative-link ordinal regression.

Features are sparse: how often a text holds each telling word or word beginning, chosen by how much (log-likelihood ratio) they tell
toxic from other training documents; texts given several times count once. Grades run from 0 (harmless) to GRADES. Labels say
only toxic or not, so the grade of a toxic training document comes from how clearly the labels of other documents make it
toxic: a regression with a single threshold is fitted on either half of the documents, and the log odds that it gives to those of
the other half are cut in thirds. Then one weight vector is fitted to all grades, shared by all thresholds, P(grade >= j) =
sigmoid(w.x - threshold_j), thresholds ascending. Severity is the expected grade, the sum of these probabilities.

Words are counted in the executors; the driver gets at most `most` features and the sparse counts of the `sample` training
documents in them.

Defined cases: a null or empty text has no feature and gets the severity of one; repeated rows get a row each; a null doc_id is
returned as it is; without labels of both kinds severity is 0 and nothing is toxic; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRADES, BEGINNING = 3, 4
#: Bytes of text that are Python objects at a time.
SLICE = 4 << 20
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> Counter:
    """How often a text holds each word, and (with a star) each beginning of longer words."""
    words = Counter(_WORD.findall(text.lower()))
    for w, n in list(words.items()):
        if len(w) > BEGINNING:
            words[w[:BEGINNING] + "*"] += n
    return words


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.weight, self.cuts = dict(zip(names, weights.tolist(), strict=True)), cuts
        self.begins = frozenset(n[:-1] for n in names if n[-1] == "*")

    def tail(self, text: str) -> np.ndarray:
        """P(grade >= j) for j from 1."""
        if not self.weight:
            return np.zeros(GRADES)
        z, begun = 0.0, Counter()
        for w, n in Counter(_WORD.findall(text.lower())).items():
            if w in self.weight:
                z += self.weight[w] * np.log1p(n)
            if len(w) > BEGINNING and w[:BEGINNING] in self.begins:
                begun[w[:BEGINNING]] += n
        z += sum(self.weight[w + "*"] * np.log1p(n) for w, n in begun.items())
        return 1 / (1 + np.exp(np.clip(self.cuts - z, -30, 30)))


def telling(counts: DataFrame, toxic: int, rest: int, least: float, most: int) -> list[str]:
    """The features that tell most for toxic: signed root of the log-likelihood ratio above `least`, `most` at most.

    counts: (feature, a: toxic documents with it, b: others).
    """
    share = (F.col("a") + F.col("b")) / F.lit(toxic + rest)
    part = lambda n, m: F.when(n > 0, n * F.log(n / m)).otherwise(0.0)
    ratio = part(F.col("a"), toxic * share) + part(F.col("b"), rest * share) + part(toxic - F.col("a"), toxic * (1 - share)) + part(rest - F.col("b"), rest * (1 - share))
    best = counts.where(F.col("a") * rest > F.col("b") * toxic).withColumn("z", F.round(F.sqrt(F.greatest(F.lit(0.0), 2 * ratio)), 6)).where(F.col("z") > least).orderBy(F.desc("z"), "feature").limit(most)
    return [r.feature for r in best.select("feature").collect()]


def _cuts(gap: np.ndarray) -> np.ndarray:
    return gap[0] + np.concatenate([[0], np.cumsum(np.exp(gap[1:]))])


def regression(row: np.ndarray, column: np.ndarray, x: np.ndarray, width: int, grade: np.ndarray, grades: int, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of a cumulative-link regression on sparse features; Adam over whole rounds."""
    n, reached = len(grade), grade[:, None] >= np.arange(1, grades + 1)
    p = [np.zeros(width), np.array([2.0] + [0.5] * (grades - 1))]  # weights; the first threshold, then log steps upward
    mom, sq = ([np.zeros_like(v) for v in p] for _ in range(2))
    for step in range(1, rounds + 1):
        w, gap = p
        d = (1 / (1 + np.exp(np.clip(_cuts(gap) - np.bincount(row, x * w[column], n)[:, None], -30, 30))) - reached) / n
        dc = -d.sum(0)
        for v, g, m, s in zip(p, (np.bincount(column, x * d.sum(1)[row], width) + decay * w, np.array([dc.sum(), *(dc[k:].sum() * np.exp(gap[k]) for k in range(1, grades))])), mom, sq, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return p[0], _cuts(p[1])


def graded(odds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grade of each document: 0, or 1 and as many thirds of the toxic documents' log odds as its own are above."""
    thirds = np.quantile(odds[toxic], [k / GRADES for k in range(1, GRADES)])
    return np.where(toxic, 1 + (odds[:, None] > thirds).sum(1), 0)


def fit(names: list[str], row: np.ndarray, column: np.ndarray, times: np.ndarray, toxic: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """names: of the features; row, column, times: sparse counts; toxic: of each training document."""
    if not len(toxic) or toxic.all() or not toxic.any() or not names:
        return Model([], np.zeros(0), np.zeros(GRADES))
    n, x, odds = len(toxic), np.log1p(times), np.zeros(len(toxic))
    half = np.arange(n) % 2
    for k in (0, 1):
        at, other = half[row] == k, half == 1 - k
        w, cut = regression(row[at] // 2, column[at], x[at], len(names), toxic[half == k].astype(int), 1, rounds, rate, decay)
        odds[other] = np.bincount(row, x * w[column], n)[other] - cut[0]
    return Model(names, *regression(row, column, x, len(names), graded(odds, toxic), GRADES, rounds, rate, decay))


def train(docs: DataFrame, labels: DataFrame, sample: int, least: float, most: int) -> Model:
    rows = common.labelled_sample(docs, labels, "toxic", sample).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.col("toxic") == 1).alias("toxic"))
    known = common.saved(rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic"), "toxic", rows=sample)
    kinds = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}

    def seen(batches):
        for b in common.sliced(batches, SLICE):
            by: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for t, toxic in zip(common.texts(b), b.column(2).to_pylist(), strict=True):
                by[toxic].update(features(t).keys())
            names = list(by[True].keys() | by[False].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([by[k][w] for w in names], pa.int64()) for k in (True, False))], names=["feature", "a", "b"])

    counts = known.mapInArrow(seen, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    names = telling(counts, kinds.get(True, 0), kinds.get(False, 0), least, most) if len(kinds) == 2 else []
    at = {w: i for i, w in enumerate(names)}

    def held(batches):
        for b in common.sliced(batches, SLICE):
            got = [[(at[w], n) for w, n in features(t).items() if w in at] for t in common.texts(b)]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([[p[k] for p in sorted(g)] for g in got], lists) for k in (0, 1))], names=["doc_id", "toxic", "at", "times"])

    rows = sorted(known.mapInArrow(held, "doc_id long, toxic boolean, at array<long>, times array<long>").collect(), key=lambda r: (r.doc_id, r["at"], r.times)) if names else []
    common.used_up(known)
    flat = lambda c: np.array([v for r in rows for v in r[c]], np.int64)
    return fit(names, np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows]), flat("at"), flat("times"), np.array([r.toxic for r in rows], bool))


def _scorer(model: Model):
    def run(batches):
        for b in common.sliced(batches, SLICE):
            p = np.array([model.tail(t) for t in common.texts(b)]).reshape(-1, GRADES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)], names=["doc_id", "severity", "grade", "toxic_pred"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6_000, least: float = 4.0, most: int = 2_000) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, severity (0 to GRADES), grade, toxic_pred.

    sample bounds the training documents, most the features; least: how much a feature must tell.
    """
    model = train(docs, labels, sample, least, most)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scorer(model), "doc_id long, severity double, grade int, toxic_pred boolean")


def harmless(docs: DataFrame, labels: DataFrame, sample: int = 6_000, least: float = 4.0, most: int = 2_000) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    model, at, schema = train(docs, labels, sample, least, most), docs.columns.index("text"), docs.schema

    def run(batches):
        for b in common.sliced(batches, SLICE):
            yield b.filter(pa.array([model.tail(t or "")[0] < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
