"""Quality rules by an isolation forest over rule statistics.

Every document gets rule statistics as they are, without limits of their own: mean word length, shares of symbols, of repeated
words, of capitals and of other signs, how its distinct words grow with its words, and the share of words that begin with a
letter. Random splits over a bounded sample of statistics isolate unusual rows on short paths; the path length over all trees is
the anomaly score, and the threshold comes from all labelled rows: the one that catches most low-quality rows among those that
reject at most `max_false` of the good ones. That trees draw few rows (256 each) is the method: grown on all rows they tell less.

Defined cases: a null text counts as an empty one (zero words, base_failed); repeated rows get a row each; a null doc_id is
returned as it is; without labels of both kinds nothing beyond the base rule is rejected; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS, BLANK = "#*$%&|<>", " \t\n\x0b\x0c\r"
_WORDY = re.compile(r"[^\x20\x09-\x0D]")
FEATURES = 7
#: Bytes of text that are Python objects at a time.
SLICE = 4 << 20
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, f array<float>"


def repeated_words(words: list) -> tuple[int, int]:
    """(words in 3-word windows that occur twice or more, distinct words)."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n, v = len(words), len(ids)
    if n < 4:
        return 0, v
    a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    pair = a[:-1] * v + a[1:]
    if v >= 1 << 20:  # else three ids fit 63 bits
        pair, v = np.unique(pair, return_inverse=True)[1], v
    key = pair[:-1] * v + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    mark = np.zeros(n, bool)
    mark[:-2] |= hit
    mark[1:-1] |= hit
    mark[2:] |= hit
    return int(mark.sum()), len(ids)


def rule_stats(text: str) -> tuple[list[int], list[float]]:
    """The five base counts of a text, and the statistics that the forest splits on."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if _WORDY.search(x)] if n else []
    dup = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=4) if n else np.zeros(4)
    lettered = sum(1 for w in words if w[:1].isalpha() or w[0] > 127)
    total, per = max(len(raw), 1), max(n, 1)
    f = [chars / per, symbols / max(chars, 1), repeat / per, np.log1p(distinct) / np.log1p(per), kinds[1] / total, kinds[3] / total, lettered / per]
    return [n, chars, symbols, dup, repeat], [float(x) for x in f]


#: Kinds of bytes: capitals, digits, other ASCII signs.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def statistics(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("f", pa.list_(pa.float32()))])

    def run(batches):
        for b in common.sliced(batches, SLICE):
            rows = [rule_stats(t) for t in common.texts(b)]
            base = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(base[:, i]) for i in range(5)), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STATS)


class Forest:
    """Trees as arrays: node i splits on feature[i] at value[i]; leaves hold the expected path length."""

    def __init__(self, x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        rng, self.trees = np.random.default_rng(seed), []
        size = min(sample, len(x))
        self.norm = max(self.average(size), 1e-9)
        for _ in range(trees if size > 1 else 0):
            feature, value, child, length = [], [], [], []

            def grow(rows, depth):
                at = len(feature)
                feature.append(-1), value.append(0.0), child.append((at, at)), length.append(depth + self.average(len(rows)))
                spread = np.nonzero(rows.min(0) < rows.max(0))[0]
                if depth < np.ceil(np.log2(size)) and len(rows) > 1 and len(spread):
                    k = rng.choice(spread)
                    cut = rng.uniform(rows[:, k].min(), rows[:, k].max())
                    feature[at], value[at] = int(k), float(cut)
                    child[at] = (grow(rows[rows[:, k] <= cut], depth + 1), grow(rows[rows[:, k] > cut], depth + 1))
                return at

            grow(x[rng.choice(len(x), size, replace=False)], 0)
            self.trees.append((np.array(feature), np.array(value), np.array(child), np.array(length)))

    @staticmethod
    def average(n: int) -> float:
        """Expected path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: stands more alone."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, child, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                k = feature[at]
                at = np.where(inner, child[at, (x[rows, np.maximum(k, 0)] > value[at]).astype(np.int64)], at)
            total += length[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / self.norm) if self.trees else np.zeros(len(x))


#: Bins of a range of scores that are counted at a time.
BINS = 4096


def threshold(known: DataFrame, max_false: float) -> float:
    """known (anomaly, good) -> just above the score that at most max_false of the good rows exceed; infinite without rows of both kinds.

    Exact, from all rows: the good ones are counted in bins, then in bins of the bin that holds that score, until it is one value.
    """
    n, clean, low, high = known.agg(F.count("*"), F.count_if("good"), F.min(F.when(F.col("good"), F.col("anomaly"))), F.max(F.when(F.col("good"), F.col("anomaly")))).first()
    if not clean or clean == n:
        return float("inf")
    above = int(max_false * clean)  # good rows over the score, and beside it in its bin
    while low < high:
        place = F.least(F.floor((F.col("anomaly") - low) / (high - low) * BINS), F.lit(BINS - 1))
        inside = known.where(F.col("good") & F.col("anomaly").between(low, high))
        for r in inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("anomaly").alias("low"), F.max("anomaly").alias("high")).orderBy(F.desc("bin")).collect():
            if above < r.n:
                low, high = r.low, r.high
                break
            above -= r.n
    return float(np.nextafter(low, 2))


def _one_each(rows: DataFrame, *more) -> DataFrame:
    """One row for each doc_id, that with the smallest hash of its statistics: samples stay bounded however many rows share an id."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("f").alias("h"), "f")).alias("row"), *more).withColumn("f", F.col("row.f"))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, max_false: float = 0.005) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> the base counts, base_failed, anomaly (0 to 1) and kept.

    sample bounds the rows that the trees draw theirs from, one for each id; the threshold is that of all labelled rows.
    """
    stats = common.saved(statistics(docs), "rules", common.SCAN)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = stats.where(~failed)
    n = passed.agg(F.count("*")).first()[0]
    grown = np.array([r.f for r in _one_each(passed.where(common.hash_share("doc_id", sample / max(n, 1)))).orderBy(F.xxhash64("doc_id"), "f").select("f").collect()], float).reshape(-1, FEATURES)
    forest = Forest(grown)

    def run(batches):
        for b in batches:
            x = np.array(b.column(b.num_columns - 1).to_pylist(), float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(forest.score(x))], names=[*b.schema.names[:-1], "anomaly"])

    base = [c for c in stats.columns if c != "f"]
    scored = stats.select(*base, F.xxhash64("f").alias("h"), "f").mapInArrow(run, STATS.replace(", f array<float>", ", h long, anomaly double"))
    scored = common.saved(scored, "scored", common.SCAN)
    quality = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # an id counts with one row, that of the smallest hash
    known = scored.where(~failed).groupBy("doc_id").agg(F.min(F.struct("h", "anomaly")).alias("row")).join(quality, "doc_id")
    cut = threshold(common.saved(known.select("row.anomaly", (F.col("quality") == 1).alias("good")), "known"), max_false)
    return scored.drop("h").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < cut))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
