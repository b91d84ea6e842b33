"""Language identification by rank-order profiles.

A profile is the TOP most frequent letter n-grams (one to three letters of any script, words padded with a space), in order of
frequency. A document's profile is compared with each language's by the out-of-place distance: the sum of the differences of ranks, TOP for
an n-gram that the language does not have.

Defined cases: null text, or text without a letter: `und` with score 0; a null doc_id counts as not held out; ties go to the
n-gram with the smaller code and the language first by name; without any learned language everything is `und`.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

TOP = 300
#: Bytes of text that are Python objects at a time.
SLICE = 2 << 20
_IDS: list[np.ndarray] = []


#: Bits of a letter's own number: letters are fewer than 1 << 18, so three fit a code.
LETTER = 18


def _ids() -> np.ndarray:
    """A number for every code point: 0 for what is not a letter, else one of its own."""
    if not _IDS:
        letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
        _IDS.append(np.where(letters, np.cumsum(letters), 0).astype(np.int32))
    return _IDS[0]


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, with repeats."""
    ids = _ids()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = (ids > 0) | (np.concatenate([[1], ids[:-1]]) > 0)
    a = np.concatenate([[0], ids[keep], [0]]).astype(np.int64)
    if not a.any():
        return np.zeros(0, np.int64)
    two = a[:-1] << LETTER | a[1:]
    three = two[:-1] << LETTER | a[2:]
    return np.concatenate([a[a > 0], two[two > 0] | 1 << 3 * LETTER, three[a[1:-1] > 0] | 2 << 3 * LETTER])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.nonzero(np.diff(codes, prepend=-1))[0]
    return codes[at], np.diff(np.append(at, len(codes)))


def profile(codes: np.ndarray) -> np.ndarray:
    """The TOP most frequent codes, most frequent first."""
    code, count = counted(codes)
    if len(code) > TOP:  # those above the count of the last place, and the smallest codes of those at it
        last = np.partition(count, len(count) - TOP)[len(count) - TOP]
        held = np.concatenate([np.flatnonzero(count > last), np.flatnonzero(count == last)])[:TOP]
        code, count = code[held], count[held]
    return code[np.lexsort((code, -count))]


class Profiles:
    def __init__(self, learned: dict[str, list[int]]):
        self.langs = sorted(learned)
        self.codes = np.unique(np.concatenate([np.array(learned[x], np.int64) for x in self.langs])) if self.langs else np.zeros(0, np.int64)
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, x in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, learned[x])] = np.arange(len(learned[x]))

    def predict(self, text: str) -> tuple[str, float]:
        """Language, and 1 less the distance as a share of the largest possible."""
        p = profile(grams(text))
        if not len(p) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, p), len(self.codes) - 1)
        r = self.rank[:, np.where(self.codes[at] == p, at, len(self.codes))]
        d = np.where(r < 0, TOP, np.abs(r - np.arange(len(p)))).sum(1)
        best = int(np.argmin(d))
        return self.langs[best], float(1 - d[best] / (TOP * len(p)))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int) -> Profiles:
    """Profiles from about `per_language` documents of each language, chosen by a hash of the id."""
    train = docs.where(F.col("lang").isNotNull() & ~held_out())
    shares = {r.lang: per_language / r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for lang, share in shares.items():
        chosen = chosen | ((F.col("lang") == lang) & common.hash_share("doc_id", share))

    def run(batches):
        for b in common.sliced(batches, SLICE):
            by: dict[str, list] = {}
            for lang, t in zip(b.column(0).to_pylist(), common.texts(b), strict=True):
                by.setdefault(lang, []).append(grams(t))
            for lang, parts in by.items():
                code, n = counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    top = W.partitionBy("lang").orderBy(F.desc("n"), "code")
    counts = train.where(chosen).select("lang", F.col("text").cast("string")).mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    learned: dict[str, list] = {}
    for r in sorted(counts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= TOP).collect(), key=lambda r: (r.lang, r["rank"])):
        learned.setdefault(r.lang, []).append(r.code)
    return Profiles(learned)


def identify(docs: DataFrame, per_language: int = 1_000) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    model = learn(docs, per_language)

    def run(batches):
        for b in common.sliced(batches, SLICE):
            got = [model.predict(t) for t in common.texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
