"""What the corpus operators share: tables, shared storage, samples of bounded size, text as arrays."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bounded sample are chosen by a hash modulo this.
HASH_SPACE = 1 << 20
#: Files for each core of what is scanned.
SCAN = 16
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own, which only a local master may use."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="strandex-")
        spark.sparkContext.setCheckpointDir(at)
    return at


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession):
    """Shuffle files of what is written meanwhile go when the write ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before) if before is not None else spark.conf.unset(_FREED)


def saved(df: DataFrame, name: str, waves: int = 4, rows: int | None = None, each: int = 1_000_000) -> DataFrame:
    """Written as a table in the shared folder and read again: lineage ends there, and nothing is computed twice.

    In `waves` files for each core at most, but a file for two scanned or 16 shuffled partitions at least; where a bound of the
    rows is known, in one for each so many rows at most. waves: SCAN for what comes straight from a scan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandex-{name}-{uuid.uuid4().hex}"
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(waves * spark.sparkContext.defaultParallelism, shuffled // (2 if waves >= SCAN else 16))
    df = df.coalesce(files if rows is None else min(files, 1 + rows // each))
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandex_path = path
    return out


def used_up(*tables: DataFrame) -> None:
    """Deletes tables of `saved` that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._strandex_path)


def row_key() -> list:
    """A row's identity by id and text, in two hashes of 64 bits: rows that are the same in both share it."""
    text = F.col("text").cast("string")
    return [F.xxhash64("doc_id", text).alias("r1"), F.xxhash64(F.lit("strandex"), text, F.col("doc_id")).alias("r2")]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be over
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def hash_share(col: str, share: float):
    """True for about that share of the ids, the same ones on every run."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(HASH_SPACE)) < F.lit(int(min(1.0, share) * HASH_SPACE))


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, bound: int, where=None, longest: int = 1 << 16) -> DataFrame:
    """(doc_id, text, <value>) of about `bound` labelled documents at most, chosen by a hash of the id, each of `longest` bytes at most.

    An id labelled more than once counts once, with its smallest value; null ids and null values count for nothing. Of an id that
    several rows have, the row with the smallest hash of its text is taken; rows with longer texts are no training rows. So rows
    number no more than the chosen labels, which number about `bound` (binomial around it), and all texts together take bound *
    longest bytes at most, however many rows share an id.
    """
    lab = labels.where(F.col(value).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        lab = lab.where(where)
    n = lab.agg(F.count("*")).first()[0]
    chosen = lab.where(hash_share("doc_id", bound / max(n, 1))).groupBy("doc_id").agg(F.min(value).alias(value))
    text = F.col("text").cast("string")
    rows = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= longest).select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"), F.min(value).alias(value))
    return one.select("doc_id", F.col("row.text").alias("text"), value)


def texts(batch) -> list[str]:
    """The text column of a record batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def lengths(batch) -> list[int]:
    """Characters of each text of a record batch, without making the texts; null counts as empty."""
    return pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index("text"))), 0).to_pylist()


def sliced(batches, most: int, column: str = "text"):
    """Record batches with about `most` bytes in the column at most, or one row; freed memory goes back to the system after each."""
    for b in batches:
        for i, j in slices(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_pylist(), most):
            yield b.slice(i, j - i)
        trim()


def trim() -> None:
    """Gives what is freed back to the system: a worker is used again and would keep the peak of each job it had."""
    import ctypes  # here: a module that travels by value can't hold a library

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on uint64."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE, _POWERS = np.uint64(0x9E3779B97F4A7C15), {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down), byte=mixed(np.arange(1, 257, dtype=np.uint64) * _BASE))
    return _POWERS["up"], _POWERS["down"], _POWERS["byte"]


class Words:
    """The words of some texts as arrays: runs of bytes that are not ASCII white space, in order, one space between two.

    buf: bytes; start, end: of each word in buf; first: index of each text's first word (and, last, the number of words).
    """

    def __init__(self, texts: list[str], lower: bool = False):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        split = [(p.lower() if lower else p).split() for p in parts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        words = [w for s in split for w in s]
        self.buf = np.frombuffer(b" ".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes

    def sums(self) -> np.ndarray:
        """Prefix sums of the bytes' random values times powers of an odd base: hashes of substrings are differences of these."""
        up, _, byte = _powers(len(self.buf))
        out = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(byte[self.buf] * up[: len(self.buf)], out=out[1:])
        return out

    def hashes(self, start: np.ndarray, end: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * _powers(len(self.buf))[1][start])


def slices(sizes: list[int], most: int):
    """Ranges of rows whose sizes add up to about `most`; a row larger than that has its own."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
