"""Line dedup over the suffix array of line-ID sequences, by distributed prefix doubling.

Lines that occur once in the corpus cannot be part of a repeat; the others get line IDs, in order. Rank k of a position orders
(and names) the next 2**k lines: it is the rank of the pair (rank k-1 here, rank k-1 a block further), over the distinct pairs
of the corpus, sorted by range. A position whose pair occurs once leaves. The suffix array is the order of these ranks; the
suffixes whose longest common prefix is n lines or more are an interval of it, which the two blocks of 2**floor(log2 n) lines
that cover the prefix from either end name. Doubling stops where 2**k passes the longest prefix that decides anything.

A repeated run counts if it has `min_words` words or more. Every such run is covered by its minimal blocks: from each line
forward, and back, as few lines as reach min_words. So an interval for each minimal block is enough: its first occurrence, by
(doc_id, line), stays, and the others are later copies. Later blocks that follow one another both here and at their first
occurrence are put together: that is the maximal run, as long as the common prefix of the two suffixes (`runs`). Nothing hot
meets in one task: pairs and blocks are counted with partial sums, and joins on them can be split.

Defined cases: null or empty texts have no line; blank lines are no part of the sequence and stay; lines are compared without
white space at their ends; a block that overlaps its interval's first occurrence stays; null doc_ids come first; rows that are
the same in id and text are one document given twice and get the same result; extra columns are kept by `dedup_lines`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MIN_WORDS, BLANK = 50, " \t\r\x0b\x0c"
#: Bytes of text that are Python objects at a time.
SLICE = 4 << 20
LINES = "r1 long, r2 long, doc_id long, idx int, h1 long, h2 long, ahead int, back int"
ROW = ["r1", "r2"]
#: Rows of a file of ranks.
ROWS = 250_000


def blocks(words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line: how many lines forward, and how many back, with itself, reach `least` words; 0 where the text ends before.

    first: each text's first line and, last, the number of lines.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    i, text = np.arange(len(words)), np.repeat(np.arange(len(first) - 1), np.diff(first))
    to = np.searchsorted(total, total[:-1] + least)
    since = np.searchsorted(total, total[1:] - least, side="right") - 1
    return np.where(to <= first[text + 1], to - i, 0), np.where(since >= first[text], i + 1 - since, 0)


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with a word: its place among them, its hash, and its minimal blocks."""
    schema = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64()}[x.split()[1]]) for x in LINES.split(", ")])

    def run(batches):
        for b in common.sliced(batches, SLICE):
            counts, words, digests = [], [], []
            for t in common.texts(b):
                kept = [x for x in (x.strip(BLANK) for x in t.split("\n")) if x]
                counts.append(len(kept))
                words += [len(x.split()) for x in kept]
                digests += [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in kept]
            first = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
            row, h = np.repeat(np.arange(len(counts)), counts), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            del digests
            ahead, back = blocks(np.array(words, np.int64), first, min_words)
            held = [b.column(i).take(pa.array(row)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(x, k) for x, k in ((np.arange(len(row)) - first[row], pa.int32()), (h[:, 0], pa.int64()), (h[:, 1], pa.int64()), (ahead, pa.int32()), (back, pa.int32())))], schema=schema)

    return docs.select(*common.row_key(), F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LINES)


def ranked(keys: DataFrame, cols: list[str], rank: str) -> DataFrame:
    """keys (distinct) with their rank, ascending in the order of cols."""
    return keys.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(rank, F.monotonically_increasing_id())


def _repeated(rows: DataFrame, cols: list[str]) -> DataFrame:
    return rows.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").drop("n")


def _with_next(level: DataFrame, k: int) -> DataFrame:
    """Rank r of a position, with s: that of the position a block of 2**k lines further."""
    return level.withColumn("s", F.max("r").over(W.partitionBy(*ROW).orderBy("idx").rangeBetween(2**k, 2**k)))


def suffix_ranks(docs: DataFrame, min_words: int) -> list[DataFrame]:
    """Tables (r1, r2, idx, r, s) by k; the first one also has doc_id, ahead, back. Positions of prefixes found once aren't in them."""
    every = lines(docs, min_words)  # read twice: cheaper than a table of all lines
    ids = ranked(_repeated(every, ["h1", "h2"]), ["h1", "h2"], "r")
    seen = every.join(ids, ["h1", "h2"]).drop("h1", "h2").repartition(*ROW).dropDuplicates([*ROW, "idx"])
    levels = [common.saved(_with_next(seen, 0), "level0", 2)]
    rows = levels[0].count()
    longest = levels[0].agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    while 2 ** len(levels) <= longest:
        k = len(levels)
        pairs = levels[-1].where("s is not null").select(*ROW, "idx", "r", "s")
        ranks = ranked(_repeated(pairs, ["r", "s"]), ["r", "s"], "next")
        level = common.saved(_with_next(pairs.join(ranks, ["r", "s"]).select(*ROW, "idx", F.col("next").alias("r")), k), f"level{k}", rows=rows, each=ROWS)
        levels.append(level)
        if level.isEmpty():
            break
    return levels


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(r1, r2, runs, removed) of the documents with later copies of a run.

    runs: (start, size, of: doc_id and line of the first occurrence) of the maximal ones; removed: the lines that they cover. Lines
    are counted among those with a word.
    """
    levels = suffix_ranks(docs, min_words)
    seen, names, count = levels[0], None, levels[0].count()
    for k, level in enumerate(levels):
        part = level.select(F.lit(k).alias("k"), *ROW, "idx", "r")
        names = part if names is None else names.unionByName(part)
    whole = seen.select(*ROW, "doc_id", F.col("idx").alias("start"), F.col("ahead").alias("len")).unionByName(seen.select(*ROW, "doc_id", (F.col("idx") - F.col("back") + 1).alias("start"), F.col("back").alias("len"))).where("len > 0").distinct()
    whole = whole.withColumn("k", F.length(F.bin(F.col("len").cast("long"))) - 1).withColumn("tail", (F.col("start") + F.col("len") - F.expr("cast(shiftleft(1, k) as int)")).cast("int"))
    left = names.select("k", *ROW, F.col("idx").alias("start"), F.col("r").alias("a"))
    right = names.select("k", *ROW, F.col("idx").alias("tail"), F.col("r").alias("b"))
    whole = common.saved(whole.join(left, ["k", *ROW, "start"]).join(right, ["k", *ROW, "tail"]).select(*ROW, "doc_id", "start", "len", "a", "b"), "blocks", rows=2 * count, each=ROWS)
    common.used_up(*levels)
    here = F.struct("doc_id", *ROW, "start")
    first = whole.groupBy("len", "a", "b").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = (F.col("r1") == F.col("first.r1")) & (F.col("r2") == F.col("first.r2"))
    later = whole.join(first, ["len", "a", "b"]).where((here > F.col("first")) & ~(same & (F.col("start") < F.col("first.start") + F.col("len"))))
    later = later.select(*ROW, "start", (F.col("start") + F.col("len")).alias("stop"), F.col("first.doc_id").alias("of"), F.col("first.r1").alias("f1"), F.col("first.r2").alias("f2"), (F.col("start") - F.col("first.start")).alias("diagonal"))
    # one exchange by row holds for all that follows
    along = [*ROW, "of", "f1", "f2", "diagonal"]
    in_order = W.partitionBy(*along).orderBy("start", "stop")
    reached = F.max("stop").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    chained = later.repartition(*ROW).withColumn("fresh", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    runs = chained.groupBy(*along, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    run = F.struct("start", (F.col("stop") - F.col("start")).alias("size"), F.struct(F.col("of").alias("doc_id"), (F.col("start") - F.col("diagonal")).alias("line")).alias("of"))
    spans = runs.groupBy(*ROW).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    covered = F.flatten(F.transform("runs", lambda x: F.sequence(x.start, x.start + x["size"] - 1)))
    out = common.saved(spans.withColumn("removed", F.array_sort(F.array_distinct(covered))), "runs", rows=count, each=ROWS)
    common.used_up(whole)
    return out


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines (with a word), n_removed, removed (their places among these, comma-joined), runs (start+lines@doc_id:line of the first occurrence, comma-joined)."""
    gone = repeated_runs(docs, min_words)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))).cast("long")
    place = lambda x: F.concat(x.start.cast("string"), F.lit("+"), x["size"].cast("string"), F.lit("@"), F.coalesce(x.of.doc_id.cast("string"), F.lit("")), F.lit(":"), x.of.line.cast("string"))
    joined = docs.select(F.col("doc_id").cast("long"), *common.row_key(), n.alias("n_lines")).join(gone, ROW, "left")
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), listed(F.col("removed").cast("array<string>")).alias("removed"), listed(F.transform("runs", place)).alias("runs"))


def without(text: str, removed) -> tuple[str, bool]:
    """The text without these lines (places among those with a word); is one with a word left?"""
    drop, rows, k, left = set(removed), [], 0, False
    for x in text.split("\n"):
        if x.strip(BLANK):
            if k not in drop:
                rows.append(x)
                left = True
            k += 1
        else:
            rows.append(x)
    return "\n".join(rows), left


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, with all their columns, without the lines of later copies; documents of which no line is left go. n_chars, where there is one, follows.

    The texts are dealt out by row once, and pass the decisions of their partition, which are a table in memory, in a stream.
    """
    gone, at, schema = repeated_runs(docs, min_words), docs.columns.index("text"), docs.schema
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    first, second, decided = "_strandex_r1", "_strandex_r2", "_strandex_removed"

    def run(batches):
        for b in common.sliced(batches, SLICE):
            removed, cols = b.column(b.num_columns - 1), list(b.columns[:-1])
            if removed.null_count < len(removed):
                got = [(t, True) if not r else without(t, r) for t, r in zip(cols[at].to_pylist(), removed.to_pylist(), strict=True)]
                cols[at] = pa.array([t for t, _ in got], cols[at].type)
                if chars is not None:
                    cols[chars] = pa.array([n if not r else len(t) for n, (t, _), r in zip(cols[chars].to_pylist(), got, removed.to_pylist(), strict=True)], cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array([left for _, left in got], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    r1, r2 = common.row_key()
    decisions = gone.select(F.col("r1").alias(first), F.col("r2").alias(second), F.col("removed").alias(decided)).hint("shuffle_hash")
    joined = docs.withColumns({first: r1, second: r2}).join(decisions, [first, second], "left")
    return joined.select(*docs.columns, decided).mapInArrow(run, schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(common.table(spark, sf_dir, "documents"))
