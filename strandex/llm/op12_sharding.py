"""Shards by longest processing time: groups that must stay together, largest first, each to the shard with the least in it.

Documents with equal texts are a group. The order of the groups is what makes the method sequential, so only what decides the
balance goes one by one: a group of 1 / (EXACT * shards) of all bytes or more, of which there are EXACT * shards at most,
however large the corpus. What is smaller is counted in classes of sizes, 512 for each doubling (sizes under 1024 exactly), and
all groups of a class are dealt in one step: equal sizes, each to the least loaded, is a water level that can be computed. Which
group of a class goes where follows from its number in the class. So the driver holds two tables of bounded size and a heap.

Numbers within a class and slots within a shard come from a global sort: a partition holds whole ranges, and the counts of
(shard, partition) say where each range begins.

Defined cases: a null text counts as an empty one and is in its group; repeated rows are rows of their own, in one group;
a null doc_id is returned as it is and comes first in its shard; an empty table gives no rows; extra columns are ignored. A group
larger than a shard's share makes its shard larger than the others, since groups are not cut.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Shards; groups for each shard at most that are placed one by one; bytes that a document has besides its text.
SHARDS, EXACT, OVERHEAD = 40, 1000, 16
#: Bits of a size that decide its class.
BITS = 10


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, r1, r2, rid) of every row; r1 and r2 are two hashes of the text, rid numbers the rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("r1"), F.xxhash64(F.lit("strandex"), "text").alias("r2"), F.monotonically_increasing_id().alias("rid"))


def numbered(rows: DataFrame, by: str, order: list, name: str) -> DataFrame:
    """rows with n, from 0 within each value of `by`, in that order. `by` has few values; no value meets in one task."""
    dealt = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    dealt = common.saved(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), name)
    begins = dealt.groupBy(by, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a partition is one range of the order: there are no more of these rows than partitions and values together
    begins = begins.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"))
    met = dealt.join(F.broadcast(begins), (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_of")))
    return met.withColumn("n", F.col("_seq") + F.col("_shift")).drop("_by", "_of", "_shift", "_part", "_seq")


def level(loads: np.ndarray, n: int, size: float) -> np.ndarray:
    """How many of n items of one size each shard gets when each goes to the least loaded, but for fewer than one each at the end."""
    lo, hi = float(loads.min()) - size, float(loads.max()) + n * size
    count = lambda x: np.maximum(np.floor((x - loads) / size) + 1, 0).astype(np.int64)
    for _ in range(64):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if count(mid).sum() <= n else (lo, mid)
    return count(lo)


class Shards:
    """A heap of (bytes, shard)."""

    def __init__(self, n: int):
        self.heap: list[tuple[float, int]] = [(0, i) for i in range(n)]

    def place(self, size: float) -> int:
        load, shard = self.heap[0]
        heapq.heapreplace(self.heap, (load + size, shard))
        return shard

    def deal(self, n: int, size: float) -> tuple[list[int], list[int]]:
        """(ends, shards) of runs of n items of one size: items before an end go to that run's shard."""
        ends, to = [], []
        if n > 2 * len(self.heap):
            loads = np.array([load for load, _ in sorted(self.heap, key=lambda x: x[1])], float)
            for shard, k in enumerate(level(loads, n, size)):
                if k:
                    ends.append((ends[-1] if ends else 0) + int(k))
                    to.append(shard)
                    loads[shard] += k * size
            self.heap = [(float(load), i) for i, load in enumerate(loads)]
            heapq.heapify(self.heap)
        for i in range(ends[-1] if ends else 0, n):
            to.append(self.place(size))
            ends.append(i + 1)
        return ends, to


def size_class(size: str):
    """The lower end of a size's class."""
    bits = f"greatest(length(bin({size})) - {BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({size}, {bits}), {bits})")


def placed_groups(groups: DataFrame, shards: int) -> DataFrame:
    """groups (r1, r2, bytes, first) -> (r1, r2, shard)."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes").cast("decimal(38,0)") * (EXACT * shards) >= total
    heap = Shards(shards)
    # at most EXACT * shards rows
    alone = groups.where(large).orderBy(F.desc("bytes"), F.asc_nulls_first("first"), "r1", "r2").select("r1", "r2", "bytes").toArrow()
    singles = [(r1, r2, heap.place(b)) for r1, r2, b in zip(*(c.to_pylist() for c in alone.columns), strict=True)]
    out = spark.createDataFrame(singles, "r1 long, r2 long, shard int")
    rest = groups.where(~large).withColumn("class", size_class("bytes"))
    # at most 512 rows for each doubling of the size
    classes = rest.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.desc("class")).toArrow()
    dealt = [(c, *heap.deal(n, b / n)) for c, n, b in zip(*(x.to_pylist() for x in classes.columns), strict=True)]
    if not dealt:
        return out
    plan = spark.createDataFrame(dealt, "class long, ends array<long>, to array<int>")
    # the table of classes has 2 * shards runs a class at most
    found = numbered(rest, "class", [F.asc_nulls_first("first"), "r1", "r2"], "classes").join(F.broadcast(plan), "class")
    return out.unionByName(found.select("r1", "r2", F.expr("to[size(filter(ends, x -> x <= n))]").alias("shard")))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot, of every row."""
    rows = common.saved(sized(docs), "sizes", common.SCAN)
    groups = common.saved(rows.groupBy("r1", "r2").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first"), F.count("*").alias("rows")), "groups")
    shard = common.saved(placed_groups(groups, shards), "placed")
    # fewer than 1000 groups hold a thousandth of the rows each; the rest have no hot key
    n = groups.agg(F.sum("rows")).first()[0] or 0
    hot = shard.join(groups.where(F.col("rows") * 1000 > n).select("r1", "r2"), ["r1", "r2"], "left_semi")
    first = rows.join(F.broadcast(hot), ["r1", "r2"], "left")
    found = first.where("shard is not null").unionByName(first.where("shard is null").drop("shard").join(shard, ["r1", "r2"]))
    out = numbered(found.select("doc_id", "size", "text_crc32", "shard", "rid"), "shard", [F.asc_nulls_first("doc_id"), "rid"], "slots")
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("n").alias("slot"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
