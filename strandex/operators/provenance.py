"""An append-only log in which each record holds the hash of the one before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import fixedpoint as fx
from ..functions.fixedpoint import FNV_BASIS, FNV_PRIME
from ..storage import materialised

GENESIS = "0" * 16
ENTRY = "seq long, prev_hash string, memory_id string, event string, content_hash string, source string, harness string, core string, created long, entry_hash string"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def payload() -> Column:
    """What a record's hash commits to, besides the hash before: its other fields as compact JSON, in order."""
    return F.to_json(F.struct("seq", "memory_id", "event", "content_hash", "source", "harness", "core", fx.format_rfc3339("created").alias("created")), {"ignoreNullFields": "false"})


def line() -> Column:
    return F.to_json(F.struct("seq", "prev_hash", "memory_id", "event", "content_hash", "source", "harness", "core", fx.format_rfc3339("created").alias("created"), "entry_hash"), {"ignoreNullFields": "false"})


def links(texts, before: str):
    """(hash before, own hash) of each payload in turn: FNV-1a of the hash before and the payload."""
    for text in texts:
        h = FNV_BASIS
        for byte in (before + text).encode():
            h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        own = f"{h:016x}"
        yield before, own
        before = own


def _linked(g, before: str):
    """A frame of records in their order, with their hashes."""
    pairs = list(links(g["json"], before))
    return g.assign(prev_hash=[p for p, _ in pairs], entry_hash=[o for _, o in pairs])


def tail(log: DataFrame) -> tuple[int, str]:
    """(seq, hash) of the last record; of a part of a log, if the last record is in it."""
    last = log.agg(F.max_by(F.struct("seq", "entry_hash"), "seq").alias("t")).first().t
    return (last.seq, last.entry_hash) if last else (0, GENESIS)


def append(after: tuple[int, str] | None, events: DataFrame) -> DataFrame:
    """New records for events (ord, memory_id, event, content_hash, source, harness, core, created), in the order of ord, after a log's tail.

    A chain is sequential by nature: one batch of events is folded in one task. Verifying is parallel.
    """
    seq, before = after or (0, GENESIS)
    rows = events.withColumn("n", F.row_number().over(W.orderBy("ord"))).withColumn("seq", (F.col("n") + seq).cast("long")).withColumn("json", payload())

    def chain(frames):
        last = before
        for g in frames:
            if len(g):
                g = _linked(g, last)
                last = g["entry_hash"].iloc[-1]
                yield g[NAMES]

    return rows.select("seq", "memory_id", "event", "content_hash", "source", "harness", "core", "created", "json").coalesce(1).sortWithinPartitions("seq").mapInPandas(chain, ENTRY)


def append_logs(events: DataFrame, by: str) -> DataFrame:
    """Records of many new logs, one for each value of `by` (a long): events as for `append`. Each log is folded in a task of its own."""
    rows = events.withColumn("seq", F.row_number().over(W.partitionBy(by).orderBy("ord")).cast("long")).withColumn("json", payload())
    chain = lambda g: _linked(g.sort_values("seq"), GENESIS)[[by, *NAMES]]
    return rows.select(by, "seq", "memory_id", "event", "content_hash", "source", "harness", "core", "created", "json").groupBy(by).applyInPandas(chain, f"{by} long, {ENTRY}")


class Chain(StatefulProcessor):
    """A log's tail as state: the events of each batch follow it, in the order of ord, and no earlier record is read."""

    def __init__(self, by: str):
        self.by = by

    def init(self, handle) -> None:
        self.tail = handle.getValueState("tail", "seq long, hash string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        g = pd.concat(list(rows)).sort_values(["ord", "rest"], kind="stable")
        seq, before = self.tail.get() if self.tail.exists() else (0, GENESIS)
        g["seq"] = range(seq + 1, seq + len(g) + 1)
        g["json"] = [f'{{"seq":{n},{rest[1:]}' for n, rest in zip(g["seq"], g["rest"], strict=True)]
        g = _linked(g, before)
        self.tail.update((int(g["seq"].iloc[-1]), g["entry_hash"].iloc[-1]))
        yield g.assign(**{self.by: key[0]})[[self.by, *NAMES]]

    def close(self) -> None:
        pass


def chained(events: DataFrame, by: str) -> DataFrame:
    """A stream of events (`by`, a long: the log's key; else as for `append`) -> a stream of their records, each log going on where it was."""
    rest = F.to_json(F.struct("memory_id", "event", "content_hash", "source", "harness", "core", fx.format_rfc3339("created").alias("created")), {"ignoreNullFields": "false"})
    rows = events.select(by, "ord", "memory_id", "event", "content_hash", "source", "harness", "core", "created", rest.alias("rest"))
    return rows.groupBy(by).transformWithStateInPandas(Chain(by), f"{by} long, {ENTRY}", "append", "none")


def chain_breaks(log: DataFrame, by: str | None = None) -> DataFrame:
    """(pos, seq, reason) of each record that doesn't follow: a gap in seq, then a wrong prev_hash, then a wrong entry_hash.

    by: column of the log's name, for many logs. A single log is cut in ranges of pos; of each range only its last record is
    told to the next.
    """
    if by:
        w = W.partitionBy(by).orderBy("pos")
        rows = log.withColumn("was", F.lag("seq").over(w)).withColumn("before", F.lag("entry_hash").over(w))
        return rows.select(by, "pos", "seq", break_reason().alias("reason")).where("reason is not null")
    parts = materialised(log.repartitionByRange("pos").withColumn("part", F.spark_partition_id()), "log")
    last = parts.groupBy("part").agg(F.max_by(F.struct("seq", "entry_hash"), "pos").alias("last"))
    ends = last.select("part", F.lag("last").over(W.orderBy("part")).alias("end"))  # a row for each range
    w = W.partitionBy("part").orderBy("pos")
    rows = parts.withColumn("was", F.lag("seq").over(w)).withColumn("before", F.lag("entry_hash").over(w)).join(F.broadcast(ends), "part")
    rows = rows.withColumn("was", F.coalesce("was", "end.seq")).withColumn("before", F.coalesce("before", "end.entry_hash"))
    return rows.select("pos", "seq", break_reason().alias("reason")).where("reason is not null")


def break_reason() -> Column:
    own = fx.fnv1a64_hex(F.concat("prev_hash", payload()))
    gap = F.col("seq") != F.coalesce("was", F.lit(0).cast("long")) + 1
    return F.when(gap, "sequence gap").when(F.col("prev_hash") != F.coalesce("before", F.lit(GENESIS)), "prev_hash does not match").when(own != F.col("entry_hash"), "entry_hash does not match")


def latest(log: DataFrame) -> DataFrame:
    """(memory_id, seq, content_hash) of each record's last entry."""
    return log.groupBy("memory_id").agg(F.max("seq").alias("seq"), F.max_by("content_hash", "seq").alias("content_hash"))


def verify(log: DataFrame, live: DataFrame) -> dict:
    """log (ENTRY), live (id, content_hash) -> {intact, entries, memories} or {broken: seq, reason}, the first break of the chain first, then the first content that changed since its record. A missing record's history is fine."""
    first = chain_breaks(log.withColumn("pos", F.col("seq"))).orderBy("pos").first()
    if first is None:
        changed = latest(log).alias("l").join(live.select(F.col("id").alias("memory_id"), F.col("content_hash").alias("now")), "memory_id").where("content_hash != now")
        first = changed.select("seq", F.concat(F.lit("content of "), "memory_id", F.lit(" changed since its last record")).alias("reason")).orderBy("seq").first()
    if first is not None:
        return {"broken": first.seq, "reason": first.reason}
    n = log.agg(F.count("*").alias("e"), F.count_distinct("memory_id").alias("m")).first()
    return {"intact": True, "entries": n.e, "memories": n.m}


def lineage(log: DataFrame, memory_id: str) -> DataFrame:
    return log.where(F.col("memory_id") == memory_id).orderBy("seq")
