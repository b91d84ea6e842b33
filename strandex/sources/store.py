"""A store of records: Parquet tables under one folder, each a series of complete snapshots.

Appending adds files to the current snapshot; anything else writes the next one, and a snapshot counts from when it is complete.
One writer at a time. The lineage log is a series of segments, one for each write, and the next follows the last one's tail.

A write may be given a request, a name of the caller's for it (a batch's, a message's). Whoever tries again after a failure under
the same name gets what was prepared the first time, whatever the clock says now, and each step that was done is not done again:
one entry of the log for each record. Without a name each call is a write of its own.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..functions import text as tx
from ..operators import capture as cp
from ..operators import lifecycle as lc
from ..operators import provenance as pv
from ..operators import recall as rc
from ..operators.index import Index, UnusableIndex, refresh
from ..storage import materialised
from . import frontmatter as fm
from . import transcripts as tr


_COLUMNS = re.split(r", (?![^<]*>)", fm.SCHEMA)


def _named(request: str) -> str:
    """A request's name as part of a folder's."""
    return hashlib.sha256(request.encode()).hexdigest()[:32]


class UsageError(ValueError):
    """A request that makes no sense."""


class Store:
    def __init__(self, spark: SparkSession, root: str, redact: bool = True):
        self.spark, self.root, self.redact = spark, root.rstrip("/"), redact
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._index: Index | None = None
        self.warnings: list[str] = []

    # tables

    def _current(self, name: str) -> str | None:
        base = f"{self.root}/{name}"
        if not self._fs.exists(self._path(base)):
            return None
        versions = [s.getPath().getName() for s in self._fs.listStatus(self._path(base))]
        done = [v for v in versions if v[:1] == "v" and self._fs.exists(self._path(f"{base}/{v}/_SUCCESS"))]
        return f"{base}/{max(done, key=lambda v: int(v[1:]))}" if done else None

    def table(self, name: str, schema: str = fm.SCHEMA) -> DataFrame:
        at = self._current(name)
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._current(name) or f"{self.root}/{name}/v1")

    def _replace(self, name: str, rows: DataFrame) -> None:
        at = self._current(name)
        rows.write.parquet(f"{self.root}/{name}/v{int(at.rsplit('v', 1)[1]) + 1 if at else 1}")

    def memories(self) -> DataFrame:
        return self.table("memories")

    def log(self) -> DataFrame:
        parts = [f"{self.root}/provenance/{name}" for name in self._segments()]
        return self.spark.read.schema(pv.ENTRY).parquet(*parts) if parts else self.spark.createDataFrame([], pv.ENTRY)

    def _segments(self) -> list[str]:
        """The log's complete segments in their order."""
        base = self._path(f"{self.root}/provenance")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(base)) if self._fs.exists(base) else []
        return [n for n in names if self._fs.exists(self._path(f"{self.root}/provenance/{n}/_SUCCESS"))]

    def setup(self) -> None:
        """Makes the store's folder, where it isn't there."""
        self._fs.mkdirs(self._path(self.root))

    # writing

    def _once(self, request: str | None, make) -> DataFrame:
        """What make() gives, kept under the request's name: prepared once, however often it is asked for."""
        if request is None:
            return materialised(make(), "rows")
        at = f"{self.root}/staged/{_named(request)}"
        if not self._fs.exists(self._path(f"{at}/_SUCCESS")):
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.schema(fm.SCHEMA).parquet(at)

    def _record(self, rows: DataFrame, event: str, now: int, request: str | None = None) -> None:
        """An entry for each row, before what they tell of is written; none if the request has its entries already. Only the last segment is read."""
        known, name = self._segments(), _named(request or uuid.uuid4().hex)
        if any(k.endswith(name) for k in known) or rows.isEmpty():
            return
        after = pv.tail(self.spark.read.schema(pv.ENTRY).parquet(f"{self.root}/provenance/{known[-1]}")) if known else None
        events = rows.select(F.col("id").alias("ord"), F.col("id").alias("memory_id"), F.lit(event).alias("event"), fx.fnv1a64_hex(fm.canonical()).alias("content_hash"), "source", "harness", "core", F.lit(now).cast("long").alias("created"))
        pv.append(after, events).write.mode("overwrite").parquet(f"{self.root}/provenance/{len(known) + 1:09d}-{name}")

    def _insert(self, make, now: int, event: str, into: str, request: str | None) -> DataFrame:
        rows = self._once(request, lambda: cp.stored(make().dropDuplicates(["id"]).join(self.table(into).select("id"), "id", "left_anti"), now, self.redact).select(*(c.split()[0] for c in _COLUMNS)))
        if into == "memories":
            self._record(rows, event, now, request)
            self._index = None
        self._append(into, rows.join(self.table(into).select("id"), "id", "left_anti") if request else rows)
        return rows

    def insert(self, new: DataFrame, now: int, event: str = "created", into: str = "memories", request: str | None = None) -> DataFrame:
        """Rows (NEW) whose ids are not there yet; returns those written."""
        return self._insert(lambda: new, now, event, into, request)

    def create(self, new: DataFrame, now: int, request: str | None = None) -> DataFrame:
        """Rows (NEW without id, and ord): each under type-slug-n, with the lowest free n."""
        if not new.where(~F.coalesce(F.col("title"), F.lit("")).rlike(r"\S")).isEmpty():
            raise UsageError("title must not be empty")
        if not new.where(~F.coalesce(F.col("mtype").isin(*tx.TYPES), F.lit(False))).isEmpty():
            raise UsageError("unknown type")
        title = cp.rd.redacted(F.col("title"))["text"] if self.redact else F.col("title")
        return self._insert(lambda: cp._rows(cp.lowest_free(new.withColumn("slug", tx.slugify(title)), self.memories().select("id")).drop("slug")), now, "created", "memories", request)

    def _changed(self, rows: DataFrame, now: int, request: str | None = None) -> None:
        """Replaces the records with the ids of rows; what changes nothing has its entry too."""
        rows = self._once(request, lambda: rows.select(*(c.split()[0] for c in _COLUMNS)))
        self._record(rows, "updated", now, request)
        self._replace("memories", self.memories().join(rows.select("id"), "id", "left_anti").unionByName(rows))
        self._index = None

    def update(self, rows: DataFrame, now: int, request: str | None = None) -> None:
        if not rows.join(self.memories().select("id"), "id", "left_anti").isEmpty():
            raise UsageError("no such record")
        self._changed(rows, now, request)

    def delete(self, ids: list[str], name: str = "memories") -> None:
        """No record is kept of it."""
        rows = self.table(name)
        gone = rows.where(F.col("id").isin(ids))
        if gone.count() != len(set(ids)):
            raise UsageError("no such record")
        self._replace(name, rows.where(~F.col("id").isin(ids)))
        self._index = None

    def archive(self, ids: DataFrame) -> None:
        ids = materialised(ids.select("id"), "archived")
        rows = self.memories()
        self._append("archive", rows.join(ids, "id", "left_semi"))
        self._replace("memories", rows.join(ids, "id", "left_anti"))
        self._index = None

    def mark_used(self, ids: DataFrame, now: int, request: str | None = None) -> None:
        self._changed(lc.touched(self.memories().join(ids.select("id"), "id", "left_semi"), ids, now), now, request)

    def prune(self, now: int, below: int = fx.PRUNE_FLOOR, force: bool = False) -> DataFrame:
        rows = materialised(lc.stale(self.memories(), now, below), "stale").withColumn("archived", F.lit(force))
        if force:
            self.archive(rows)
        return rows

    def recanonicalise(self, now: int) -> None:
        """Every record rewritten in its canonical form."""
        self._changed(self.memories().withColumn("body", fm.canonical_body(F.col("body"))), now)

    # reading

    def read(self, id_: str) -> DataFrame:
        return self.memories().where(F.col("id") == id_)

    def read_warnings(self, folder: str) -> DataFrame:
        """(origin, message) of the record files of a folder: what could not be read, conflict markers, an id that isn't the file's name (the id counts)."""
        files = materialised(fm.read_files(self.spark, folder), "files")
        name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
        odd = fm.good(files).where(F.col("id") != name).select(F.col("path").alias("origin"), F.concat(F.lit("the id "), "id", F.lit(" is not the file's name")).alias("message"))
        return fm.quarantine(files).select("origin", "message").unionByName(odd)

    def list(self, mtype: str | None = None, tag: str | None = None) -> DataFrame:
        return lc.listed(self.memories(), mtype, tag).select("id", F.col("mtype").alias("type"), "title", fx.format_rfc3339("created").alias("created"), "tags", F.concat(F.lit("memories/"), "id", F.lit(".md")).alias("path"))

    def index(self) -> Index:
        rows = self.memories().withColumn("path", F.concat(F.lit("memories/"), "id", F.lit(".md")))
        if self._index is None:
            at, known = f"{self.root}/index", None
            try:
                known = Index.load(self.spark, at)
            except UnusableIndex as e:
                self.warnings.append(f"the index could not be used and was built anew: {e}")
                self._fs.delete(self._path(at), True)
            self._index = refresh(known, rows) if known is not None else Index.build(rows, at)
        return self._index

    def rebuild_index(self) -> Index:
        self._fs.delete(self._path(f"{self.root}/index"), True)
        self._index = None
        return self.index()

    def recall(self, query: str, options: rc.Options | None = None, touch: bool = False, now: int | None = None) -> DataFrame:
        hits = rc.recall(self.index(), self.spark.createDataFrame([(0, query)], "qid long, text string"), options)
        if touch:
            hits = materialised(hits, "hits")
            self.mark_used(hits, now)
        return hits

    def verify(self) -> dict:
        return pv.verify(self.log(), self.memories().select("id", fx.fnv1a64_hex(fm.canonical()).alias("content_hash")))

    # sessions

    def capture(self, texts: DataFrame, now: int, distill: bool = False, pending: bool = False, distiller=cp.distilled, request: str | None = None, **session) -> DataFrame:
        """(path, text) of transcripts -> the rows added. distiller: DataFrame -> DataFrame, as `distilled`."""
        into = "pending" if pending else "memories"
        texts = materialised(texts, "transcripts")
        return self._insert(lambda: cp.captured(tr.sessions(texts, **session), self.table(into), self.redact, distiller(texts) if distill else None), now, "captured", into, request)

    # review

    def pending(self) -> DataFrame:
        return self.table("pending").orderBy("id")

    def _reviewed(self, ids: list[str] | None) -> DataFrame:
        rows = self.table("pending")
        rows = materialised(rows if ids is None else rows.where(F.col("id").isin(ids)), "reviewed")
        if ids is not None and rows.count() != len(set(ids)):
            raise UsageError("no such candidate")
        return rows

    def _cleared(self, rows: DataFrame) -> DataFrame:
        self._replace("pending", self.table("pending").join(rows.select("id"), "id", "left_anti"))
        return rows.select("id").orderBy("id")

    def approve(self, now: int, ids: list[str] | None = None) -> DataFrame:
        """Into the live store under the same id, stamped anew; an id already there is only cleared. Returns the ids."""
        rows = self._reviewed(ids)
        self.insert(rows.select(*cp.NEW), now)
        return self._cleared(rows)

    def reject(self, ids: list[str] | None = None) -> DataFrame:
        return self._cleared(self._reviewed(ids))

    # files

    def import_files(self, folder: str) -> DataFrame:
        """*.md files into the store; returns (origin, message) of what was wrong."""
        files = materialised(fm.read_files(self.spark, folder), "files")
        rows = fm.good(files).select(*(c.split()[0] for c in ("id", "mtype", "created", "title", "tags", "links", "source", "supersedes", "harness", "core", "rationale", "scope", "confidence", "last_used", "unknown_keys", "body")))
        self._append("memories", rows.dropDuplicates(["id"]).join(self.memories().select("id"), "id", "left_anti"))
        self._index = None
        return fm.quarantine(files)

    def export(self) -> DataFrame:
        """(id, content): each record as the text of its file."""
        return self.memories().select("id", fm.canonical().alias("content"))

    def encrypt_mirror(self, key: str) -> None:
        self._replace("sealed", lc.encrypted(self.export(), key))

    def decrypt_mirror(self, key: str) -> DataFrame:
        return lc.decrypted(self.table("sealed", "id string, sealed string"), key)
