"""From sessions to records: a summary, a record for each marker, and what the heuristic distiller finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..functions import redact as rd
from ..functions import text as tx
from ..storage import materialised

# Candidates of a session at most, and their note.
MOST, NOTE = 12, "auto-distilled from the session transcript (heuristic)"
NEW = ("id", "mtype", "title", "tags", "links", "source", "supersedes", "harness", "core", "rationale", "scope", "body")


def _scrubbed(c: Column, redact: bool) -> Column:
    return rd.redacted(c)["text"] if redact else c


def _short_hash(c: Column) -> Column:
    return F.left(fx.fnv1a64_hex(c), F.lit(8))


def _blank(name: str) -> Column:
    return F.lit(None).cast("array<string>" if name in ("tags", "links") else "string").alias(name)


def _rows(df: DataFrame, *extra: str) -> DataFrame:
    have = df.columns
    return df.select(*extra, *(F.col(n) if n in have else F.array().cast("array<string>").alias(n) if n in ("tags", "links") else _blank(n) for n in NEW))


def summaries(sessions: DataFrame, redact: bool = True) -> DataFrame:
    """(path, NEW): the session's summary, under an id that the session alone decides."""
    sid = F.coalesce("session_id", F.lit("unknown"))
    part = lambda head, c: F.coalesce(F.concat(F.lit(head), c), F.lit(""))
    body = F.concat(F.lit("Session on "), F.col("harness"), part(" via ", F.col("core")), F.lit(". "), F.col("message_count").cast("string"), F.lit(" message(s)."), part(" Task: ", F.col("task")), F.lit("\n"))
    rows = sessions.select("path", "harness", "core", "scope", "markers", F.lit("session-summary").alias("mtype"), _scrubbed(F.coalesce("task", F.lit("agent session")), redact).alias("title"), F.concat_ws(":", "harness", sid).alias("source"), body.alias("body"))
    return _rows(rows.withColumn("id", F.concat(F.lit("session-summary-"), tx.slugify(F.col("title")), F.lit("-"), _short_hash(F.col("source")))), "path", "markers")


def marker_records(summary: DataFrame, redact: bool = True) -> DataFrame:
    """A record for each marker of the given summaries, linked to its summary."""
    rows = summary.select("path", "harness", "core", "scope", F.array("id").alias("links"), F.col("id").alias("of"), F.posexplode("markers").alias("pos", "m")).withColumn("said", _scrubbed(F.col("m.body"), redact))
    rows = rows.select("path", "pos", "harness", "core", "scope", "links", F.col("m.mtype").alias("mtype"), tx.cap(F.col("said")).alias("title"), F.concat("said", F.lit("\n")).alias("body"), tx.slugify(F.col("said")).alias("slug"), _short_hash(F.concat_ws(":", "of", "said")).alias("hash"))
    return _rows(rows.withColumn("id", F.concat_ws("-", "mtype", "slug", "hash")), "path", "pos")


def distilled(texts: DataFrame) -> DataFrame:
    """(path, text) -> (path, pos, mtype, line): sentences that sound like a decision or a rule, each once, MOST of a session at most."""
    blocks = texts.select("path", F.posexplode(tx.prose_blocks(F.col("text"))).alias("b", "block"))
    rows = blocks.select("path", "b", F.posexplode(F.split("block", "\n")).alias("l", "raw")).select("path", "b", "l", tx.strip_lead(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("line"))
    rows = rows.withColumn("mtype", tx.classify(F.col("line"))).where("mtype is not null").withColumn("key", tx.normalize(F.col("line")))
    once = rows.groupBy("path", "key").agg(F.min(F.struct("b", "l", "line", "mtype")).alias("x")).select("path", "x.*")
    return once.withColumn("pos", F.row_number().over(W.partitionBy("path").orderBy("b", "l"))).where(F.col("pos") <= MOST).select("path", F.col("pos").cast("long").alias("pos"), "mtype", "line")


def candidate_records(candidates: DataFrame, summary: DataFrame, redact: bool = True) -> DataFrame:
    """Records of distilled candidates, linked to the session's summary whether that is new or not."""
    rows = candidates.join(summary.select("path", "harness", "core", "scope", F.col("id").alias("of")), "path")
    rows = rows.withColumn("scrubbed", _scrubbed(tx.cap(F.col("line")), redact)).withColumn("hash", _short_hash(F.concat(F.lit("distill:"), F.col("of"), F.lit(":"), F.col("scrubbed"))))
    return _rows(rows.select("path", "pos", "mtype", "harness", "core", "scope", F.array("of").alias("links"), F.array(F.lit("distilled")).alias("tags"), F.lit(NOTE).alias("rationale"), tx.cap(F.col("scrubbed")).alias("title"), F.concat("line", F.lit("\n")).alias("body"), F.concat_ws("-", "mtype", tx.slugify(F.col("scrubbed")), "hash").alias("id")), "path", "pos")


def parse_model_output(outputs: DataFrame) -> DataFrame:
    """(path, text) of another distiller -> (path, pos, mtype, line) of its lines `[memory] <type>: body`, each once."""
    shape = r"(?i)^\s*(?:[-*]\s*)?(?:memory\s+)?(fact|decision|rule)\s*:\s*(\S.*?)\s*$"
    rows = outputs.select("path", F.posexplode(tx.lines(F.col("text"))).alias("n", "raw")).where(F.col("raw").rlike(shape))
    rows = rows.select("path", "n", F.lower(F.regexp_extract("raw", shape, 1)).alias("mtype"), F.regexp_extract("raw", shape, 2).alias("line"))
    once = rows.groupBy("path", tx.normalize(F.col("line")).alias("key")).agg(F.min(F.struct("n", "mtype", "line")).alias("x")).select("path", "x.*")
    return once.select("path", F.row_number().over(W.partitionBy("path").orderBy("n")).cast("long").alias("pos"), "mtype", "line")


def process_distiller(command: str, timeout: float = 60.0):
    """A distiller that hands each transcript to a shell command and reads its lines; `distilled` where that fails, is late or finds nothing.

    Transcripts are spread over the executors, which need the command; a command that is late is stopped.
    """

    def run(frames):
        import subprocess

        for g in frames:
            out = []
            for text in g["text"]:
                try:
                    done = subprocess.run(["sh", "-c", command], input=(text or "").encode(), capture_output=True, timeout=timeout, check=False)
                    out.append(done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None)
                except subprocess.TimeoutExpired:
                    out.append(None)
            yield g.assign(said=out)

    def distiller(texts: DataFrame) -> DataFrame:
        said = materialised(texts.select("path", "text").mapInPandas(run, "path string, text string, said string"), "said")
        found = parse_model_output(said.where("said is not null").select("path", F.col("said").alias("text"))).where(F.col("pos") <= MOST)
        rest = distilled(said.select("path", "text").join(found.select("path").distinct(), "path", "left_anti"))
        return found.unionByName(rest)

    return distiller


def stored(new: DataFrame, now: int, redact: bool = True) -> DataFrame:
    """New rows as they are written: free text redacted, scalars without control characters, empty ones null, stamped."""
    free = (lambda c: rd.redact_scalar(c)) if redact else rd.sanitize_scalar
    some = lambda c: F.when(c != "", c)
    tags = F.filter(F.transform("tags", lambda t: rd.sanitize_scalar(t)), lambda t: t != "")
    return new.select(
        "id", "mtype", F.lit(now).cast("long").alias("created"), free(F.col("title")).alias("title"), tags.alias("tags"), "links", some(free(F.col("source"))).alias("source"),
        some(rd.sanitize_scalar(F.col("supersedes"))).alias("supersedes"), *(some(rd.sanitize_scalar(F.col(c))).alias(c) for c in ("harness", "core")), some(free(F.col("rationale"))).alias("rationale"),
        some(rd.sanitize_scalar(F.col("scope"))).alias("scope"), F.lit(None).cast("long").alias("confidence"), F.lit(None).cast("long").alias("last_used"),
        F.array().cast("array<struct<k:string,scalar:string,list:array<string>>>").alias("unknown_keys"), _scrubbed(F.coalesce("body", F.lit("")), redact).alias("body"),
    )


def captured(sessions: DataFrame, existing: DataFrame, redact: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """Rows that capturing adds: summaries not yet there with their markers, and candidates not yet there. Capturing twice adds nothing."""
    ids = existing.select("id")
    every = summaries(sessions, redact)
    first = every.groupBy("id").agg(F.min("path").alias("path"))
    fresh = every.join(first, ["id", "path"], "left_semi").join(ids, "id", "left_anti")
    new = _rows(fresh, "path").withColumn("pos", F.lit(-1).cast("long")).unionByName(marker_records(fresh, redact).withColumn("pos", F.col("pos").cast("long")))
    if candidates is not None:
        more = candidate_records(candidates, every, redact)
        new = new.unionByName(more.withColumn("pos", F.col("pos").cast("long") + 1_000_000))
    rank = F.row_number().over(W.partitionBy("id").orderBy("path", "pos"))
    return _rows(new.join(ids, "id", "left_anti").withColumn("_n", rank).where("_n = 1"))


def lowest_free(new: DataFrame, taken: DataFrame) -> DataFrame:
    """new (mtype, slug, ord) with id = mtype-slug-n: the lowest n from 1 that no taken id has, in order of ord. taken: (id)."""
    shape = r"^(.*)-([1-9][0-9]{0,17})$"
    used = taken.where(F.col("id").rlike(shape)).select(F.regexp_extract("id", shape, 1).alias("stem"), F.regexp_extract("id", shape, 2).cast("long").alias("n"))
    rows = new.withColumn("stem", F.concat_ws("-", "mtype", "slug"))
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("stem").orderBy("ord")).cast("long"))
    # the k-th free number: k plus the taken numbers below it; taken ones are in order, so each shifts those from its place on
    sized = used.join(rows.select("stem").distinct(), "stem", "left_semi").distinct().withColumn("before", F.row_number().over(W.partitionBy("stem").orderBy("n")) - 1)
    gaps = sized.groupBy("stem").agg(F.array_sort(F.collect_list(F.col("n") - F.col("before"))).alias("gaps"))
    free = F.col("rn") + F.size(F.filter(F.coalesce("gaps", F.array().cast("array<bigint>")), lambda g: g <= F.col("rn")))
    return rows.join(gaps, "stem", "left").withColumn("id", F.concat_ws("-", "stem", free.cast("string"))).drop("stem", "rn", "gaps")
