"""Session logs: format, messages and markers of each, rolled up to one row for a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

# What a log's harness is called where nobody says.
HARNESS = {"claude-code": "claude-code", "codex": "codex", "generic": "unknown"}
SNIFFED = 25
SESSION = ("path", "format", "harness", "core", "session_id", "task", "message_count", "scope", "markers")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def newest_rollout(spark: SparkSession, home: str) -> DataFrame:
    """(path) of the newest rollout-*.jsonl below a folder; of equal times the last path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "rollout-*.jsonl").option("recursiveFileLookup", True).load(home)
    return files.select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).where("path is not null")


def json_lines(texts: DataFrame) -> DataFrame:
    """(path, text) -> (path, line_no, line, error): lines that aren't blank, as they stand without a carriage return; error where one isn't JSON."""
    rows = texts.select("path", F.posexplode(F.split("text", "\n")).alias("n", "raw")).select("path", (F.col("n") + 1).cast("long").alias("line_no"), F.regexp_replace("raw", r"\r$", "").alias("line"))
    bad = F.expr("try_parse_json(line) is null")
    return rows.where(F.col("line").rlike(r"\S")).withColumn("error", F.when(bad, "not JSON"))


def _lines(texts: DataFrame) -> DataFrame:
    rows = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).select("path", "pos", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("line"))
    return rows.where("line != ''").withColumn("v", F.expr("try_parse_json(line)"))


_STRING = "case when schema_of_variant(try_variant_get({0}, '{1}', 'variant')) = 'STRING' then try_variant_get({0}, '{1}', 'string') end"
_ANY = "try_variant_get({0}, '{1}', 'variant')"


def _text_of(content: str) -> str:
    """Text of a content: a string, or the text of its blocks, line by line."""
    blocks = f"filter(try_cast({content} as array<variant>), b -> (try_variant_get(b, '$.type', 'variant') is null or schema_of_variant(try_variant_get(b, '$.type', 'variant')) != 'STRING' or try_variant_get(b, '$.type', 'string') in ('text', 'input_text', 'output_text')) and schema_of_variant(try_variant_get(b, '$.text', 'variant')) = 'STRING')"
    return f"case when schema_of_variant({content}) = 'STRING' then cast({content} as string) when schema_of_variant({content}) like 'ARRAY%' then array_join(transform({blocks}, b -> try_variant_get(b, '$.text', 'string')), '\\n') else '' end"


def formats(texts: DataFrame) -> DataFrame:
    """(path, format): decided by the first of the sniffed lines that decides, else by whether any looks like a message."""
    seen = _lines(texts).withColumn("n", F.row_number().over(W.partitionBy("path").orderBy("pos"))).where(F.col("n") <= SNIFFED)
    kind = F.expr(_STRING.format("v", "$.type"))
    has = lambda p: F.expr(_ANY.format("v", p)).isNotNull()
    sign = F.when(F.col("v").isNull(), "generic").when(has("$.sessionId"), "claude-code").when(has("$.payload") & kind.isin("session_meta", "response_item", "turn_context", "event_msg"), "codex")
    loose = has("$.message") | has("$.role") | has("$.content")
    found = seen.withColumn("sign", sign).groupBy("path").agg(F.min(F.when(F.col("sign").isNotNull(), F.struct("n", "sign")))["sign"].alias("first"), F.max(F.coalesce(loose, F.lit(False))).alias("loose"))
    out = F.coalesce("first", F.when(F.col("loose"), "codex").otherwise("generic"))
    return texts.select("path").join(found, "path", "left").select("path", F.coalesce(out, F.lit("generic")).alias("format"))


def sessions(texts: DataFrame, format: str | None = None, harness: str | None = None, core: str | None = None, scope: str | None = None) -> DataFrame:
    """(path, text) -> SESSION: first session id, model and task in the order of lines, messages counted, markers in order."""
    kinds = formats(texts) if format is None else texts.select("path", F.lit(format).alias("format"))
    rows = _lines(texts).join(kinds, "path")
    s = lambda e, p: F.expr(_STRING.format(e, p))
    kind = s("v", "$.type")
    # the message of a line: `message` of it, or `payload`, or the line itself
    rows = rows.withColumn("m", F.expr(f"case when format = 'claude-code' then coalesce({_ANY.format('v', '$.message')}, v) when format = 'codex' then coalesce({_ANY.format('v', '$.payload')}, v) end")).withColumn("kind", kind)
    rows = rows.withColumn("c", F.expr(_ANY.format("m", "$.content")))
    meta = F.coalesce(F.col("kind").isin("session_meta", "turn_context"), F.lit(False))
    spoken = F.when(F.col("format") == "codex", ~meta & ((F.coalesce(s("m", "$.type"), F.lit("")) == "message") | F.expr(_ANY.format("m", "$.role")).isNotNull())).otherwise(F.col("v").isNotNull())
    claude, codex = F.col("format") == "claude-code", F.col("format") == "codex"
    role = F.when(claude, F.coalesce(s("m", "$.role"), F.col("kind"))).when(codex & spoken, s("m", "$.role"))
    sid = F.when(claude, s("v", "$.sessionId")).when(codex & (F.col("kind") == "session_meta"), s("v", "$.payload.id")).when(codex & spoken, F.coalesce(s("v", "$.session_id"), s("v", "$.id")))
    model = F.when(claude, F.coalesce(s("m", "$.model"), s("v", "$.model"))).when(codex & (F.col("kind") == "turn_context"), s("v", "$.payload.model")).when(codex & spoken, s("m", "$.model"))
    said = F.when(F.col("format") == "generic", F.col("line")).when(spoken, F.expr(_text_of("c")))
    rows = rows.select("path", "format", "pos", role.alias("role"), sid.alias("sid"), model.alias("model"), F.coalesce(said, F.lit("")).alias("said"))
    task = F.when(F.col("format") == "generic", tx.cap(F.col("said"))).when((F.col("role") == "user") & F.col("said").rlike(r"\S") & ((F.col("format") != "codex") | tx.is_real_user_text(F.col("said"))), tx.one_line(F.col("said")))
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct("pos", c.alias("x"))))["x"]
    marks = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").rlike(r"(?i)memory"), F.struct("pos", tx.markers(F.col("said")).alias("x"))))), lambda p: p.x))
    rolled = rows.groupBy("path").agg(first(F.col("sid")).alias("session_id"), first(F.col("model")).alias("model"), first(task).alias("task"), F.count_if(F.col("role").isin("user", "assistant")).alias("message_count"), marks.alias("markers"))
    named = F.create_map(*(F.lit(x) for kv in HARNESS.items() for x in kv))
    out = kinds.join(rolled, "path", "left")
    return out.select("path", "format", (F.lit(harness) if harness else named[F.col("format")]).alias("harness"), F.coalesce(F.lit(core), F.col("model")).alias("core"), "session_id", "task", F.coalesce("message_count", F.lit(0)).cast("long").alias("message_count"), F.lit(scope).cast("string").alias("scope"), F.coalesce("markers", F.array().cast("array<struct<mtype:string,body:string>>")).alias("markers"))


def session_json(s: DataFrame) -> DataFrame:
    """(path, json): a session with its keys in their fixed order, nulls included."""
    marks = F.transform("markers", lambda m: F.struct(m.mtype.alias("type"), m.body.alias("text")))
    return s.select("path", F.to_json(F.struct("harness", "core", "session_id", "task", "message_count", "scope", marks.alias("markers")), {"ignoreNullFields": "false"}).alias("json"))


def session_from_json(rows: DataFrame) -> DataFrame:
    """(path, json) -> SESSION fields; what is missing takes its default, markers of unknown types are left out."""
    shape = "harness string, core string, session_id string, task string, message_count long, scope string, markers array<struct<type:string,text:string>>"
    x = rows.select("path", F.from_json("json", shape).alias("x"))
    marks = F.transform(F.filter(F.coalesce("x.markers", F.array().cast("array<struct<type:string,text:string>>")), lambda m: m.type.isin(*tx.TYPES)), lambda m: F.struct(m.type.alias("mtype"), m.text.alias("body")))
    return x.select("path", F.coalesce("x.harness", F.lit("")).alias("harness"), "x.core", "x.session_id", "x.task", F.coalesce("x.message_count", F.lit(0).cast("long")).alias("message_count"), "x.scope", marks.alias("markers"))
