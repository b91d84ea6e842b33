"""The record model over plain tables: every document a record, every conversation a session, benchmark passages as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index

START, NOW = 1_767_225_600, 1_790_000_000
#: Questions in the words of the tables.
QUESTIONS = ((0, "Creative Commons license version"), (1, "the token and password of parseHttpRequest"), (2, "thand erthing ouand thatnt"), (3, "de la ciónes de"))
_BUILT: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(n: Column) -> Column:
    kind = F.when(n % 4 == 0, "fact").when(n % 4 == 1, "decision").when(n % 4 == 2, "rule").otherwise("session-summary")
    return F.concat(kind, F.lit("-doc-"), n.cast("string"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    half = F.expr("doc_id div 2")
    created = F.lit(START).cast("long") + 3600 * d
    return read(spark, sf_dir, "documents").select(
        _id(d).alias("id"), F.substring_index(_id(d), "-doc-", 1).alias("mtype"), created.alias("created"), F.left(F.substring_index("text", "\n", 1), F.lit(100)).alias("title"), F.array("lang", "source").alias("tags"),
        F.when(d > 0, F.array(_id(half))).otherwise(F.array().cast("array<string>")).alias("links"), F.when(d % 3 != 0, F.concat(F.lit("project:"), "source")).alias("scope"),
        F.when(d % 5 != 0, (d * 7919) % 1000001).alias("confidence"), F.when(d % 4 != 1, created + (d * 104729) % 15552000).alias("last_used"),
        F.when(d % 3 == 0, "desk").when(d % 3 == 1, "shell").alias("harness"), F.when(d % 2 == 0, F.concat(F.lit("m"), (d % 5).cast("string"))).alias("core"), F.when(d % 2 == 1, F.concat(F.lit("noted "), d.cast("string"))).alias("rationale"),
        F.concat(F.lit("memories/"), _id(d), F.lit(".md")).alias("path"), F.col("text").alias("body"), d.alias("doc_id"),
    )


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder's documents, built once in a session, as a store keeps its own."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = Index.build(memories(spark, sf_dir))
    return _BUILT[key]


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid long, text string")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


# The same model in SQL.


def sql_id(n: str) -> str:
    return f"(case ({n}) % 4 when 0 then 'fact' when 1 then 'decision' when 2 then 'rule' else 'session-summary' end || '-doc-' || ({n}))"


MEM = f"""mem as (select {sql_id("doc_id")} as id, split_part({sql_id("doc_id")}, '-doc-', 1) as mtype, {START} + 3600 * doc_id as created, left(split_part(text, chr(10), 1), 100) as title,
 [lang, source] as tags, case when doc_id > 0 then {sql_id("doc_id // 2")} end as link, case when doc_id % 3 <> 0 then 'project:' || source end as scope,
 case when doc_id % 5 <> 0 then (doc_id * 7919) % 1000001 end as confidence, case when doc_id % 4 <> 1 then {START} + 3600 * doc_id + (doc_id * 104729) % 15552000 end as last_used,
 case when doc_id % 2 = 1 then 'noted ' || doc_id end as rationale, text as body, doc_id from documents)"""
ASKED = "asked(qid, text) as (values " + ", ".join(f"({q}::bigint, '{t}')" for q, t in QUESTIONS) + ")"
PASSAGES = "asked as (select item_id as qid, text from benchmark)"
SPLIT = r"[^\p{L}\p{N}_]+"


def sql_words(text: str) -> str:
    return f"[w for w in regexp_split_to_array({text}, '{SPLIT}') if w <> '']"


def sql_parts(w: str) -> str:
    for a in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", "([^0-9_])([0-9])", "([0-9])([^0-9_])"):
        w = rf"regexp_replace({w}, '{a}', '\1_\2', 'g')"
    return f"[p for p in regexp_split_to_array({w}, '_+') if p <> '']"


def sql_terms(w: str) -> str:
    return f"list_concat([lower({w})], case when len({sql_parts(w)}) > 1 then [lower(p) for p in {sql_parts(w)} if lower(p) <> lower({w})] else [] end)"


def sql_stop(stopwords) -> str:
    return "(" + ", ".join(f"'{w}'" for w in stopwords) + ")"
