"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Candidate strings (assignments, access keys, long hexadecimal runs, and other long mixed tokens) are found with the JVM's own
regular expressions. Their hashes are aggregated over all rows by the distinct owners and repositories that hold them. A value
that `shared_by` owners or `copied` repositories hold is a widely copied example; any other, held by one owner or two in a few
repositories, looks like a live credential. Base spans always stay; a mixed token outside them becomes a span of kind `token`
where it looks random and live.

owner and repository are parameters; a repository is known by its owner and its name. The table of documents names a source
only, so the query takes the source as the owner and each document as a repository of its own.

Places come without a Python function: each match is taken together with what lies before it since the last one
(`\\G.*?pattern`), and the running sum of those lengths gives the ends.

Defined cases: a null text counts as empty (no spans); null owners and repositories count as one owner and repository with no
name; repeated rows get a row each (identical ids and texts the same result, every owner of theirs counted); a null doc_id is
returned as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "token")
#: (a group for the whole match, the group with the value, the least length of the value); each after \G and what lies before.
PATTERNS = (
    (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    (r"AKIA[A-Z0-9]+", 1, 20),
    (r"[0-9a-f]{24,}", 1, 24),
    (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 1, 20),
)
#: Cheap signs without which a text cannot match.
HINTS = (r"(?i)passw|secret|token|api_?key", r"AKIA", r"[0-9a-f]{24}", r"[A-Za-z0-9+/_=-]{20}")


def _parts(kind: int):
    """Array of (length with what lies before, length of the match, hash of the value, is the value long enough or mixed)."""
    pattern, group, least = PATTERNS[kind]
    regex = F.lit(rf"\G(?s:.*?)({pattern})")
    whole = F.regexp_extract_all("text", regex, F.lit(0))
    match, value = F.regexp_extract_all("text", regex, F.lit(1)), F.regexp_extract_all("text", regex, F.lit(group))

    def part(w, i):
        v = F.get(value, i)
        good = F.length(v) >= least
        if kind == 3:  # mixed: digits, letters of either case, many different characters
            good = good & v.rlike("[0-9].*[0-9].*[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 12)
        return F.struct(F.length(w).alias("upto"), F.length(F.get(match, i)).alias("len"), F.sha2(v, 256).alias("value"), good.alias("good"), F.lit(kind).alias("kind"), i.alias("i"))

    return F.when(F.col("text").rlike(HINTS[kind]), F.transform(whole, part)).otherwise(F.array())


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """(r1, r2, doc_id, owner, repo, parts) for every document; parts in the order of the text, by kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*common.row_key(), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repo"), text.alias("text"))
    return base.select("r1", "r2", "doc_id", "owner", "repo", F.concat(*(_parts(k) for k in range(len(KINDS)))).alias("parts"))


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repos): how many distinct owners and repositories hold a value, over all rows.

    Distinct holders first, so that a value which everybody copies is partial sums by the time its rows meet.
    """
    values = F.array_distinct(F.transform(F.filter("parts", lambda p: p.good), lambda p: p.value))
    holders = found.select("owner", "repo", F.explode(values).alias("value")).distinct()
    return holders.groupBy("value", "owner").agg(F.count("*").alias("repos")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def secret_scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", shared_by: int = 3, copied: int = 10) -> DataFrame:
    """docs (doc_id, text, owner, repository) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token, n_live, n_example."""
    found, row = common.saved(candidates(docs, owner, repository), "secrets", common.SCAN), ["r1", "r2"]
    upto = F.sum("p.upto").over(W.partitionBy(*row, "p.kind").orderBy("p.i"))
    spans = found.where(F.size("parts") > 0).select(*row, "parts").dropDuplicates(row).select(*row, F.explode("parts").alias("p"))
    spans = spans.withColumn("stop", upto).select(*row, "p.kind", "p.value", "p.good", (F.col("stop") - F.col("p.len")).alias("start"), "stop").where("good")
    live = ((F.col("owners") < shared_by) & (F.col("repos") < copied)).alias("live")
    spans = spans.join(ownership(found).select("value", live), "value")
    by_doc = spans.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "live"))).alias("s"))
    base = F.filter("s", lambda x: x.kind < 3)
    apart = lambda x: ~F.exists(base, lambda y: (y.start < x.stop) & (x.start < y.stop))
    by_doc = by_doc.withColumn("base", base).withColumn("every", F.array_sort(F.concat(base, F.filter("s", lambda x: (x.kind == 3) & x.live & apart(x)))))
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.kind + 1), x.start.cast("string"), x.stop.cast("string"))
    text = lambda c: F.array_join(F.transform(c, name), ",")
    count = lambda c, test: F.size(F.filter(c, test)).cast("long")
    of_kind = lambda k: lambda x: x.kind == k  # noqa: E731  one parameter: a second one would be the index
    out = by_doc.select(
        *row, *(count("base", of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)), text("base").alias("b"), text("every").alias("spans"), count("every", lambda x: x.kind == 3).alias("n_token"),
        count("every", lambda x: x.live).alias("n_live"), count("every", lambda x: ~x.live).alias("n_example"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(*row, "doc_id").join(out, row, "left").select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_token"), zero("n_live"), zero("n_example")
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(common.table(spark, sf_dir, "documents"))
