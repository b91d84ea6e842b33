"""BM25 over weighted fields in fixed point, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..functions import tokenize as tk
from ..storage import tasks
from .index import FIELDS, WEIGHTS, Index

# Fixed values, in micro-units: k1, b and what follows from them.
K1, B = 1_200_000, 750_000
#: Rows up to which a side is sent to all executors; beyond, joins shuffle.
SMALL = 200_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """Marked for broadcast if it has so few rows, counted; as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term), each term once for a query."""
    return queries.select("qid", F.explode(F.array_distinct(tk.tokenize(F.col("text")))).alias("term"))


def idf(stats: DataFrame, df: DataFrame) -> DataFrame:
    """df with idf_micros = ln((2N + 2) / (2 df + 1)). One row of statistics is joined."""
    return df.crossJoin(F.broadcast(stats.select("n_docs"))).select(*df.columns, fx.ln_micros(2 * F.col("n_docs") + 2, 2 * F.col("df") + 1).alias("idf_micros"))


def norms(index: Index) -> DataFrame:
    """(id, norm): weighted length against the average, in micro-units."""
    total = lambda p: sum((F.col(f"{p}_{n}") * w for n, w in zip(FIELDS, WEIGHTS, strict=True)), F.lit(0).cast("long"))
    rows = index.docs.crossJoin(F.broadcast(index.stats)).select("id", "n_docs", total("len").alias("own"), total("total").alias("all"))
    return rows.select("id", F.when(F.col("all") == 0, F.lit(fx.SCALE).cast("long")).otherwise(fx.SCALE - B + fx.mul_div_round(F.lit(B).cast("long"), F.col("own") * F.col("n_docs"), F.col("all"))).alias("norm"))


#: Pairs of query and document whose scores one task sums.
PAIRS = 1_000_000


#: Asked terms up to which they are named in the filter on postings, so that pages without them are not read.
NAMED = 100


def of_terms(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose term is among the terms, if these are few; all rows otherwise, for a join to choose from."""
    few = [r.term for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
    return df if len(few) > NAMED else df.where(reduce(Column.__or__, (F.col("term") == x for x in few), F.lit(False)))


def contributions(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, id, term, tf_*, df, idf_micros, contribution_micros) of every match.

    The postings of the asked terms are dealt out by id before they meet the queries: each is weighed once, however many ask for it,
    and a task has all pairs of its documents. Tasks grow in number with documents and queries.
    """
    terms = query_terms(queries)
    weighed = idf(index.stats, of_terms(index.df, terms).join(small(terms.select("term").distinct()), "term"))
    n = tasks(index.docs, index.docs.count() * queries.count(), PAIRS)
    rows = of_terms(index.postings, terms).join(small(weighed), "term").repartition(n, "id").join(norms(index).repartition(n, "id"), "id")
    tf = sum((F.col(f"tf_{n}") * w for n, w in zip(FIELDS, WEIGHTS, strict=True)), F.lit(0).cast("long"))
    below = tf * fx.SCALE + fx.mul_div_round(F.lit(K1).cast("long"), F.col("norm"), F.lit(fx.SCALE).cast("long"))
    rows = rows.select("id", "term", *(f"tf_{n}" for n in FIELDS), "df", "idf_micros", fx.mul_div_round(F.col("idf_micros"), tf * (K1 + fx.SCALE), below).alias("contribution_micros"))
    return rows.join(small(terms), "term").select("qid", "id", "term", *(f"tf_{n}" for n in FIELDS), "df", "idf_micros", "contribution_micros")


def scores(index: Index, queries: DataFrame, explain: bool = False) -> DataFrame:
    """(qid, id, score_micros) of positive scores; with `explain`, matched_terms by contribution, largest first, then term."""
    rows = contributions(index, queries)
    out = [F.sum("contribution_micros").alias("score_micros")]
    if explain:
        hit = F.filter(F.array(*(F.when(F.col(f"tf_{n}") > 0, F.lit(n)) for n in FIELDS)), lambda x: x.isNotNull())
        entry = F.struct((-F.col("contribution_micros")).alias("_order"), "term", hit.alias("fields_hit"), F.struct(*(F.col(f"tf_{n}").alias(n) for n in FIELDS)).alias("tf_per_field"), "df", "idf_micros", "contribution_micros")
        plain = lambda x: F.struct(*(x[c].alias(c) for c in ("term", "fields_hit", "tf_per_field", "df", "idf_micros", "contribution_micros")))
        out.append(F.transform(F.array_sort(F.collect_list(entry)), plain).alias("matched_terms"))
    return rows.groupBy("qid", "id").agg(*out).where("score_micros > 0")


def ignored_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, pos, term, reason) of query terms that match nothing: stopword, or not-in-corpus; in the order of first sight."""
    rows = queries.select("qid", F.posexplode(F.array_distinct(tk.tokenize_all(F.col("text")))).alias("pos", "term"))
    known = rows.join(index.df, "term", "left")
    reason = F.when(tk.is_stopword(F.col("term")), "stopword").when(F.col("df").isNull(), "not-in-corpus")
    return known.select("qid", F.col("pos").cast("long").alias("pos"), "term", reason.alias("reason")).where("reason is not null")
