"""Recall: BM25, then the link graph, then the sub-word rerank, with filters, decay, diversity and packing; every hit explained.

Corpus statistics, graph seeds and similarities cover the whole corpus; filters only decide what is returned, and act before
anything is cut off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..functions import text as tx
from ..functions import tokenize as tk
from ..storage import materialised, tasks
from . import bm25, embed, graph, rank
from .index import SORTED, Index

# The cosine from which a document is a hit by similarity alone, and the share of the cosine added to a score.
SEMANTIC_FLOOR, BETA = 350_000, fx.SCALE // 2
HIT = ("qid", "rank", "id", "mtype", "title", "created", "path", "score_micros", "graph_micros", "graph_via", "rationale", "harness", "core", "why")


@dataclass
class Options:
    k: int = 10
    mtype: str | None = None
    tag: str | None = None
    scope: str | None = None
    budget: int | None = None
    diverse: bool = False
    rerank: bool = True
    decay: bool = False
    now: int | None = None
    half_life: int = fx.HALF_LIFE
    decay_weight: int = fx.DECAY_WEIGHT
    min_score: int = 0

    def __post_init__(self):
        if self.k < 1:
            raise ValueError("k must be 1 or more")
        if self.mtype is not None and self.mtype not in tx.TYPES:
            raise ValueError(f"unknown type {self.mtype!r}")


def passes(o: Options) -> Column:
    """Type and tag as asked; the scope asked for, or none, or global."""
    out = F.lit(True)
    if o.mtype is not None:
        out = out & (F.col("mtype") == o.mtype)
    if o.tag is not None:
        out = out & F.coalesce(F.array_contains("tags", o.tag), F.lit(False))
    if o.scope is not None:
        out = out & F.coalesce("scope", F.lit("global")).isin(o.scope, "global")
    return out


def terms_of(hits: DataFrame, postings: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(id, terms) of the documents among hits: postings of others leave before any are gathered, in tasks of bounded size.

    documents (id, terms), if there are: the same as postings.
    """
    ids = materialised(hits.select("id").distinct(), "ids")
    if documents is not None:
        return documents.select("id", "terms").join(bm25.small(ids), "id", "left_semi").where(F.size("terms") > 0)
    count = ids.count()
    few, n = count <= bm25.SMALL, tasks(postings, min(postings.count(), 512 * count), SORTED)
    held = postings.select("id", "term")
    held = held.join(F.broadcast(ids), "id", "left_semi").repartition(n, "id") if few else held.repartition(n, "id").join(ids.repartition(n, "id"), "id", "left_semi")
    return held.groupBy("id").agg(F.collect_list("term").alias("terms"))


def shared_subtokens(hits: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """(qid, id, shared): the first three query terms of three bytes or more that hold, or are held by, a term of the document."""
    terms = F.filter(F.array_distinct(tk.tokenize(F.col("text"))), lambda t: F.octet_length(t) >= 3)
    held = terms_of(hits, index.postings.where(F.octet_length("term") >= 3), index.documents).withColumn("terms", F.filter("terms", lambda t: F.octet_length(t) >= 3))
    rows = hits.select("qid", "id").join(held, "id").join(bm25.small(queries.select("qid", terms.alias("asked"))), "qid")
    held = F.filter("asked", lambda q: F.exists("terms", lambda d: F.contains(d, q) | F.contains(q, d)))
    return rows.select("qid", "id", F.slice(held, 1, 3).alias("shared"))


def candidates(index: Index, queries: DataFrame, o: Options) -> DataFrame:
    """(qid, id, kind, score_micros, graph_micros, graph_via, bm25_micros, sim, matched_terms): lexical, graph and semantic hits, each document once."""
    scored = materialised(bm25.scores(index, queries, explain=True), "scores")
    docs, none = index.docs.where(passes(o)).select("id"), F.lit(None).cast("string")
    above = lambda df, c: df.where(F.col(c) >= o.min_score) if o.min_score > 0 else df
    zero, empty = F.lit(0).cast("long"), F.array().cast(dict(scored.dtypes)["matched_terms"])
    lexical = above(scored, "score_micros").join(docs, "id", "left_semi").select("qid", "id", F.lit("lexical").alias("kind"), "score_micros", zero.alias("graph_micros"), none.alias("graph_via"), F.col("score_micros").alias("bm25_micros"), "matched_terms")
    edge = materialised(graph.edges(index.docs), "edges")
    seeds = scored.select("qid", "id", F.col("score_micros").alias("weight"))
    mass = graph.personalized_pagerank(edge, seeds).where(F.col("mass") >= graph.FLOOR).join(seeds, ["qid", "id"], "left_anti")
    reached = above(mass, "mass").join(docs, "id", "left_semi")
    linked = reached.join(graph.strongest_seed(edge, reached.select("qid", "id"), seeds), ["qid", "id"]).select("qid", "id", F.lit("graph").alias("kind"), F.col("mass").alias("score_micros"), F.col("mass").alias("graph_micros"), F.col("via").alias("graph_via"), zero.alias("bm25_micros"), empty.alias("matched_terms"))
    hits = lexical.unionByName(linked)
    if not o.rerank:
        return hits.withColumn("sim", zero)
    hits = materialised(hits, "hits")
    sim = materialised(embed.similarities(index.postings, index.vocabulary(), queries, hits, SEMANTIC_FLOOR, index.documents), "sims")
    boosted = hits.join(sim, ["qid", "id"], "left").withColumn("sim", F.coalesce("sim", zero)).withColumn("score_micros", F.col("score_micros") + fx.div("sim", 2))
    alone = above(sim.where(F.col("sim") >= SEMANTIC_FLOOR), "sim").join(hits, ["qid", "id"], "left_anti").join(docs, "id", "left_semi")
    return boosted.unionByName(alone.select("qid", "id", F.lit("semantic").alias("kind"), F.col("sim").alias("score_micros"), zero.alias("graph_micros"), none.alias("graph_via"), zero.alias("bm25_micros"), empty.alias("matched_terms"), "sim"))


def card_cost() -> Column:
    """What a hit takes of a budget."""
    return tx.card_cost(F.col("title"), F.col("rationale"), F.col("id"))


def diverse(hits: DataFrame, index: Index, o: Options) -> DataFrame:
    """The first k hits by maximal marginal relevance; with a budget, so many that packing finds all it would among all hits."""
    terms, k = materialised(terms_of(hits, index.postings, index.documents), "terms"), o.k
    if o.budget is None:
        return rank.diversified(hits, terms, k)
    every = hits.groupBy("qid").agg(F.count("*").alias("n"), F.min(card_cost()).alias("least"))
    while True:
        first = materialised(rank.diversified(hits, terms, k), "diverse")
        full = rank.packed(first, o.k, o.budget, card_cost()).groupBy("qid").agg(F.count("*").alias("kept"), F.sum(card_cost()).alias("spent"))
        seen = first.groupBy("qid").agg(F.count("*").alias("seen"))
        if every.join(full, "qid").join(seen, "qid").where((F.col("kept") < o.k) & (F.col("seen") < F.col("n")) & (F.col("spent") + F.col("least") <= o.budget)).isEmpty():
            return first
        k *= 4


def recall(index: Index, queries: DataFrame, options: Options | None = None) -> DataFrame:
    """queries (qid, text) -> hits (HIT), by qid and rank. why holds score_micros, matched_terms, ignored_terms and rerank."""
    o = options or Options()
    hits = candidates(index, queries, o).join(index.docs.select("id", "mtype", "title", "created", "path", "rationale", "harness", "core", "confidence", "last_used"), "id")
    if o.decay and o.decay_weight > 0 and o.now is not None:
        hits = rank.with_decay(hits, o.now, o.half_life, o.decay_weight)
    hits = rank.placed(hits) if o.diverse or o.budget is not None else rank.ranked(hits)
    if o.diverse:
        hits = diverse(materialised(hits, "ranked"), index, o)
    hits = materialised(rank.packed(hits, o.k, o.budget, card_cost()), "packed")
    ignored = bm25.ignored_terms(index, queries).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term", "reason"))), lambda x: F.struct(x.term.alias("term"), x.reason.alias("reason"))).alias("ignored"))
    hits = hits.join(bm25.small(ignored), "qid", "left")
    rerank = F.lit(None)
    if o.rerank:
        hits = hits.join(shared_subtokens(hits, queries, index), ["qid", "id"], "left")
        rerank = F.struct("bm25_micros", F.col("sim").alias("embed_sim_micros"), F.lit(fx.SCALE).cast("long").alias("alpha_micros"), F.lit(BETA).cast("long").alias("beta_micros"), F.coalesce("shared", F.array().cast("array<string>")).alias("shared_subtokens"))
    why = F.struct(F.when(F.col("kind") == "lexical", F.col("bm25_micros")).otherwise(F.lit(0).cast("long")).alias("score_micros"), "matched_terms", F.coalesce("ignored", F.array().cast("array<struct<term:string,reason:string>>")).alias("ignored_terms"), *([rerank.alias("rerank")] if o.rerank else []))
    return hits.withColumn("why", why).select(*HIT).orderBy("qid", "rank")


def why_line(why: Column, via: Column, mass: Column, has_rerank: bool = True) -> Column:
    """One line for people: the link, the similarity, or the matched terms."""
    term = lambda t: F.concat(F.array_join(t.fields_hit, "+"), F.lit('~"'), t.term, F.lit('"(tf '), (t.tf_per_field.title + t.tf_per_field.tags + t.tf_per_field.body).cast("string"), F.lit(")"))
    n = F.size(why.ignored_terms)
    tail = F.when(n > 0, F.concat(F.lit(", "), n.cast("string"), F.lit(" ignored ("), F.array_join(F.transform(why.ignored_terms, lambda x: x.term), ", "), F.lit(")"))).otherwise("")
    lexical = F.concat(F.lit("why: "), F.array_join(F.transform(why.matched_terms, term), " "), F.lit(" — "), F.size(why.matched_terms).cast("string"), F.lit(" matched"), tail)
    linked = F.concat(F.lit("why: reached via link from "), via, F.lit(" (graph "), fx.render_micros(mass), F.lit(")"))
    out = F.when(via.isNotNull(), linked)
    if has_rerank:
        shared = F.array_join(why.rerank.shared_subtokens, ", ")
        near = F.concat(F.lit("why: semantically similar (embed "), fx.render_micros(why.rerank.embed_sim_micros), F.lit(")"), F.when(shared != "", F.concat(F.lit(" via "), shared)).otherwise(""))
        out = out.when((F.size(why.matched_terms) == 0) & (why.rerank.embed_sim_micros > 0), near)
    return out.otherwise(lexical)


def to_json(hits: DataFrame) -> DataFrame:
    """(qid, rank, json): a hit with all its keys, in their fixed order, nulls included."""
    row = F.struct("id", F.col("mtype").alias("type"), "title", fx.format_rfc3339("created").alias("created"), "path", "score_micros", "graph_micros", "graph_via", "rationale", "harness", "core", "why")
    return hits.select("qid", "rank", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def contributions_add_up(hits: DataFrame) -> DataFrame:
    """Hits whose explanation doesn't sum to its score; there are none."""
    return hits.where(F.aggregate("why.matched_terms", F.lit(0).cast("long"), lambda a, t: a + t.contribution_micros) != F.col("why.score_micros"))
