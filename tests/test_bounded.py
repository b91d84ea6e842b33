"""Tasks of index and search grow in number, not in size; results stay the same however many there are."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandex.operators import bm25, embed, index, rank
from strandex.operators.recall import terms_of
from strandex.plans import catalog
from strandex.plans import tables as t

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def same(a, b):
    return sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_index_in_tasks_of_bounded_size(spark, monkeypatch):
    """Words are counted and postings ordered in as many tasks as their size asks for, also under a small number of shuffle partitions."""
    memories = t.memories(spark, FOLDER)
    size = memories.agg(F.sum(F.octet_length("body"))).first()[0]
    plain = index.postings(memories).collect()
    monkeypatch.setattr(index, "COUNTED", size // 40)
    monkeypatch.setattr(index, "SORTED", len(plain) // 30)
    post = index.postings(memories)
    dealt = post.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()
    assert len(dealt) > 30 and max(r.n for r in dealt) < len(plain) / 5
    assert sorted(map(tuple, post.collect())) == sorted(map(tuple, plain))
    table = catalog.materialised(post, "test")
    parts = index.in_order(table).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.min("term").alias("a"), F.max("term").alias("b")).orderBy("p").collect()
    assert max(r.n for r in parts) < len(plain) / 10 and all(x.b <= y.a for x, y in zip(parts, parts[1:]))


def test_one_frequent_term_is_dealt_out(spark, monkeypatch):
    rows = spark.range(4000).select(F.format_string("%05d", "id").alias("id"), F.lit("de").alias("term"))
    monkeypatch.setattr(index, "SORTED", 200)
    assert max(r["count"] for r in index.in_order(catalog.materialised(rows, "test")).groupBy(F.spark_partition_id()).count().collect()) < 1000


def test_scores_in_tasks_of_bounded_size(spark, monkeypatch):
    """A document's pairs are in one task, and no task has many."""
    ix, asked = t.index(spark, FOLDER), t.passages(spark, FOLDER)
    want = bm25.scores(ix, asked).collect()
    monkeypatch.setattr(bm25, "PAIRS", max(1, len(want) // 40))
    got = bm25.scores(ix, asked)
    dealt = got.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and want
    assert len(dealt) > 20 and max(r.n for r in dealt) < len(want) / 5


def test_ranks_without_a_task_for_each_query(spark, monkeypatch):
    rows = [(q, f"{i:04}", i % 7 * (q + 1)) for q in range(3) for i in range(500)]
    hits = spark.createDataFrame(rows, "qid long, id string, score_micros long")
    monkeypatch.setattr(rank, "ORDERED", 60)
    placed = rank.placed(hits)
    assert same(placed, rank.ranked(hits))
    assert rank.placed(hits.limit(0)).count() == 0


def test_terms_of_many_hits(spark, monkeypatch):
    """As of few."""
    post = t.index(spark, FOLDER).postings
    hits = post.select("id").distinct().where(F.xxhash64("id") % 2 == 0)
    got = lambda: {r.id: sorted(r.terms) for r in terms_of(hits, post).collect()}
    few = got()
    monkeypatch.setattr(bm25, "SMALL", 3)
    assert got() == few and len(few) > 3


def test_nearest_terms_write_no_pairs(spark, monkeypatch):
    """The best cosines of documents are those among all pairs, from slices that cut documents, and few rows are shuffled for them."""
    ix = t.index(spark, FOLDER)
    tokens = sorted({w for r in t.questions(spark).select(catalog.tk.tokenize(F.col("text")).alias("x")).collect() for w in r.x})
    want = {(r.id, r.token): r.best for r in ix.postings.join(embed.term_cosines(ix.vocabulary(), tokens), "term").groupBy("id", "token").agg(F.max("cosine").alias("best")).collect()}
    got = embed.nearest(ix.postings, tokens)
    assert {(r.id, r.token): r.best for r in got.collect()} == want and want
    rows = [(f"{i // 40:03}", r.term) for i, r in enumerate(ix.vocabulary().orderBy("term").limit(400).collect())]
    monkeypatch.setattr(embed, "COMPARED", 7)
    monkeypatch.setattr(embed, "REMEMBERED", 30)
    table = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 25])], names=["id", "term"]) for i in range(0, 400, 25)]
    some = {}
    for b in embed._best(table, tokens):
        for i, token, best in zip(*(c.to_pylist() for c in b.columns)):
            assert (i, token) not in some
            some[i, token] = best
    plain = {}
    c = embed.cosines([x for _, x in rows], embed.vectors(tokens))
    for (i, _), near in zip(rows, c):
        for token, best in zip(tokens, near):
            if best:
                plain[i, token] = max(plain.get((i, token), 0), best)
    assert some == plain


def test_similarities_shuffle_postings_only(spark):
    """No join of postings with cosines, which made a row for each pair of posting and token."""
    ix = t.index(spark, FOLDER)
    df = embed.similarities(ix.postings, ix.vocabulary(), t.questions(spark))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "cosine#" not in plan and plan.count("MapInArrow") == 1
