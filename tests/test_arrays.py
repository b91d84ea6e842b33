"""Words, terms and cosines by arrays are those of the plain forms, and whole documents are compared without a shuffle."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandex.functions import tokenize as tk
from strandex.operators import embed, index
from strandex.plans import tables as t

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ODD = "Σίσυφος ΣΑΣ straßeABc fooBarHTTPServer2x a_a_b _x_ __ 12ab ǅungla İstanbul naïvé हिन्दी ①② 漢字 𝐚𝐀b x𝟎2 Ab aB"


def test_terms_as_in_the_jvm(spark):
    """Of odd characters, also beyond 16 bits, and of documents that share an id, whatever is read at a time."""
    rng = random.Random(5)
    texts = [ODD, "", None, *("".join(rng.choice(ODD + "AaZz09_ ") for _ in range(60)) for _ in range(300))]
    rows = [(f"{i // 3:03}", text, ["en", "Two Words"], ODD[i % 50 :] if i % 2 else None) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, title string, tags array<string>, body string")
    fields = {"title": F.col("title"), "tags": F.array_join("tags", " "), "body": F.col("body")}
    want: dict = {}
    for name, c in fields.items():
        for r in df.select("id", F.explode(tk.tokenize(c)).alias("term")).groupBy("id", "term").count().collect():
            want.setdefault((r.id, r.term), dict.fromkeys(fields, 0))[name] = r["count"]
    got = {(r.id, r.term): {n: r[f"tf_{n}"] for n in fields} for r in index.postings(df).collect()}
    assert got == want
    docs = index.by_document(df).collect()
    assert len(docs) == len({r[0] for r in rows}) and all(d[f"len_{n}"] == sum(d[f"tf_{n}"]) for d in docs for n in fields)
    assert all(sum(v["title"] for k, v in want.items() if k[0] == d.id) == d.len_title for d in docs)


def test_postings_need_one_shuffle(spark):
    """Documents by id, once; the rest is done where it lies: no sum, sample or order of postings over the whole."""
    post = index.postings(t.memories(spark, FOLDER))
    plan = post._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") == 1


def test_runs_are_in_order(spark, monkeypatch):
    docs = [(f"{i:03}", [f"t{(i * j) % 17:02}" for j in range(1, 9)]) for i in range(50)]
    n = [[1] * 8 for _ in docs]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([x for _, x in docs]), *(pa.array(n, pa.list_(pa.int32())) for _ in range(3))], names=["id", "terms", "tf_title", "tf_tags", "tf_body"])
    monkeypatch.setattr(index, "RUN", 100)
    runs = list(index._sorted_runs([batch.slice(0, 20), batch.slice(20)]))
    assert sorted((i, x) for b in runs for i, x in zip(b["id"].to_pylist(), b["term"].to_pylist())) == sorted((d, x) for d, xs in docs for x in xs)
    assert len(runs) > 2 and all(b["term"].to_pylist() == sorted(b["term"].to_pylist()) and b.num_rows < 200 for b in runs)


def test_cosines_of_arrays():
    rng = random.Random(1)
    terms = ["", "a", "é", "𝐚", "x" * 5000, "ab" * 900, *("".join(rng.choice("abcdefgh_12éñσ漢字𝐚😀") for _ in range(rng.randint(1, 14))) for _ in range(2000))]
    assert sorted(zip(*(x.tolist() for x in embed.arrow_buckets(pa.array(terms))))) == sorted(zip(*(x.tolist() for x in embed.token_buckets(terms))))
    q = embed.vectors(["license", "ciónes", "x" * 4000, "𝐚é字"])
    assert (embed.arrow_cosines(pa.array(terms).slice(3), q) == embed.cosines(terms[3:], q)).all()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_whole_documents_without_a_shuffle(spark, monkeypatch):
    """The same best cosines from documents as from postings, in slices that cut documents too."""
    ix = t.index(spark, FOLDER)
    tokens = sorted({w for r in t.questions(spark).select(tk.tokenize(F.col("text")).alias("x")).collect() for w in r.x})
    want = {(r.id, r.token): r.best for r in embed.nearest(ix.postings, tokens).collect()}
    df = embed.nearest(ix.postings, tokens, ix.documents)
    assert {(r.id, r.token): r.best for r in df.collect()} == want and want
    assert "Repartition" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = ix.documents.select("id", "terms").limit(20).toArrow().to_batches()
    plain = {(i, k): b for x in embed._best(rows, tokens) for i, k, b in zip(*(c.to_pylist() for c in x.columns))}
    monkeypatch.setattr(embed, "COMPARED", 7)
    cut = [(i, k, b) for x in embed._best(rows, tokens) for i, k, b in zip(*(c.to_pylist() for c in x.columns))]
    assert len({x[:2] for x in cut}) == len(cut) and {x[:2]: x[2] for x in cut} == plain
