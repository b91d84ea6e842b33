"""The token budget: a plain fold against pruned batches and the stream."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandex.operators import rank


def plain_packed(rows, k, budget):
    """(qid, id) kept, by going through each query's hits in turn."""
    by, out = defaultdict(list), set()
    for q, id_, r, c in rows:
        by[q].append((r, id_, c or 0))
    for q, hits in by.items():
        spent = n = 0
        for _, id_, c in sorted(hits):
            if n < k and (n == 0 or spent + c <= budget):
                spent, n = spent + c, n + 1
                out.add((q, id_))
    return out


def some_hits(rng, queries, most):
    rows = []
    for q in range(queries):
        top = rng.choice([3, 12, 60, 300])
        for r in range(1, rng.randrange(1, most) + 1):
            rows.append((q, f"d{r}", r, rng.choice([0, None, rng.randrange(top), rng.randrange(top), 10 * top])))
    rng.shuffle(rows)
    return rows


def test_batches_drop_only_what_is_not_kept():
    rng = random.Random(31)
    for trial in range(400):
        k, budget = rng.choice([1, 2, 5, 10]), rng.choice([0, 7, 40, 120])
        rows, left, size = some_hits(rng, 3, 60), [], rng.choice([1, 5, 17, 200])
        for i in range(0, len(rows), size):
            part = rows[i : i + size]
            left += [x for x, ok in zip(part, rank.hopeful([x[0] for x in part], [x[2] for x in part], [x[3] or 0 for x in part], k, budget), strict=True) if ok]
        assert plain_packed(left, k, budget) == plain_packed(rows, k, budget), trial


def test_few_are_left_of_many():
    rng = random.Random(32)
    cost = [8 + rng.randrange(40) for _ in range(20_000)]
    assert sum(rank.hopeful([1] * 20_000, list(range(20_000)), cost, 10, 120)) < 60


@pytest.mark.parametrize("batch", [7, 10_000])
def test_packing_as_a_stream(spark, batch):
    rng = random.Random(33)
    rows = some_hits(rng, 40, 90) + [(99, f"d{r}", r, rng.randrange(1, 50)) for r in range(1, 4000)]
    hits = spark.createDataFrame(rows, "qid long, id string, rank long, price long").withColumn("why", F.struct(F.array("id").alias("terms"), F.map_from_arrays(F.array("id"), F.array("rank")).alias("m")))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        for k, budget in ((10, 120), (3, 0), (200, 900)):
            got = rank.packed(hits.repartition(5), k, budget, F.col("price"))
            assert got.schema.names == hits.schema.names
            kept = got.collect()
            assert {(r.qid, r.id) for r in kept} == plain_packed(rows, k, budget) and len(kept) == len({(r.qid, r.id) for r in kept})
            assert all(r.why.terms == [r.id] and r.why.m[r.id] == r["rank"] for r in kept)
        assert rank.packed(hits.limit(0), 3, 10, F.col("price")).count() == 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Join" not in plan
    finally:
        spark.conf.set(name, before)
