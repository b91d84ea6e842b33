"""op1's threshold is that of all labelled rows."""

import random

import numpy as np
import pytest

from strandex.llm import op01_quality_rules as op1


def plain(rows, share):
    clean = sorted((s for s, good in rows if good), reverse=True)
    return float("inf") if not clean or len(clean) == len(rows) else float(np.nextafter(clean[int(share * len(clean))], 2))


@pytest.mark.parametrize("bins", [3, 4096])
def test_threshold_of_all_rows(spark, monkeypatch, bins):
    """Exactly, from few bins too, with ties and values that lie close."""
    monkeypatch.setattr(op1, "BINS", bins)
    rng = random.Random(5)
    many = [(rng.random(), rng.random() < 0.9) for _ in range(3000)]
    close = [(0.5 + i * 2**-53, i % 3 > 0) for i in range(300)]
    ties = [(rng.choice((0.3, 0.4, 0.4000001)), rng.random() < 0.7) for _ in range(400)]
    for rows in (many, close, ties, [(0.5, True)], [(0.5, False)], [(0.2, True), (0.9, False)]):
        known = spark.createDataFrame(rows, "anomaly double, good boolean")
        for share in (0.0, 0.005, 0.3):
            assert op1.threshold(known, share) == plain(rows, share)


def test_every_label_counts(spark):
    """With a small sample for the trees, the threshold is still that of all labelled rows."""
    rng = random.Random(6)
    docs = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(60, 90)))) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(600)], "doc_id long, quality int")
    rows = op1.quality_rules(table, labels, sample=50, max_false=0.02).collect()
    known = [(r.anomaly, r.doc_id % 10 > 0) for r in rows if not r.base_failed]
    cut = plain(known, 0.02)
    assert len(known) > 500 and all(r.kept == (not r.base_failed and r.anomaly < cut) for r in rows)
