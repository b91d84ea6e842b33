"""The corpus pipeline, stage by stage, on a small folder of tables with planted cases."""

import random

import corpus_pipeline
from strandex.llm import op04_decontaminate, op06_line_dedup, op08_ngram_join, op09_packing, op10_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string"


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n, stem="w": " ".join(f"{stem}{rng.randrange(5000)}" for _ in range(n))
    clean = [(i, "\n".join(say(30) for _ in range(4))) for i in range(60)]
    toxic = [(100 + i, say(60) + " vile nasty vile awful " + say(60)) for i in range(40)]
    run = say(55, "run")
    repeat = [(200 + i, say(40) + "\n" + run + "\n" + say(40)) for i in range(4)]
    near = [(300, clean[0][1] + " tail"), (301, clean[1][1])]
    item = say(30, "bench")
    leak = [(400, say(50) + " " + item.upper() + " " + say(50))]
    rows = [(i, t, "en", "s", len(t), "x") for i, t in clean + toxic + repeat + near + leak] + [(None, None, None, None, None, None), (500, "", "en", "s", 0, "x")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = {r.doc_id: r for r in docs.collect()}
    kept = {i for i, _ in clean} | {i for i, _ in repeat} | {300, 301, 400, None, 500}
    assert set(after["toxicity"]) == kept
    assert sum(run in (r.text or "") for r in after["line_dedup"].values()) == 1 and run in after["line_dedup"][200].text
    assert after["line_dedup"][201].n_chars == len(after["line_dedup"][201].text)
    assert set(after["line_dedup"]) == kept - {301}  # its lines were all copies
    assert set(after["ngram_join"]) == set(after["line_dedup"])  # 300 has only its changed line left
    assert set(after["decontamination"]) == set(after["ngram_join"]) - {400}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(after["decontamination"])


def test_one_of_each(spark):
    rng = random.Random(2)
    a = " ".join(f"w{rng.randrange(999)}" for _ in range(100))
    rows = [(5, a, None, None, None, "y"), (3, a + " x", None, None, None, "y"), (3, a + " x", None, None, None, "y"), (7, "other words stand in this text", None, None, None, "y"), (8, None, None, None, None, None), (9, "", None, None, None, None)]
    got = op08_ngram_join.one_of_each(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in got.collect()) == [3, 7, 8, 9]


def test_one_of_each_goes_by_row(spark):
    """An id with two different texts: a row goes only where another row of its own group stays; null ids come last."""
    rng = random.Random(3)
    say = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(100))
    a, b, c = say(), say(), say()
    rows = [(3, a), (3, b), (4, b + " x"), (2, c + " y"), (3, c), (None, a), (6, say()), (6, say())]
    got = op08_ngram_join.one_of_each(spark.createDataFrame([(i, t, None, None, None, "y") for i, t in rows], DOCS))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(3, a), (3, b), (2, c + " y"), *rows[6:]])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    no_labels, no_items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c", None, None, None, "x"), (None, None, None, None, None, None)], DOCS)
    stages = (lambda d: op10_toxicity.harmless(d, no_labels), op06_line_dedup.dedup_lines, op08_ngram_join.one_of_each, lambda d: op04_decontaminate.clean(d, no_items))
    for stage in stages:
        assert stage(none).columns == none.columns and stage(none).count() == 0
        assert stage(some).count() == 2
    assert op09_packing.packed(none).count() == 0


def test_one_hot_key(spark):
    """All rows of one source, most of them copies of one text, with one line and one passage that all share."""
    rng = random.Random(5)
    line, body = " ".join(f"l{i}" for i in range(55)), " ".join(f"w{rng.randrange(999)}" for _ in range(120))
    rows = [(i, f"{line}\n{body}" if i % 3 else f"{line}\n" + " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)), "en", "s", None, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    left = {r.doc_id: r.text for r in op06_line_dedup.dedup_lines(docs).collect()}
    assert sorted(left) == sorted({0, 1} | {i for i in range(600) if i % 3 == 0}) and sum(line in t for t in left.values()) == 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op08_ngram_join.near_duplicates(docs).collect()}
    assert all(got[i][1] == (1 if i % 3 else i) for i in got)
    assert {r.doc_id for r in op08_ngram_join.one_of_each(docs).collect()} == {1} | {i for i in range(600) if i % 3 == 0}
