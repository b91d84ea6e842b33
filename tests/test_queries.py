"""Every registered query of the catalogue against its SQL, value for value, on the smallest tables."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandex.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in values), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    r = duck.execute(catalog.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, r.fetchall())


def plain_mmr(scores, sets):
    if len(scores) <= 2:
        return list(range(len(scores)))
    half = lambda v: v // 2 if v >= 0 else -(-v // 2)
    top, left, out = max(1, *scores), list(range(len(scores))), []
    rel = [s * 1_000_000 // top if s >= 0 else -(-s * 1_000_000 // top) for s in scores]
    near = [0] * len(scores)
    while left:
        best = max(left, key=lambda i: (half(rel[i] - near[i]), -i))
        left.remove(best)
        out.append(best)
        for i in left:
            near[i] = max(near[i], len(sets[i] & sets[best]) * 1_000_000 // max(1, len(sets[i] | sets[best])))
    return out


def test_mmr_of_many_hits(spark, monkeypatch):
    """The first of all hits, and all of them; from windows that hold few, so that thresholds fall and rounds repeat."""
    ix = catalog.t.index(spark, FOLDER)
    terms = {r.id: frozenset(r.x) for r in ix.postings.groupBy("id").agg(F.collect_list("term").alias("x")).collect()}
    ranked, hits, want = catalog.rank.ranked(catalog.bm25.scores(ix, catalog.t.questions(spark))), {}, {}
    for r in ranked.collect():
        hits.setdefault(r.qid, []).append((-r.score_micros, r.id))
    assert max(map(len, hits.values())) > 50
    for qid, found in hits.items():
        found.sort()
        want[qid] = [found[i][1] for i in plain_mmr([-s for s, _ in found], [terms[i] for _, i in found])]
    by = lambda df: {qid: [i for _, i in sorted((r["rank"], r.id) for r in df.where(F.col("qid") == qid).collect())] for qid in want}
    assert by(catalog.QUERIES["mmr_order"](spark, FOLDER)) == {qid: x[: catalog.DIVERSE] for qid, x in want.items()}
    sets = catalog.rc.terms_of(ranked, ix.postings)
    monkeypatch.setattr(catalog.rank, "WINDOW", 7)
    for k, held in ((5, 10), (1000, 20_000)):
        monkeypatch.setattr(catalog.rank, "HELD", held)
        assert by(catalog.materialised(catalog.rank.diversified(ranked, sets, k), "test")) == {qid: x[:k] for qid, x in want.items()}


def test_mmr_of_copies_and_negative_scores(spark, monkeypatch):
    """Copies and near copies before all else, hits without terms, scores below zero."""
    rng = random.Random(8)
    rows, sets = [], {}
    for qid, low in ((1, 0), (2, -300_000)):
        for i in range(120):
            id_ = f"{qid}-{i:03}"
            sets[id_] = [f"c{j}" for j in range(20)] if i < 60 else [f"c{j}" for j in range(19)] + [f"x{i}"] if i < 80 else rng.sample("abcdefghij", rng.randrange(0, 6))
            rows.append((qid, id_, low + (1000 - i // 2) * 100 if i < 80 else low + rng.randrange(90_000)))
    df = catalog.rank.ranked(spark.createDataFrame(rows, "qid long, id string, score_micros long"))
    terms = spark.createDataFrame(list(sets.items()), "id string, terms array<string>").where("size(terms) > 0")
    monkeypatch.setattr(catalog.rank, "WINDOW", 10)
    got = catalog.rank.diversified(df, terms, 40).collect()
    for qid in (1, 2):
        found = sorted((-s, i) for q, i, s in rows if q == qid)
        want = [found[i][1] for i in plain_mmr([-s for s, _ in found], [frozenset(sets[i]) for _, i in found])][:40]
        assert [i for _, i in sorted((r["rank"], r.id) for r in got if r.qid == qid)] == want


@pytest.mark.parametrize("floor", [350_000, 200_000, 60_000])
def test_similarities_with_a_floor(spark, floor):
    """Of hits exactly, and of what reaches the floor, as among all pairs; few of these are written."""
    embed, ix = catalog.embed, catalog.t.index(spark, FOLDER)
    asked = catalog.t.questions(spark)
    hits = catalog.materialised(catalog.bm25.scores(ix, asked).select("qid", "id").where(F.xxhash64("id") % 3 != 0), "hits")
    whole = {(r.qid, r.id): r.sim for r in embed.similarities(ix.postings, ix.vocabulary(), asked).collect()}
    chosen = {(r.qid, r.id) for r in hits.collect()}
    got = {(r.qid, r.id): r.sim for r in embed.similarities(ix.postings, ix.vocabulary(), asked, hits, floor).collect()}
    need = {k: v for k, v in whole.items() if k in chosen or v >= floor}
    assert need.items() <= got.items() <= whole.items() and all(k in chosen or got[k] >= floor for k in got)
    tokens = sorted({w for r in asked.select(catalog.tk.tokenize(F.col("text")).alias("x")).collect() for w in r.x})
    pairs = {(r.token, r.term): r.cosine for r in embed.term_cosines(ix.vocabulary(), tokens).collect()}
    assert {(r.token, r.term): r.cosine for r in embed.term_cosines(ix.vocabulary(), tokens, floor, 600_000).collect()} == {k: c for k, c in pairs.items() if floor <= c < 600_000}
    assert sum(c >= embed.REACH for c in pairs.values()) < 0.1 * len(pairs)


def test_diverse_within_a_budget(spark):
    """As packing the whole order would."""
    ix = catalog.t.index(spark, FOLDER)
    asked = catalog.t.questions(spark)
    o = catalog.rc.Options(k=6, budget=260, diverse=True, rerank=False)
    got = catalog.rc.recall(ix, asked, o).select("qid", "rank", "id").collect()
    hits = catalog.rank.ranked(catalog.rc.candidates(ix, asked, o).join(ix.docs.select("id", "title", "rationale"), "id"))
    hits = catalog.materialised(hits.withColumn("cost", catalog.rc.card_cost()), "test")
    order = catalog.rank.diversified(hits, catalog.rc.terms_of(hits, ix.postings), 10_000).select("qid", "rank", "id", "cost").collect()
    assert {r.qid for r in got} == {r.qid for r in order} != set()
    for qid in {r.qid for r in got}:
        spent, kept = 0, []
        for r in sorted((r for r in order if r.qid == qid), key=lambda r: r["rank"]):
            if len(kept) < 6 and (not kept or spent + r.cost <= 260):
                spent += r.cost
                kept.append(r.id)
        assert [r.id for r in sorted((r for r in got if r.qid == qid), key=lambda r: r["rank"])] == kept


def test_mmr_of_odd_scores():
    rng = random.Random(4)
    for _ in range(50):
        scores = sorted((rng.randrange(-50, 50) for _ in range(12)), reverse=True)
        sets = [frozenset(rng.sample("abcdefgh", rng.randrange(0, 5))) for _ in scores]
        assert catalog.rank.mmr_order(scores, sets) == plain_mmr(scores, sets)


def test_record_hash_covers_everything(spark, tmp_path):
    same = "x" * 120
    texts = [same + "a", same + "b", "line\nbody", "line\nother", "\nstarts empty", "", "ünï 日本\n😀", None]
    docs = [(i, x, "de", "s") for i, x in enumerate(texts)] + [(8, "line\nbody", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, x, lang, source in docs:
        h = 14695981039346656037
        for b in "\n".join([*([] if x is None else [x.split("\n")[0][:100]]), f"{lang} {source}", x or ""]).encode():
            h = (h ^ b) * 1099511628211 % 2**64
        want[i] = f"{h:016x}"
    assert len(set(want.values())) == 9
    assert {r.doc_id: r.hash for r in catalog.QUERIES["record_hash"](spark, str(tmp_path)).collect()} == want


def test_partitions_change_nothing(spark):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        catalog.t._BUILT.clear()
        got.append([tuple(r) for r in catalog.QUERIES["recall_full"](spark, FOLDER).collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and got[0]


def test_entry():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
