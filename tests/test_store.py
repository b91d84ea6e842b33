"""Record files, the store and its log, capture, review, streaming and the service, end to end."""

import json
import time

import pytest
from pyspark.sql import functions as F

from strandex import service
from strandex.operators import capture as cp
from strandex.operators import graph, lifecycle, provenance, rank
from strandex.operators import index as index_module
from strandex.operators import recall as rc
from strandex.operators.index import Index, refresh
from strandex.sources import frontmatter as fm
from strandex.sources import records
from strandex.sources import transcripts as tr
from strandex.sources.store import Store, UsageError
from strandex.streaming.ingest import first_seen, stream_capture, stream_logs

NOW = 1_783_944_000
FILE = """---
id: decision-no-database-1
type: decision
created: 2026-07-13T12:00:00Z
title: "Files, not a database"
tags: [storage, "a, b"]
links: [fact-layout-1]
rationale: one folder is easy to copy
confidence: 900000
priority: high
---
We keep files.

They are plain.
"""


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "decision-no-database-1.md").write_text(FILE)
    (tmp_path / "fact-messy-1.md").write_bytes(b"\n---\r\ntype: fact\r\ntitle: x \r\nid: fact-messy-1\r\n\r\ncreated: 2026-07-13T12:00:00Z\r\ntags: one\r\nsource: s\r\n---\r\nbody  \r\n\r\n")
    for name, text in (("dup", "---\nid: a\nid: b\n---\n"), ("open", "---\nid: a\n"), ("key", "---\nId: a\n---\n"), ("list", '---\ntags: [a, "b]\n---\n'), ("type", "---\nid: a\ntype: x\ncreated: 2026-07-13T12:00:00Z\ntitle: t\n---\n"), ("merge", "<<<<<<< a\n>>>>>>> b\n")):
        (tmp_path / f"{name}.md").write_text(text)
    files = fm.read_files(spark, str(tmp_path))
    rows = {r.id: r for r in fm.good(files).withColumn("text", fm.canonical()).collect()}
    assert rows["decision-no-database-1"].text == FILE
    assert rows["decision-no-database-1"].tags == ["storage", "a, b"]
    assert rows["fact-messy-1"].text == "---\nid: fact-messy-1\ntype: fact\ncreated: 2026-07-13T12:00:00Z\ntitle: x\ntags: [one]\nsource: s\n---\nbody\n"
    assert len(rows["fact-messy-1"].warnings) == 2
    assert files.where("error is not null").count() == 6
    assert fm.quarantine(files).count() == 8


def corpus(spark):
    rows = [
        ("fact-a-1", "fact", "sync branch", ["git"], [], None, "the branch to sync is main"),
        ("fact-b-1", "fact", "storage layout", [], ["fact-a-1"], "project:x", "files in one folder"),
        ("rule-c-1", "rule", "synchronise often", ["git"], [], "project:y", "push and pull"),
        ("fact-d-1", "fact", "sync branch", ["git"], ["nowhere-1"], None, "the branch to sync is main"),
    ]
    df = spark.createDataFrame(rows, "id string, mtype string, title string, tags array<string>, links array<string>, scope string, body string")
    return df.withColumn("created", F.lit(NOW)).withColumn("path", F.concat("id", F.lit(".md")))


def ask(spark, index, text, **o):
    return rc.recall(index, spark.createDataFrame([(0, text)], "qid long, text string"), rc.Options(**o)).collect()


def test_recall(spark):
    index = Index.build(corpus(spark))
    hits = ask(spark, index, "sync branch")
    assert [h.id for h in hits] == ["fact-a-1", "fact-d-1", "fact-b-1"]
    assert hits[2].graph_via == "fact-a-1" and hits[2].graph_micros > 20_000
    near = ask(spark, index, "synchronised")
    assert near[0].id == "rule-c-1" and near[0].why.rerank.embed_sim_micros > 350_000 and not near[0].why.matched_terms
    assert [h.id for h in ask(spark, index, "sync branch", scope="project:y")] == ["fact-a-1", "fact-d-1"]
    assert [h.id for h in ask(spark, index, "synchronised push", mtype="rule", k=1)] == ["rule-c-1"]
    assert [h.id for h in ask(spark, index, "sync branch", diverse=True, rerank=False)][:2] == ["fact-a-1", "fact-b-1"]
    assert [h.id for h in ask(spark, index, "sync branch", budget=1)] == ["fact-a-1"]
    assert ask(spark, index, "the of") == [] and ask(spark, index, "") == []
    assert rc.contributions_add_up(rc.recall(index, spark.createDataFrame([(0, "sync branch folder")], "qid long, text string"))).isEmpty()
    old = ask(spark, index, "sync branch", decay=True, now=NOW + 900 * 86_400)
    assert old[0].score_micros < hits[0].score_micros
    with pytest.raises(ValueError):
        rc.Options(k=0)


def test_refresh_equals_build(spark):
    before = corpus(spark)
    after = before.where("id != 'fact-b-1'").withColumn("body", F.when(F.col("id") == "rule-c-1", "entirely new words").otherwise(F.col("body")))
    a, b = refresh(Index.build(before), after), Index.build(after)
    for x, y in ((a.postings, b.postings), (a.docs, b.docs), (a.df, b.df), (a.stats, b.stats)):
        assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def test_pagerank(spark):
    docs = spark.createDataFrame([("a", ["b"]), ("b", ["c"]), ("c", []), ("d", [])], "id string, links array<string>")
    seeds = spark.createDataFrame([(0, "a", 100)], "qid long, id string, weight long")
    mass = {r.id: r.mass for r in graph.personalized_pagerank(graph.edges(docs), seeds).collect()}
    assert mass["a"] > mass["b"] > mass["c"] > 0 and "d" not in mass
    alone = {r.id: r.mass for r in graph.personalized_pagerank(graph.edges(docs), seeds.withColumn("id", F.lit("d"))).collect()}
    assert alone == {"d": 500_000}


def test_mmr():
    same, other = frozenset("ab"), frozenset("xy")
    assert rank.mmr_order([100, 99, 50], [same, same, other]) == [0, 2, 1]
    assert rank.mmr_order([5, 5], [same, same]) == [0, 1]


LOG = "\n".join(
    [
        '{"type":"session_meta","payload":{"id":"cx-1","cwd":"/w"}}',
        '{"type":"turn_context","payload":{"model":"m-5"}}',
        '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"<user_instructions>x"}]}}',
        '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"port the service"}]}}',
        '{"type":"event_msg","payload":{"type":"user_message","message":"port the service"}}',
        '{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"MEMORY rule: keep password=hunter22 out\\nWe chose parquet for the tables"}]}}',
    ]
)
LOGS = [
    ("a", LOG),
    ("b", '{"sessionId":"s1","type":"user","message":{"role":"user","content":"first task"}}\n{"type":"assistant","message":{"role":"assistant","model":"m","content":[{"type":"text","text":"MEMORY decision: go"},{"type":"tool","text":"no"}]}}'),
    ("c", "Notes of the day\n\nmemory: water is wet\nAlways label the boxes you pack"),
    ("d", '{"session_id":"s2","role":"user","model":"m","content":"bare"}'),
    ("e", ""),
]


def test_sessions(spark):
    rows = {r.path: r for r in tr.sessions(spark.createDataFrame(LOGS, "path string, text string")).collect()}
    got = {p: (r.format, r.core, r.session_id, r.task, r.message_count, [tuple(m) for m in r.markers]) for p, r in rows.items()}
    assert got["a"] == ("codex", "m-5", "cx-1", "port the service", 3, [("rule", "keep password=hunter22 out")])
    assert got["b"] == ("claude-code", "m", "s1", "first task", 2, [("decision", "go")])
    assert got["c"] == ("generic", None, None, "Notes of the day", 0, [("fact", "water is wet")])
    assert got["d"] == ("codex", "m", "s2", "bare", 1, [])
    assert got["e"] == ("generic", None, None, None, 0, [])
    back = tr.session_from_json(tr.session_json(tr.sessions(spark.createDataFrame(LOGS, "path string, text string"))))
    assert {r.path: r.message_count for r in back.collect()} == {p: r.message_count for p, r in rows.items()}


def test_lowest_free(spark):
    new = spark.createDataFrame([("fact", "x", 1), ("fact", "x", 2), ("rule", "x", 3)], "mtype string, slug string, ord long")
    taken = spark.createDataFrame([("fact-x-1",), ("fact-x-3",), ("fact-x-y-2",)], "id string")
    assert sorted(r.id for r in cp.lowest_free(new, taken).collect()) == ["fact-x-2", "fact-x-4", "rule-x-1"]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first = service.remember(store, NOW, type="fact", title="Where builds go", body="token = abcdefgh", tags=["build"])
    assert first == "fact-where-builds-go-1" and service.remember(store, NOW, type="fact", title="Where builds go") == "fact-where-builds-go-2"
    assert store.read(first).first().body == "token = [REDACTED:secret-assign]"
    texts = spark.createDataFrame(LOGS, "path string, text string")
    added = store.capture(texts, NOW, distill=True)
    assert added.count() == 10
    assert store.capture(texts, NOW, distill=True).count() == 0
    assert store.memories().where(F.contains("body", F.lit("hunter22"))).isEmpty()
    assert store.verify() == {"intact": True, "entries": 12, "memories": 12}
    store.mark_used(store.read(first), NOW + 5)
    assert store.read(first).first().last_used == NOW + 5 and store.verify()["entries"] == 13
    log = store.log()
    assert provenance.verify(log.where("seq != 2"), store.memories().limit(0).select("id", F.lit("").alias("content_hash")))["reason"] == "sequence gap"
    assert provenance.verify(log.withColumn("source", F.when(F.col("seq") == 4, "x").otherwise(F.col("source"))), store.memories().limit(0).select("id", F.lit("").alias("content_hash")))["broken"] == 4
    assert "changed" in provenance.verify(log, store.memories().select("id", F.lit("0").alias("content_hash")))["reason"]
    assert store.recall("builds").first().id == "fact-where-builds-go-2"  # the shorter one
    assert store.prune(NOW + 100 * 86_400).count() == 0 and store.prune(NOW + 400 * 86_400, force=True).count() == 12
    assert store.memories().isEmpty() and store.table("archive").count() == 12
    with pytest.raises(UsageError):
        store.delete(["nothing"])
    with pytest.raises(UsageError):
        service.remember(store, NOW, type="fact", title=" ")


def test_review_and_mirror(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.capture(spark.createDataFrame(LOGS[1:2], "path string, text string"), NOW, pending=True)
    ids = [r.id for r in store.pending().collect()]
    assert len(ids) == 2 and store.memories().isEmpty()
    assert [r.id for r in store.approve(NOW + 9, ids[:1]).collect()] == ids[:1] and store.memories().first().created == NOW + 9
    assert [r.id for r in store.reject().collect()] == ids[1:] and store.pending().isEmpty()
    key = "00" * 16
    store.encrypt_mirror(key)
    assert store.decrypt_mirror(key).exceptAll(store.export()).isEmpty()


def test_merge(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, content string")
    good, bad = lifecycle.merged(t([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")]), t([("a", "2"), ("b", "1"), ("c", "2")]), t([("a", "1"), ("b", "3"), ("c", "4"), ("e", "5")]))
    assert {tuple(r) for r in good.collect()} == {("a", "2"), ("b", "3"), ("e", "5")}
    assert [r.id for r in bad.collect()] == ["c"]


def test_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "b.jsonl").write_text(LOGS[1][1])
    store = Store(spark, str(tmp_path / "s"))
    for k in range(2):  # from scratch: the same files again add nothing
        stream_capture(store, str(inbox), str(tmp_path / f"check{k}"), NOW).awaitTermination(120)
    assert store.memories().count() == 2
    assert Index.load(spark, f"{store.root}/index").docs.count() == 2


def test_record_files(spark, tmp_path):
    """Names that begin with _ are records, those with a dot aren't; partitions by bytes; a stream of what comes and changes."""
    folder, out, check = tmp_path / "memories", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    note = lambda name, body="x": (folder / f"{name}.md").write_text(f"---\nid: {name}\ntype: fact\ncreated: 2026-01-01T00:00:00Z\ntitle: T\n---\n{body}\n")
    for name in ("_x", "y", ".hidden"):
        note(name)
    (folder / "sub.md").mkdir()
    (folder / "other.txt").write_text("no")
    got = fm.good(fm.read_files(spark, str(folder))).collect()
    assert [r.id for r in got] == ["_x", "y"] and all(r.warnings == [] for r in got)
    assert fm.read_files(spark, f"file:{folder}").count() == 2
    empty = tmp_path / "empty"
    empty.mkdir()
    assert fm.read_files(spark, str(empty)).count() == 0
    sizes = [("a", 10 << 20, 0), ("b", 10 << 20, 0), ("c", 90 << 20, 0), ("d", 1, 0)]
    assert [p.paths for p in records.dealt(sizes)] == [["a", "b"], ["c"], ["d"]] and records.dealt([]) == []

    def run():
        time.sleep(0.2)
        fm.stream_files(spark, str(folder), 0.1).select("id", "body").writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination(120)
        return sorted((r.id, r.body) for r in spark.read.schema("id string, body string").parquet(out).collect())

    assert run() == [("_x", "x\n"), ("y", "x\n")] == run()
    note("y", "changed")
    note("z")
    assert run() == [("_x", "x\n"), ("y", "changed\n"), ("y", "x\n"), ("z", "x\n")]


def same(a, b):
    return all(x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty() for x, y in ((a.postings, b.postings), (a.docs, b.docs), (a.df, b.df), (a.stats, b.stats)))


def test_kept_index(spark, tmp_path, monkeypatch):
    """Versions add what changed, are put together after a while, and equal a fresh build; what can't be used is built anew, with a warning."""
    monkeypatch.setattr(index_module, "MOST_VERSIONS", 2)
    root, rows = str(tmp_path / "index"), corpus(spark)
    index = Index.build(rows, root)
    assert refresh(Index.load(spark, root), rows).version == 1  # nothing changed
    for k in range(3):
        rows = spark.createDataFrame([r.asDict() | ({"body": f"entirely new words {k}"} if r.id == "rule-c-1" else {}) for r in rows.where("id != 'fact-b-1'").collect()], rows.schema)
        index = refresh(Index.load(spark, root), rows)
        assert index.version == k + 2 and same(index, Index.build(rows)) and same(Index.load(spark, root), index)
    assert (index.since, Index.load(spark, str(tmp_path / "none"))) == (3, None)
    store = Store(spark, str(tmp_path / "s"))
    service.remember(store, NOW, type="fact", title="Where builds go")
    assert store.recall("builds").count() == 1 and store.warnings == []
    spark.createDataFrame([(1, 1)], index_module.SIGN).write.mode("overwrite").parquet(f"{store.root}/index/v1/sign")
    again = Store(spark, store.root)
    assert again.recall("builds").count() == 1 and "format 1" in again.warnings[0]


def test_log_after_a_failure(spark, tmp_path, monkeypatch):
    """A task that dies between the log and the records: whoever tries again under the same name, at any time, adds the records and no second entry."""
    store, texts = Store(spark, str(tmp_path / "s")), spark.createDataFrame(LOGS[1:2], "path string, text string")
    append = Store._append
    monkeypatch.setattr(Store, "_append", lambda self, name, rows: append(self, name, rows) if name != "memories" else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.capture(texts, NOW, request="batch 1")
    monkeypatch.undo()
    assert store.log().count() == 2 and store.memories().isEmpty()
    for later in (60, 120):  # and once more after it was done
        assert store.capture(texts, NOW + later, request="batch 1").count() == 2
        assert store.verify() == {"intact": True, "entries": 2, "memories": 2}
    assert {r.created for r in store.memories().collect()} == {NOW}
    assert store.capture(texts, NOW + 180, request="batch 2").count() == 0 and store.log().count() == 2


def test_every_write_has_an_entry(spark, tmp_path):
    """Deleted and created again by the same clock; changed to what it was; each follows the last segment's tail."""
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        assert service.remember(store, NOW, type="fact", title="Where builds go") == "fact-where-builds-go-1"
        store.delete(["fact-where-builds-go-1"])
    service.remember(store, NOW, type="fact", title="Where builds go")
    store.update(store.memories(), NOW)
    assert [(r.seq, r.event) for r in store.log().orderBy("seq").collect()] == [(1, "created"), (2, "created"), (3, "created"), (4, "updated")]
    assert store.verify() == {"intact": True, "entries": 4, "memories": 1}
    for _ in range(2):  # an update, tried again
        store.update(store.memories(), NOW + 9, request="touch up")
    new = spark.createDataFrame([("fact", "Again", 1)], "mtype string, title string, ord long")
    assert store.verify()["entries"] == 5 and new.count() == 1


def test_stream_of_logs(spark, tmp_path):
    """Logs that go on over batches, by the tails in the stream's state; a batch that is run again changes nothing."""
    schema = "log long, ord long, memory_id string, event string, content_hash string, source string, harness string, core string, created long"
    rows = [(i % 3, i, f"m{i % 5}", "captured", f"h{i}", None, 'q"uote', "ü", NOW + i) for i in range(40)]
    inbox, root, check = str(tmp_path / "in"), str(tmp_path / "logs"), tmp_path / "check"
    run = lambda: stream_logs(spark.readStream.schema(schema).parquet(inbox), "log", root, str(check)).awaitTermination(120)
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        run()
    got = lambda: sorted(tuple(r)[:-1] for r in spark.read.parquet(root).select("log", *provenance.NAMES, "batch").collect())
    want = sorted(tuple(r) for r in provenance.append_logs(spark.createDataFrame(rows, schema), "log").collect())
    assert [tuple(r) for r in got()] == want
    (check / "commits" / "1").unlink()  # the second batch was not committed
    (check / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert got() == want and provenance.chain_breaks(spark.read.parquet(root).withColumn("pos", F.col("seq")), "log").isEmpty()
    assert first_seen(spark.readStream.schema(schema).parquet(inbox).withColumn("at", F.timestamp_seconds("created")), "memory_id", "at", "1 hour").isStreaming


def test_hooks_and_latest(spark, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    (home / "rollout-1.jsonl").write_text(LOG)
    (tmp_path / "b.jsonl").write_text(LOGS[1][1])
    root = str(tmp_path / "s")
    run = lambda *a: json.loads(service.main(spark, ["--store", root, "--now", str(NOW), *a])[1])
    assert run("setup")["ok"]
    assert run("hook", "capture", json.dumps({"transcript_path": str(tmp_path / "b.jsonl"), "cwd": "/x/work"}))["data"]["output"] == "captured 2 memories"
    assert run("hook", "capture", "{}")["data"]["output"].endswith("nothing captured")
    assert run("hook", "notify", "--home", str(home))["data"]["output"] == "captured 2 memories"
    assert run("capture", "--latest", "codex", "--home", str(home))["data"]["created"] == []
    assert not run("capture")["ok"] and {r.scope for r in Store(spark, root).memories().collect()} == {"project:work", None}


def test_process_distiller(spark):
    texts = spark.createDataFrame([("a", "we talked"), ("b", "We chose parquet for the tables"), ("c", "We chose parquet for the tables")], "path string, text string")
    run = lambda command, timeout=20.0: {(r.path, r.mtype, r.line) for r in cp.process_distiller(command, timeout)(texts).collect()}
    chose = {(p, "decision", "We chose parquet for the tables") for p in "bc"}
    assert run("grep -q talked && echo 'MEMORY fact: they talked'") == {("a", "fact", "they talked"), *chose}
    assert run("exit 1") == chose == run("sleep 30", 0.5)


def test_one_log_in_ranges(spark):
    """Breaks of a log cut in many ranges, against a plain walk."""
    events = spark.range(200).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("memory_id"), F.lit("e").alias("event"), F.lit("h").alias("content_hash"), *(F.lit(None).cast("string").alias(c) for c in ("source", "harness", "core")), F.lit(NOW).cast("long").alias("created"))
    log = provenance.append(None, events)
    bad = log.where("seq not in (50, 51, 120)").withColumn("prev_hash", F.when(F.col("seq") == 77, "x").otherwise(F.col("prev_hash"))).withColumn("entry_hash", F.when(F.col("seq") == 150, "y").otherwise(F.col("entry_hash")))
    got = {(r.seq, r.reason) for r in provenance.chain_breaks(bad.repartition(9).withColumn("pos", F.col("seq"))).collect()}
    assert got == {(52, "sequence gap"), (121, "sequence gap"), (77, "prev_hash does not match"), (150, "entry_hash does not match"), (151, "prev_hash does not match")}
    assert provenance.chain_breaks(log.withColumn("pos", F.col("seq"))).isEmpty()


def test_service(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    send = lambda **m: json.loads(service.handle_message(store, json.dumps({"jsonrpc": "2.0", "id": 1} | m), NOW))
    assert send(method="initialize")["result"]["serverInfo"]["name"] == "strandex"
    assert len(send(method="tools/list")["result"]["tools"]) == 4
    call = lambda name, **a: send(method="tools/call", params={"name": name, "arguments": a})["result"]
    assert "created rule-label-the-boxes-1" in call("remember", type="rule", title="label the boxes")["content"][0]["text"]
    assert "label the boxes" in call("recall", query="boxes")["content"][0]["text"]
    assert call("nothing")["isError"] and call("recall")["isError"]
    assert send(method="x")["error"]["code"] == -32601
    assert json.loads(service.handle_message(store, "{", NOW))["error"]["code"] == -32700
    assert service.handle_message(store, '{"method":"x"}', NOW) is None
    assert "label the boxes" in service.hook_recall(store, '{"prompt":"boxes","cwd":"/a/b"}') and service.hook_recall(store, "{}") == ""
    run = lambda *a: service.main(spark, ["--store", str(tmp_path / "s"), "--now", str(NOW), *a])
    code, out = run("list", "--type", "rule")
    assert code == 0 and json.loads(out)["data"]["memories"][0]["id"] == "rule-label-the-boxes-1"
    assert run("recall", "boxes", "-k", "0")[0] == 2 and run("forget", "x")[0] == 2
    assert json.loads(run("provenance", "verify")[1])["data"]["intact"]
