"""The store as a line-by-line JSON-RPC service, a prompt hook, and a command line with a JSON envelope."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import fixedpoint as fx
from .functions import text as tx
from .functions.text import parse_json
from .operators import capture as cp
from .operators import provenance as pv
from .operators import recall as rc
from .sources import transcripts as tr
from .sources.store import Store, UsageError

HOOK_BUDGET = 600
TOOLS = {
    "recall": {"query": "string", "budget": "integer", "k": "integer", "scope": "string"},
    "remember": {"type": "string", "title": "string", "body": "string", "tags": "array", "harness": "string", "core": "string", "rationale": "string", "scope": "string"},
    "capture": {"path": "string", "format": "string", "harness": "string"},
    "list": {},
}
REQUIRED = {"recall": ["query"], "remember": ["type", "title"], "capture": ["path"], "list": []}


def remember(store: Store, now: int, **fields) -> str:
    if fields.get("type") == "session-summary":
        raise UsageError("session summaries come from capture")
    row = {"ord": 0, "mtype": fields.get("type"), "tags": fields.get("tags") or [], "links": fields.get("links") or []} | {k: fields.get(k) for k in ("title", "source", "supersedes", "harness", "core", "rationale", "scope", "body")}
    shape = "ord long, mtype string, tags array<string>, links array<string>, title string, source string, supersedes string, harness string, core string, rationale string, scope string, body string"
    return store.create(store.spark.createDataFrame([row], shape), now).first().id


def cards(hits) -> str:
    """Hits for people: a line for the title, and why."""
    rows = hits.withColumn("line", rc.why_line(F.col("why"), F.col("graph_via"), F.col("graph_micros"))).withColumn("by", tx.provenance_tag(F.col("harness"), F.col("core"))).orderBy("rank").collect()
    out = []
    for i, r in enumerate(rows):
        out += [f"{i + 1}. {r.title}  [{r.mtype}]{r.by}", *([f"   why it matters: {r.rationale}"] if r.rationale else []), f"   {r.line}", f"   {r.path}"]
    return "\n".join(out) or "no memories matched"


def _tool(store: Store, name: str, a: dict, now: int) -> str:
    for key in REQUIRED.get(name, ()):
        if not isinstance(a.get(key), str):
            raise UsageError(f"{name} requires {key!r}")
    if name == "recall":
        return cards(store.recall(a["query"], rc.Options(k=a["k"] if isinstance(a.get("k"), int) and a["k"] >= 1 else 10, budget=a.get("budget"), scope=a.get("scope"))))
    if name == "remember":
        return f"created {remember(store, now, **a)}"
    if name == "capture":
        form = {None: None, "auto": None, "claude": "claude-code", "text": "generic"}.get(a.get("format"), a.get("format"))
        if form is not None and form not in tr.HARNESS:
            raise UsageError(f"unknown format {form!r}")
        rows = store.capture(tr.read_transcripts(store.spark, a["path"]), now, format=form, harness=a.get("harness")).orderBy("id").collect()
        return "\n".join([f"captured {len(rows)} memories", *(f"  {r.id}  [{r.mtype}]  {r.title}" for r in rows)])
    if name == "list":
        return "\n".join(f"{r.id}  [{r.type}]  {r.title}" for r in store.list().collect()) or "no memories in the store"
    raise UsageError(f"unknown tool {name!r}")


def handle_message(store: Store, line: str, now: int) -> str | None:
    """The answer to one message; none to a blank line or a notification. A tool's failure is a result that says so."""
    if not line.strip():
        return None
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    try:
        msg = parse_json(line)
    except (ValueError, RecursionError) as e:
        return dump({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"parse error: {e}"}})
    if not isinstance(msg, dict) or "id" not in msg:
        return None
    method, params = msg.get("method"), msg.get("params") or {}
    if method == "initialize":
        result: dict = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "strandex", "version": "0.1.0"}}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} | ({"items": {"type": "string"}} if t == "array" else {}) for k, t in p.items()}, "required": REQUIRED[n]}} for n, p in TOOLS.items()]}
    elif method == "tools/call":
        try:
            text, failed = _tool(store, params.get("name", ""), params.get("arguments") or {}, now), False
        except Exception as e:  # reported in band, whatever it is
            text, failed = str(e), True
        result = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        return dump({"jsonrpc": "2.0", "id": msg["id"], "error": {"code": -32601, "message": "method not found"}})
    return dump({"jsonrpc": "2.0", "id": msg["id"], "result": result})


def serve(store: Store, now: int, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if (answer := handle_message(store, line, now)) is not None:
            out.write(answer + "\n")
            out.flush()


def hook_recall(store: Store, payload: str, budget: int = HOOK_BUDGET) -> str:
    """What a prompt hook injects: recalled titles within the budget, diverse, of the folder's scope; empty where nothing matches."""
    try:
        got = parse_json(payload.strip())
    except (ValueError, RecursionError):
        return ""
    prompt, cwd = (got.get(k) if isinstance(got, dict) and isinstance(got.get(k), str) else "" for k in ("prompt", "cwd"))
    if not prompt.strip():
        return ""
    name = cwd.rstrip("/").rsplit("/", 1)[-1]
    rows = store.recall(prompt, rc.Options(budget=budget, diverse=True, scope=f"project:{name}" if name else None)).withColumn("by", tx.provenance_tag(F.col("harness"), F.col("core"))).collect()
    if not rows:
        return ""
    text = "Relevant memories:\n" + "".join(f"- {r.title}{r.by}" + (f" (why: {r.rationale})" if r.rationale else "") + "\n" for r in rows)
    return json.dumps({"hookSpecificOutput": {"hookEventName": "UserPromptSubmit", "additionalContext": text}}, ensure_ascii=False, separators=(",", ":"))


def _payload(text: str) -> dict:
    try:
        got = parse_json(text.strip())
    except (ValueError, RecursionError):
        return {}
    return got if isinstance(got, dict) else {}


def _folder_scope(cwd) -> str | None:
    name = cwd.rstrip("/").rsplit("/", 1)[-1] if isinstance(cwd, str) else ""
    return f"project:{name}" if name else None


def hook_capture(store: Store, payload: str, now: int, distill: bool = False, pending: bool = False) -> str:
    """What the end of a session runs: captures the transcript that the payload names, of the folder's scope; a line that says what came of it."""
    got = _payload(payload)
    path = got.get("transcript_path")
    if not isinstance(path, str):
        return "no transcript in the payload; nothing captured"
    n = store.capture(tr.read_transcripts(store.spark, path), now, distill, pending, scope=_folder_scope(got.get("cwd"))).count()
    return f"captured {n} candidates to the review queue" if pending else f"captured {n} memories"


def hook_notify(store: Store, payload: str, home: str, now: int) -> str:
    """What the end of a turn runs, where no transcript is named: captures the newest log below a folder. Doing so again adds nothing."""
    newest = tr.newest_rollout(store.spark, home).first()
    if newest is None:
        return "no session log; nothing captured"
    n = store.capture(tr.read_transcripts(store.spark, newest.path), now, format="codex", scope=_folder_scope(_payload(payload).get("cwd"))).count()
    return f"captured {n} memories"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandex", exit_on_error=False)
    p.add_argument("--store", required=True)
    p.add_argument("--now", type=int, required=True, help="epoch seconds; nothing reads a clock")
    p.add_argument("--no-redact", action="store_true")
    sub = p.add_subparsers(dest="verb", required=True)
    r = sub.add_parser("recall")
    r.add_argument("query")
    r.add_argument("-k", type=int, default=10)
    for name in ("type", "tag", "scope"):
        r.add_argument(f"--{name}")
    r.add_argument("--budget", type=int)
    for name in ("diverse", "no-rerank", "decay", "touch"):
        r.add_argument(f"--{name}", action="store_true")
    r = sub.add_parser("remember")
    r.add_argument("title")
    r.add_argument("--type", required=True)
    for name in ("body", "supersedes", "harness", "core", "rationale", "scope"):
        r.add_argument(f"--{name}")
    r.add_argument("--tags", type=lambda s: [t.strip() for t in s.split(",") if t.strip()])
    r.add_argument("--link", dest="links", action="append")
    r = sub.add_parser("list")
    r.add_argument("--type")
    r.add_argument("--tag")
    r.add_argument("--rebuild-index", action="store_true")
    r = sub.add_parser("forget")
    r.add_argument("id")
    r.add_argument("--force", action="store_true")
    r = sub.add_parser("prune")
    r.add_argument("--force", action="store_true")
    r.add_argument("--below", type=int, default=fx.PRUNE_FLOOR)
    r = sub.add_parser("capture")
    r.add_argument("path", nargs="?")
    r.add_argument("--latest", choices=("codex",), help="the newest log below --home in place of a path")
    r.add_argument("--home", default="~/.codex/sessions")
    for name in ("pending", "distill"):
        r.add_argument(f"--{name}", action="store_true")
    for name in ("format", "harness", "core", "scope", "distill-cmd"):
        r.add_argument(f"--{name}")
    r = sub.add_parser("hook")
    r.add_argument("action", choices=("recall", "capture", "notify"))
    r.add_argument("payload", nargs="?", default="")
    r.add_argument("--home", default="~/.codex/sessions")
    r.add_argument("--budget", type=int, default=HOOK_BUDGET)
    for name in ("pending", "distill"):
        r.add_argument(f"--{name}", action="store_true")
    sub.add_parser("setup")
    sub.add_parser("mcp")
    r = sub.add_parser("review")
    r.add_argument("action", choices=("list", "approve", "reject"))
    r.add_argument("ids", nargs="*")
    r.add_argument("--all", action="store_true")
    r = sub.add_parser("provenance")
    r.add_argument("id", help="a record's id, or verify")
    return p


def _run(store: Store, a: argparse.Namespace):
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    if a.verb == "recall":
        hits = store.recall(a.query, rc.Options(k=a.k, mtype=a.type, tag=a.tag, scope=a.scope, budget=a.budget, diverse=a.diverse, rerank=not a.no_rerank, decay=a.decay, now=a.now), a.touch, a.now)
        return {"hits": [json.loads(r.json) for r in rc.to_json(hits).orderBy("rank").collect()]}
    if a.verb == "remember":
        for link in a.links or []:
            if store.spark.createDataFrame([(link,)], "x string").where(tx.is_record_id(F.col("x"))).isEmpty():
                raise UsageError(f"not a record's id: {link}")
        return {"id": remember(store, a.now, **{k: v for k, v in vars(a).items() if k not in ("store", "now", "no_redact", "verb")})}
    if a.verb == "list":
        if a.rebuild_index:
            store.rebuild_index()
        return {"memories": rows(store.list(a.type, a.tag))}
    if a.verb == "forget":
        if not a.force:
            raise UsageError("forget needs --force")
        store.delete([a.id])
        return {"id": a.id}
    if a.verb == "prune":
        return {"floor": a.below, "dry_run": not a.force, "stale": rows(store.prune(a.now, a.below, a.force))}
    if a.verb == "setup":
        store.setup()
        return {"store": store.root}
    if a.verb == "mcp":
        serve(store, a.now)
        return {}
    if a.verb == "hook":
        home = os.path.expanduser(a.home)
        said = hook_recall(store, a.payload, a.budget) if a.action == "recall" else hook_capture(store, a.payload, a.now, a.distill, a.pending) if a.action == "capture" else hook_notify(store, a.payload, home, a.now)
        return {"output": said}
    if a.verb == "capture":
        if (a.path is None) == (a.latest is None):
            raise UsageError("a path, or --latest")
        path, form = a.path, a.format
        if a.latest:
            newest = tr.newest_rollout(store.spark, os.path.expanduser(a.home)).first()
            if newest is None:
                raise UsageError("no session log found")
            path, form = newest.path, form or "codex"
        how = {"distiller": cp.process_distiller(a.distill_cmd)} if a.distill_cmd else {}
        got = store.capture(tr.read_transcripts(store.spark, path), a.now, a.distill or bool(a.distill_cmd), a.pending, format=form, harness=a.harness, core=a.core, scope=a.scope, **how)
        return {"created": rows(got.select("id", F.col("mtype").alias("type"), "title"))}
    if a.verb == "review":
        if a.action == "list":
            return {"pending": rows(store.pending().select("id", F.col("mtype").alias("type"), "title"))}
        if bool(a.ids) == a.all:
            raise UsageError("name ids, or --all")
        done = store.approve(a.now, None if a.all else a.ids) if a.action == "approve" else store.reject(None if a.all else a.ids)
        return {"ids": [r.id for r in done.collect()]}
    return store.verify() if a.id == "verify" else {"entries": [json.loads(r.x) for r in pv.lineage(store.log(), a.id).select(pv.line().alias("x")).collect()]}


def main(spark: SparkSession, argv: list[str]) -> tuple[int, str]:
    """(exit code, envelope): 0, 1 for a failure, 2 for a wrong use."""
    verb = next((x for x in argv if x in ("recall", "remember", "list", "forget", "prune", "capture", "review", "provenance", "hook", "setup", "mcp")), "")
    try:
        a = parser().parse_args(argv)
        store = Store(spark, a.store, not a.no_redact)
        data = _run(store, a)
        return 0, json.dumps({"ok": True, "command": verb, "data": data, "warnings": store.warnings}, ensure_ascii=False)
    except (argparse.ArgumentError, UsageError, SystemExit, ValueError) as e:
        return 2, json.dumps({"ok": False, "command": verb, "error": {"kind": "usage", "message": str(e)}, "warnings": []})
    except Exception as e:
        return 1, json.dumps({"ok": False, "command": verb, "error": {"kind": "io", "message": str(e)}, "warnings": []})

