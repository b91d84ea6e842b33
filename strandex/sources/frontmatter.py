"""Records as Markdown files with a header: a tolerant reader, and the canonical writer as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..functions import text as tx
from ..functions.fixedpoint import FULL
from ..functions.text import TYPES
from . import records as rc

# The keys of the header in their order.
KEYS = ("id", "type", "created", "title", "tags", "links", "source", "supersedes", "harness", "core", "rationale", "scope", "confidence", "last_used")
LISTS, OPTIONAL = ("tags", "links"), ("source", "supersedes", "harness", "core", "rationale", "scope")
SCHEMA = (
    "id string, mtype string, created long, title string, tags array<string>, links array<string>, source string, supersedes string, harness string, core string, "
    "rationale string, scope string, confidence long, last_used long, unknown_keys array<struct<k:string,scalar:string,list:array<string>>>, body string"
)
FILE = SCHEMA + ", path string, warnings array<string>, error string"
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[^",]+|[",]', re.DOTALL)
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})Z")


class Malformed(ValueError):
    """A file that cannot be read; says where."""


def epoch(text: str) -> int:
    """Epoch seconds of YYYY-MM-DDTHH:MM:SSZ; ValueError for anything else."""
    from datetime import UTC, datetime

    m = _DATE.fullmatch(text)
    if not m:
        raise ValueError(f"not a UTC time: {text!r}")
    return int(datetime(*map(int, m.groups()), tzinfo=UTC).timestamp())


def scalar(text: str, line: int) -> str:
    if not text.startswith('"'):
        return text
    m = re.match(r'"((?:[^"\\]|\\["\\])*)("?)', text, re.DOTALL)
    if not m[2]:
        raise Malformed(f"line {line}: " + ("invalid escape in quoted scalar" if "\\" in text[m.end(1) : m.end(1) + 1] else "unterminated quoted scalar"))
    if text[m.end() :].strip():
        raise Malformed(f"line {line}: unexpected text after closing quote")
    return re.sub(r"\\(.)", r"\1", m[1])


def value(text: str, line: int) -> str | list[str]:
    if not text.startswith("["):
        return scalar(text, line)
    if not text.endswith("]") or len(text) < 2:
        raise Malformed(f"line {line}: unclosed list value")
    items, item = [], ""
    for token in _TOKEN.findall(text[1:-1]):
        if token == '"':
            raise Malformed(f"line {line}: unterminated quote in list")
        if token == ",":
            items.append(item.strip())
            item = ""
        else:
            item += token
    items.append(item.strip())
    if items == [""]:
        return []
    if "" in items:
        raise Malformed(f"line {line}: empty element in list")
    return [scalar(x, line) for x in items]


def parse(text: str) -> tuple[list[tuple[str, str | list[str]]], str]:
    """(key, value) pairs in the order of the file, and the body as it stands behind the closing line."""
    rows = text.split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    at = next((i for i, r in enumerate(rows) if r.strip()), len(rows))
    if at >= len(rows) or rows[at].rstrip() != "---":
        raise Malformed(f"line {at + 1}: expected the opening --- of a header")
    pairs: dict[str, str | list[str]] = {}
    for i in range(at + 1, len(rows)):
        row = rows[i].rstrip()
        if row == "---":
            return list(pairs.items()), text.split("\n", i + 1)[i + 1] if text.count("\n") > i else ""
        if not row:
            continue
        key, colon, rest = row.partition(":")
        key = key.strip()
        if not colon:
            raise Malformed(f"line {i + 1}: expected key: value")
        if not re.fullmatch(r"[a-z0-9_]+", key):
            raise Malformed(f"line {i + 1}: invalid key {key!r}")
        if key in pairs:
            raise Malformed(f"line {i + 1}: duplicate key {key!r}")
        pairs[key] = value(rest.strip(), i + 1)
    raise Malformed(f"line {max(len(rows), 1)}: unclosed header")


def record(text: str) -> tuple[dict, list[str]]:
    """A typed record and warnings; Malformed where a required key is missing or wrong."""
    pairs, body = parse(text)
    got, warnings = dict(pairs), []

    def required(key: str) -> str:
        v = got.get(key)
        if not isinstance(v, str) or not v.strip():
            raise Malformed(f"field {key!r} " + ("is missing" if v is None else "must be a scalar" if isinstance(v, list) else "must not be empty"))
        return v

    out: dict = {k: required(k) for k in ("id", "type", "created", "title")}
    out["mtype"] = out.pop("type")
    if out["mtype"] not in TYPES:
        raise Malformed(f"unknown type {out['mtype']!r}")
    try:
        out["created"] = epoch(out["created"])
    except ValueError as e:
        raise Malformed(f"field 'created': {e}") from None
    for key in LISTS:
        v = got.get(key, [])
        if isinstance(v, str):
            warnings.append(f"field {key!r} should be a list; taken as its only element")
            v = [v]
        out[key] = v
    for key in (*OPTIONAL, "confidence", "last_used"):
        v = got.get(key)
        if isinstance(v, list):
            warnings.append(f"field {key!r} should be a scalar; its first element is taken")
            v = v[0] if v else None
        out[key] = v
    if out["supersedes"] is not None and out["mtype"] != "decision":
        warnings.append(f"'supersedes' only means something on decisions (this is a {out['mtype']})")
    if out["source"] is not None and out["mtype"] != "session-summary":
        warnings.append(f"'source' only means something on session summaries (this is a {out['mtype']})")
    for key, read in (("confidence", lambda s: min(max(int(s), 0), FULL) if re.fullmatch(r"[+-]?[0-9]+", s.strip()) else int("x")), ("last_used", epoch)):
        if out[key] is not None:
            try:
                out[key] = read(out[key])
            except ValueError:
                warnings.append(f"field {key!r} can't be read; ignored")
                out[key] = None
    out["unknown_keys"] = [{"k": k, "scalar": v if isinstance(v, str) else None, "list": v if isinstance(v, list) else None} for k, v in pairs if k not in KEYS]
    return out | {"body": body}, warnings


def conflicted(text: str) -> bool:
    return bool(re.search(r"^<{7}", text, re.M) and re.search(r"^>{7}", text, re.M))


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["mtype" if k == "type" else k for k in KEYS] + ["unknown_keys", "body", "path", "warnings", "error"]
    for f in frames:
        out = []
        for path, content in zip(f["path"], f["content"], strict=True):
            row: dict = dict.fromkeys(names) | {"path": path, "warnings": []}
            try:
                text = bytes(content).decode("utf-8")
                if conflicted(text):
                    raise Malformed("merge conflict markers")
                fields, warnings = record(text)
                stem = path.rsplit("/", 1)[-1].removesuffix(".md")
                if fields["id"] != stem:
                    warnings.append(f"id {fields['id']!r} differs from the file's name {stem!r}; the header wins")
                row |= fields | {"warnings": warnings}
            except (Malformed, UnicodeDecodeError) as e:
                row["error"] = str(e)
            out.append(row)
        yield pd.DataFrame(out, columns=names)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each *.md file of a folder; `error` is set on those that can't be read, which have no fields."""
    return rc.files(spark, folder).mapInPandas(_rows, FILE)


def stream_files(spark: SparkSession, folder: str, settle: float = 2) -> DataFrame:
    """The same as a stream: files that come or change from now on, those that are there first."""
    return rc.file_stream(spark, folder, settle).mapInPandas(_rows, FILE)


def good(files: DataFrame) -> DataFrame:
    return files.where("error is null").orderBy("id")


def quarantine(files: DataFrame) -> DataFrame:
    """(origin, message): errors and warnings."""
    messages = F.concat(F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>")), "warnings")
    return files.select(F.col("path").alias("origin"), F.explode(messages).alias("message"))


def _pair(key, v: Column) -> Column:
    return F.when(v.isNotNull(), F.concat(F.lit(key) if isinstance(key, str) else key, F.lit(": "), tx.quoted(v)))


def _listed(key, v: Column) -> Column:
    return F.when(F.size(v) > 0, F.concat(F.lit(key) if isinstance(key, str) else key, F.lit(": ["), F.array_join(F.transform(v, tx.quoted), ", "), F.lit("]")))


def canonical_body(body: Column) -> Column:
    """Line feeds, no white space at the ends of lines, one line feed at the end; nothing for a blank body."""
    s = F.regexp_replace(F.coalesce(body, F.lit("")), r"\r\n?", "\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?m)[^\S\n]+$", ""), r"\n+\z", "")
    return F.when(s == "", "").otherwise(F.concat(s, F.lit("\n")))


def canonical() -> Column:
    """The file's text of a row of SCHEMA: keys in order, empty ones left out, unknown ones last."""
    c = F.col
    head = [_pair("id", c("id")), _pair("type", c("mtype")), _pair("created", fx.format_rfc3339("created")), _pair("title", c("title")), *(_listed(k, c(k)) for k in LISTS), *(_pair(k, c(k)) for k in OPTIONAL), _pair("confidence", c("confidence").cast("string")), _pair("last_used", fx.format_rfc3339("last_used"))]
    other = F.transform("unknown_keys", lambda x: F.coalesce(_pair(x.k, x.scalar), _listed(x.k, x["list"])))
    rows = F.filter(F.concat(F.array(*head), F.coalesce(other, F.array().cast("array<string>"))), lambda x: x.isNotNull())
    return F.concat(F.lit("---\n"), F.array_join(rows, "\n"), F.lit("\n---\n"), canonical_body(c("body")))
