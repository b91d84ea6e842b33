"""String functions of the record model, as Column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The record types and the cues of the heuristic distiller.
TYPES = ("fact", "decision", "rule", "session-summary")
DECISION_CUES = ("chose ", "we chose", "decided ", "decide to", "going with", "we'll use", "we will use", "settled on", "opted for", "switch to", "switched to", "instead of")
RULE_CUES = ("always ", "never ", " must ", "you must", "we must", "make sure", "be sure to", "ensure ", "don't ", "do not ", "avoid ")
TITLE = 100
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def slugify(title: Column) -> Column:
    """Letters and digits of ASCII in lower case, anything else one hyphen, at most 40 characters."""
    s = F.regexp_replace(F.regexp_replace(ascii_lower(title), "[^a-z0-9]+", "-"), "^-", "")
    s = F.regexp_replace(F.left(s, F.lit(40)), "-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def is_record_id(s: Column) -> Column:
    """A type, then a hyphen, and digits after the last hyphen."""
    return s.rlike(r"^(fact|decision|rule|session-summary)-(.*-)?[0-9]{1,19}$")


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def cap(s: Column, most: int = TITLE) -> Column:
    return F.left(s, F.lit(most))


def one_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed and capped; empty where there is none."""
    first = F.regexp_extract(text, r"(\S[^\n]*)", 1)
    return cap(F.regexp_replace(first, r"\s+$", ""))


def markers(text: Column) -> Column:
    """array<struct<mtype, body>> of the lines `MEMORY [type]: body`, in order; no type means a fact."""
    shape = r"(?i)^\s*memory\s*(fact|decision|rule)?\s*:\s*(\S.*?)\s*$"
    hits = F.filter(lines(text), lambda x: x.rlike(shape))
    kind = lambda x: ascii_lower(F.regexp_extract(x, shape, 1))
    return F.transform(hits, lambda x: F.struct(F.when(kind(x) == "", "fact").otherwise(kind(x)).alias("mtype"), F.regexp_extract(x, shape, 2).alias("body")))


def strip_lead(s: Column) -> Column:
    """Without list, quote and heading signs, and one number of a numbered list."""
    s = F.regexp_replace(F.regexp_replace(s, r"^[#>\-*+]+", ""), r"^\s+", "")
    return F.regexp_replace(s, r"^[0-9]+[.)]\s*", "")


def normalize(s: Column) -> Column:
    return ascii_lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def classify(line: Column) -> Column:
    """'decision', 'rule' or null: 20 to 200 characters, four words or more, with a cue; decisions first."""
    low = F.concat(F.lit(" "), ascii_lower(line), F.lit(" "))
    cue = lambda cues: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(low, c))
    fits = F.length(line).between(20, 200) & (F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")) >= 4) & ~low.rlike(r"^\s*memory")
    return F.when(fits & cue(DECISION_CUES), "decision").when(fits & cue(RULE_CUES), "rule")


def is_conflicted(text: Column) -> Column:
    return text.rlike(r"(?m)^<{7}") & text.rlike(r"(?m)^>{7}")


def is_real_user_text(s: Column) -> Column:
    return s.rlike(r"\S") & ~s.rlike(r"^\s*<(user_instructions|environment_context)>")


def scope_from_cwd(path: Column) -> Column:
    """project:<last folder>; null where there is none."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(name != "", F.concat(F.lit("project:"), name))


def needs_quoting(s: Column) -> Column:
    return (s == "") | s.rlike(r"^[ \t]|[ \t]$") | s.rlike(r"[\"\[\],#\p{Cc}]")


def quoted(s: Column) -> Column:
    inner = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(needs_quoting(s), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(s)


def card_cost(title: Column, rationale: Column, id_: Column) -> Column:
    """Tokens that a card takes, about: characters of the title, bytes of the rest."""
    size = F.length(title) + F.coalesce(F.octet_length(rationale), F.lit(0)) + F.octet_length(id_)
    return (F.call_function("div", size, F.lit(4)) + 8).cast("long")


def provenance_tag(harness: Column, core: Column) -> Column:
    both = F.concat_ws("/", harness, core)
    return F.when(both == "", "").otherwise(F.concat(F.lit(" ["), both, F.lit("]")))


def parse_json(text: str):
    """Strict JSON, nested 128 deep at most; ValueError otherwise."""

    def refuse(name):
        raise ValueError(name)

    value = json.loads(text, parse_constant=refuse)
    stack = [(value, 1)]
    while stack:
        v, deep = stack.pop()
        if deep > 128:
            raise ValueError("nested too deep")
        stack.extend((x, deep + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()) if isinstance(x, (dict, list)))
    return value


def prose(transcript: str) -> list[str]:
    """Natural language of a transcript: of JSON lines every string under text, content or message; other lines as they are."""
    out: list[str] = []

    def collect(v):
        if isinstance(v, dict):
            for k, x in v.items():
                if k in ("text", "content", "message") and isinstance(x, str):
                    out.append(x)
                collect(x)
        elif isinstance(v, list):
            for x in v:
                collect(x)

    for line in transcript.split("\n"):
        if line := line.strip():
            try:
                collect(parse_json(line))
            except (ValueError, RecursionError):
                out.append(line)
    return out


prose_blocks = F.pandas_udf(lambda s: pd.Series([prose(t) if t is not None else [] for t in s], dtype=object), T.ArrayType(T.StringType()))
