"""Credential redaction: at each position the first matching rule wins, and scanning goes on behind the match."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE, _CRED, _KEY = r"(?<![A-Za-z0-9])", r"[A-Za-z0-9._+/=-]", r"[A-Za-z0-9_-]"
# The kinds and shapes, in order of priority. A group named `keep` stays in front of the mark.
RULES = (
    ("private-key", r"-----BEGIN (?=[^\n]*PRIVATE KEY-----)(?s:.*?)-----END(?s:.*?)-----"),
    ("bearer", rf"{_EDGE}(?P<k1>(?i:authorization:)[ \t]*+[A-Za-z]++[ \t]*+){_CRED}{{8,}}+"),
    ("bearer", rf"{_EDGE}(?P<k2>Bearer[ \t]++){_CRED}{{12,}}+"),
    ("aws-key", rf"{_EDGE}AKIA[A-Z0-9]{{16}}"),
    ("google-key", rf"{_EDGE}AIza{_KEY}{{35}}"),
    ("github-token", rf"{_EDGE}gh[pousr]_[A-Za-z0-9]{{36,}}+"),
    ("slack-token", rf"{_EDGE}xox[baprs]-[A-Za-z0-9-]{{10,}}+"),
    ("api-key", rf"{_EDGE}(?:sk-ant-{_KEY}{{20,}}+|sk-[A-Za-z0-9]{{20,}}+)"),
    ("secret-assign", rf"{_EDGE}(?P<k3>(?i:password|passwd|secret|token|api_key|apikey)[ \t]*+=[ \t]*+)(?!\[REDACTED:)(?:\"[^\"]++\"|'[^']++'|[^ \t\n\r\x0c&;,\"']{{6,}}+)"),
)
_ALL = re.compile("|".join(f"(?P<r{i}>{p})" for i, (_, p) in enumerate(RULES)), re.ASCII)
_HINT = re.compile(r"-----BEGIN |authorization:|Bearer|AKIA|AIza|gh[pousr]_|xox|sk-|passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)


def redact(text: str) -> tuple[str, list[str]]:
    """The text with every credential replaced, and the kinds replaced, in order. Lengths count bytes, as UTF-8."""
    if not _HINT.search(text):
        return text, []
    kinds: list[str] = []

    def mark(m: re.Match) -> str:
        kind = RULES[int(next(k for k, v in m.groupdict().items() if k[0] == "r" and v is not None)[1:])][0]
        kinds.append(kind)
        return f"{m['k1'] or m['k2'] or m['k3'] or ''}[REDACTED:{kind}]"

    return _ALL.sub(mark, text.encode("utf-8", "surrogatepass").decode("latin-1")).encode("latin-1").decode("utf-8", "surrogatepass"), kinds


def _redact(s: pd.Series) -> pd.DataFrame:
    done = [redact(t) if t is not None else (None, []) for t in s]
    return pd.DataFrame({"text": [t for t, _ in done], "kinds": [k for _, k in done]})


#: Column -> struct<text, kinds>; texts without any sign of a credential pass through.
redacted = F.pandas_udf(_redact, T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))


def redact_scalar(c: Column) -> Column:
    """Redacted, control characters as spaces, trimmed: what may stand in a header line."""
    return sanitize_scalar(redacted(c)["text"])


def sanitize_scalar(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\p{Cc}", " "))
