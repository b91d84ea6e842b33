"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strandex.functions import fixedpoint as fx
from strandex.functions import redact as rd
from strandex.functions import text as tx
from strandex.functions import tokenize as tk


def one(spark, column, **values):
    """The value of a column over one row of the given values."""
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("num", "den", "want"), [(2, 1, 693147), (10, 1, 2302585), (3, 2, 405465), (10**6, 1, 13815511), (7, 3, 847298), (1, 2, -693147), (1, 1, 0)])
def test_ln(spark, num, den, want):
    assert one(spark, fx.ln_micros(num, den)) == want


@pytest.mark.parametrize(("a", "b", "c", "want"), [(1, 1, 2, 1), (1, 1, 3, 0), (2, 1, 3, 1), (693147, 4400000, 2900000, 1051671)])
def test_mul_div_round(spark, a, b, c, want):
    assert one(spark, fx.mul_div_round(a, b, c)) == want


@pytest.mark.parametrize(("s", "want"), [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv(spark, s, want):
    assert one(spark, fx.fnv1a64_hex(F.col("s")), s=s) == want
    assert one(spark, fx.fnv1a64_hex_native(F.col("s")), s=s) == want


def test_decay(spark):
    h = fx.HALF_LIFE
    for elapsed, base, want in ((0, fx.FULL, fx.FULL), (h, fx.FULL, 500000), (2 * h, fx.FULL, 250000), (3 * h, fx.FULL, 125000), (h // 2, fx.FULL, 750000), (1000 * h, fx.FULL, 0), (h, 500000, 250000), (-5, fx.FULL, fx.FULL)):
        assert one(spark, fx.decayed(base, 0, elapsed, h)) == want
    assert one(spark, fx.decayed(700, 0, 10**9, 0)) == 700


def test_times(spark):
    assert one(spark, fx.parse_rfc3339(F.lit("2026-07-13T12:00:00Z"))) == 1783944000
    assert one(spark, fx.format_rfc3339(1783944000)) == "2026-07-13T12:00:00Z"
    for bad in ("2026-02-30T00:00:00Z", "2026-07-13 12:00:00Z", "2026-07-13T24:00:00Z", "2026-07-13T12:00:00", "2026-7-13T12:00:00Z", "", "2026-07-13T12:00:00+00:00", "2026-13-01T00:00:00Z"):
        assert one(spark, fx.parse_rfc3339(F.lit(bad))) is None, bad


def test_rendering(spark):
    assert one(spark, fx.render_micros(240000)) == "0.24"
    assert one(spark, fx.render_micros(12_999_999)) == "12.99"
    assert one(spark, fx.render_score(1_234_500)) == "1.235"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("parseHttpRequest", ["parsehttprequest", "parse", "http", "request"]),
        ("parse_rfc3339_utc", ["parse_rfc3339_utc", "parse", "rfc", "3339", "utc"]),
        ("HTMLParser v2", ["htmlparser", "html", "parser", "v2", "v", "2"]),
        ("utf8", ["utf8", "utf", "8"]),
        ("Größe MATTERS", ["größe", "matters"]),
        ("ΟΔΟΣ ὁδός οδοςΣας", ["οδοσ", "ὁδός", "οδοςσας", "οδος", "σας"]),
        ("## Fix `verify.sh` in CI (see #42)", ["fix", "verify", "sh", "ci", "see", "42"]),
        ("_x_", ["_x_"]),
        ("", []),
        ("the of and", []),
    ],
)
def test_tokenize(spark, text, want):
    assert one(spark, tk.tokenize(F.lit(text))) == want


def test_slug(spark):
    for title, want in (("Hello, World!", "hello-world"), ("ünïcödé is stripped", "n-c-d-is-stripped"), ("!!!", "untitled"), ("a" * 60, "a" * 40), ("x" * 39 + " y", "x" * 39)):
        assert one(spark, tx.slugify(F.lit(title))) == want


KEYS = [
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "[REDACTED:private-key]"),
    ("authorization: Basic dXNlcjpwYXNz", "authorization: Basic [REDACTED:bearer]"),
    ("Bearer abcdefghijkl", "Bearer [REDACTED:bearer]"),
    ("AKIA" + "A1" * 8, "[REDACTED:aws-key]"),
    ("AIza" + "x" * 35, "[REDACTED:google-key]"),
    ("ghp_" + "a" * 36, "[REDACTED:github-token]"),
    ("xoxb-1234567890", "[REDACTED:slack-token]"),
    ("sk-" + "a" * 20, "[REDACTED:api-key]"),
    ('my_token = "secret value"', "my_token = [REDACTED:secret-assign]"),
    ("password=hunter22&x=1", "password=[REDACTED:secret-assign]&x=1"),
    ("secret=äöü", "secret=[REDACTED:secret-assign]"),
]


def test_redact(spark):
    for text, want in KEYS:
        got, kinds = rd.redact(text)
        assert got == want
        assert len(kinds) == 1
        assert rd.redact(got) == (got, [])
        assert one(spark, rd.redacted(F.col("s"))["text"], s=text) == want
    for text in ("Authorization: abcdefghijkl", "Bearer of bad news", "accesstoken=abcdefgh", "token=abc", "XAKIA" + "A" * 16, 'secret = "unclosed', "sk-short", "fact-foo-1"):
        assert rd.redact(text) == (text, [])


def test_markers(spark):
    got = one(spark, tx.markers(F.lit("MEMORY decision: use tabs\nmemory: plain : fact \nMemory Rule : x\nmemory note: no\nMEMORY fact:\nmemoryfact: y")))
    assert [(m.mtype, m.body) for m in got] == [("decision", "use tabs"), ("fact", "plain : fact"), ("rule", "x"), ("fact", "y")]


def test_classify(spark):
    for line, want in (("We chose parquet for the tables", "decision"), ("Always run the tests before commit", "rule"), ("too short", None), ("memory we chose parquet for tables", None), ("This is an ordinary sentence here", None), ("You must never choose; we decided to wait", "decision")):
        assert one(spark, tx.classify(F.lit(line))) == want


def test_lines(spark):
    assert one(spark, tx.strip_lead(F.lit("## 12. do it"))) == "do it"
    assert one(spark, tx.one_line(F.lit("\n \n  first \nsecond"))) == "first"
    assert one(spark, tx.normalize(F.lit("  A\t b \n C"))) == "a b c"
    assert one(spark, tx.scope_from_cwd(F.lit("/home/me/proj/"))) == "project:proj"
    assert one(spark, tx.is_conflicted(F.lit("a\n<<<<<<< x\nb\n>>>>>>> y")))
    assert one(spark, tx.is_record_id(F.lit("fact-a-12")))
    assert not one(spark, tx.is_record_id(F.lit("fact-a-12ab34cd")))


def test_prose():
    assert tx.prose('{"message":{"content":[{"text":"a"},{"content":"b"}]}}\nplain\n"scalar"') == ["a", "b", "plain"]
    assert tx.prose("[" * 200 + "]" * 200)[0].startswith("[")
