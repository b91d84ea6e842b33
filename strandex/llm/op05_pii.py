"""Personal data by bootstrapped contextual extraction.

Patterns for e-mail addresses, IP addresses, card and telephone numbers give the seed entities of each kind. The words beside
an entity, with its shape, make lexical patterns. Spark scores the graph of patterns and instances in rounds: a pattern is as
good, for a kind, as the share of its instances that are known to be of that kind; an instance is as good as its best pattern;
instances over the threshold are known in the next round. Identifier-like strings that no seed rule takes, found in patterns of
high confidence, are added as spans of that kind.

Words in patterns are whole, never cut; what is longer than WORD characters is no word of a language and makes no pattern with
that place. A shape is that of the whole span; one of more than WORD characters is named by its hash.

Defined cases: a null text counts as empty (no spans, the hash of an empty string); repeated rows get a row each (identical ids
and texts the same result); a null doc_id is returned as it is; tied kinds go to the one named first; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
ROW = ["r1", "r2"]
#: Bytes of text that are Python objects at a time; characters of a word at most.
SLICE, WORD = 4 << 20, 256
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin within a run of digits, so no run is tried from its middle: time is linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What an unseen identifier may look like: six characters or more, four digits at least or an @. Only a run's start is tried.
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D(\[{\"'<])(?=[A-Za-z+._/-]*+[0-9@])[A-Za-z0-9+][A-Za-z0-9@._+/-]{4,}[A-Za-z0-9]")
_SIGNS = re.compile(r"[^\w]+")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_WORD = re.compile(rf"[{_SPACE}]*+([^{_SPACE}]*)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str):
    """Leftmost, non-overlapping: the run of local characters before an @, as far left as the match before allows."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) by kind, then start."""
    out = [(0, *s) for s in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _before(text: str, end: int) -> tuple[str, int]:
    """The word that ends last before a place, and where it starts; an empty one if there is none or it is longer than WORD."""
    size = 2 * WORD
    while True:  # the white space behind the word may be long
        piece = text[max(0, end - size) : end].rstrip(_SPACE)
        if piece or size >= end:
            break
        size *= 4
    end = max(0, end - size) + len(piece)
    piece = text[max(0, end - WORD - 1) : end]
    start = 1 + max(map(piece.rfind, _SPACE))
    return ("", end) if len(piece) - start > WORD else (piece[start:], end - len(piece) + start)


def _after(text: str, start: int) -> str:
    """The word that begins first from a place on; an empty one if there is none or it is longer than WORD."""
    begin = _WORD.match(text, start).start(1) if text[start : start + 1] in _SPACE else start
    piece = text[begin : begin + WORD + 1]
    word = _WORD.match(piece).group(1)
    return "" if len(word) > WORD else word


def _lexical(word: str) -> str:
    return re.sub(r"[0-9]", "9", _SIGNS.sub("", word)).lower()


def shape(span: str) -> str:
    out = re.sub(r"A+", "A", re.sub(r"a+", "a", re.sub(r"9+", "9", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", span))))))
    return out if len(out) <= WORD else hashlib.blake2b(out.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns: the last two words and the last word before, with the shape of the span; words in lower case, digits as 9."""
    last, at = _before(text, start)
    one, after = _lexical(last), _lexical(_after(text, end))
    if not one:
        return []
    two = _lexical(_before(text, at)[0])
    out = [f"L2|{two} {one}"] if two else []
    out.append(f"L1|{one}|{shape(text[start:end])}")
    if after:
        out.append(f"LR|{one}|{after}")
    return out


def identifiers(text: str, taken: list[tuple]) -> list[tuple[int, int]]:
    """Identifier-like spans that overlap none already taken."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    found = [(m.start(), m.end()) for m in _TOKEN.finditer(text) if "@" in m.group() or sum("0" <= c <= "9" for c in m.group()) >= 4]
    if not found or not taken:
        return found
    out, i, spans = [], 0, sorted((s, e) for _, s, e in taken)
    for s, e in found:
        while i < len(spans) and spans[i][1] <= s:
            i += 1
        if not any(a < e and s < b for a, b in spans[max(0, i - 1) : i + 3]):
            out.append((s, e))
    return out


FOUND = "r1 long, r2 long, doc_id long, n array<long>, base string, base_sha256 string, mentions array<struct<kind:int,start:int,stop:int,inst:string,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: base spans, and every mention (base or identifier-like) with its patterns."""
    struct = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("inst", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for b in common.sliced(batches, SLICE):
            counts, base, sha, mentions = [], [], [], []
            for t in common.texts(b):
                spans = base_spans(t)
                text = joined(spans)
                counts.append([sum(k == i for k, _, _ in spans) for i in range(4)])
                base.append(text)
                sha.append(hashlib.sha256(text.encode()).hexdigest())
                rows = [(k, s, e) for k, s, e in spans] + [(-1, s, e) for s, e in identifiers(t, spans)]
                mentions.append([{"kind": k, "start": s, "stop": e, "inst": hashlib.blake2b(t[s:e].encode("utf-8", "surrogatepass"), digest_size=12).hexdigest(), "patterns": contexts(t, s, e)} for k, s, e in rows])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.string()), pa.array(sha, pa.string()), pa.array(mentions, struct)], names=[*ROW, "doc_id", "n", "base", "base_sha256", "mentions"])

    text = F.col("text").cast("string")
    return docs.select(*common.row_key(), F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(run, FOUND)


def bootstrap(mentions: DataFrame, rounds: int, least: float, support: int) -> DataFrame:
    """mentions (kind, inst, patterns) -> (inst, kind) of the identifier-like instances that patterns of high confidence take.

    The graph is aggregated to distinct (pattern, instance) edges before anything is joined.
    """
    edges = common.saved(mentions.select("kind", "inst", F.explode("patterns").alias("pattern")).groupBy("pattern", "inst").agg(F.max("kind").alias("seed"), F.count("*").alias("n")), "pii-edges", 1)
    known = edges.where("seed >= 0").groupBy("inst").agg(F.min("seed").alias("kind"))
    seeds, found = known, None
    for k in range(rounds):
        # a pattern's confidence for a kind: its instances known to be of that kind, over all its instances and one more
        sized = edges.join(known, "inst", "left").groupBy("pattern").agg(F.count("*").alias("all"), *(F.sum((F.col("kind") == i).cast("long")).alias(f"k{i}") for i in range(len(KINDS))))
        best = F.array_max(F.array(*(F.struct(F.coalesce(f"k{i}", F.lit(0)).alias("hits"), F.lit(-i).alias("minus")) for i in range(len(KINDS)))))
        scored = sized.withColumn("best", best).where(F.col("best.hits") >= support).select("pattern", (F.col("best.hits") / (F.col("all") + 1)).alias("score"), (-F.col("best.minus")).alias("kind")).where(F.col("score") >= least)
        got = edges.where("seed < 0").select("pattern", "inst").join(scored, "pattern").groupBy("inst").agg(F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("b"))
        found = common.saved(got.select("inst", (-F.col("b.minus")).alias("kind")), f"pii-found{k}", 1)
        known = seeds.unionByName(found)
    return found


def personal_data(docs: DataFrame, rounds: int = 3, least: float = 0.5, support: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    least: the confidence from which a pattern is used; support: how many known instances it must have.
    """
    scanned = common.saved(scan(docs), "pii", common.SCAN)
    mentions = scanned.select(*ROW, F.explode("mentions").alias("m")).select(*ROW, "m.*")
    found = bootstrap(mentions, rounds, least, support)
    names = reduce(lambda a, i: F.when(F.col("found") == i, KINDS[i]).otherwise(a), range(len(KINDS)), F.lit(None))
    added = mentions.where("kind < 0").select(*ROW, "inst", "start", "stop").distinct().join(found.withColumnRenamed("kind", "found"), "inst")
    added = added.groupBy(*ROW).agg(F.collect_list(F.struct(F.col("found").cast("int").alias("k"), F.col("start"), F.col("stop"), names.alias("name"))).alias("more"))
    base = F.transform(F.filter("mentions", lambda m: m.kind >= 0), lambda m: F.struct(m.kind.alias("k"), m.start.alias("start"), m.stop.alias("stop"), F.element_at(F.array(*map(F.lit, KINDS)), m.kind + 1).alias("name")))
    every = F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<k:int,start:int,stop:int,name:string>>"))))
    spans = F.array_join(F.transform(every, lambda m: F.concat_ws(":", m["name"], m.start, m.stop)), ",")
    return scanned.join(added, ROW, "left").select("doc_id", *(F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)), "base_sha256", spans.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_added"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.table(spark, sf_dir, "documents"))
