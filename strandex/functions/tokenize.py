"""Words, sub-words and stopwords."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The stopwords.
STOPWORDS = (
    "a", "about", "all", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "did", "do", "does", "for",
    "from", "had", "has", "have", "how", "i", "if", "in", "into", "is", "it", "its", "just", "no", "not", "of", "on", "or",
    "our", "so", "than", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "we", "were", "what",
    "when", "with",
)

SPLIT = r"[^\p{IsAlphabetic}\p{N}_]+"
#: Inside a word: underscores, small before capital, the last capital before a small letter, digits beside anything else.
INSIDE = r"_+|(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})|(?<=[0-9])(?=[^0-9_])|(?<=[^0-9_])(?=[0-9])"
#: Cheap sign that a word may have parts.
PARTED = r"[_0-9]|\p{IsLowercase}\p{IsUppercase}|\p{IsUppercase}\p{IsUppercase}\p{IsLowercase}"


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, as written."""
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def parts(word: Column) -> Column:
    return F.filter(F.split(word, INSIDE), lambda p: p != "")


def lowered(s: Column) -> Column:
    """In lower case, character by character: a capital sigma at a word's end is no final one."""
    return F.lower(F.replace(s, F.lit("Σ"), F.lit("σ")))


def word_terms(word: Column) -> Column:
    """A word's terms: itself in lower case and, where it has several parts, each that differs from it."""
    whole = lowered(word)
    more = F.filter(F.transform(parts(word), lowered), lambda p: p != whole)
    return F.when(word.rlike(PARTED), F.concat(F.array(whole), F.when(F.size(parts(word)) > 1, more).otherwise(F.array().cast("array<string>")))).otherwise(F.array(whole))


def tokenize_all(text: Column) -> Column:
    """All terms in order, with repeats."""
    return F.flatten(F.transform(words(text), word_terms))


def is_stopword(term: Column) -> Column:
    return term.isin(*STOPWORDS)


def tokenize(text: Column) -> Column:
    """All terms but stopwords."""
    return F.filter(tokenize_all(text), lambda t: ~is_stopword(t))


def _ranges(codes: list[int]) -> str:
    """Code points, in order, as what stands between the brackets of a class."""
    out, first = [], None
    for i, c in enumerate(codes):
        if first is None:
            first = c
        if i + 1 == len(codes) or codes[i + 1] != c + 1:
            out.append(f"\\U{first:08x}-\\U{c:08x}")
            first = None
    return "".join(out)


_CHARACTERS: dict = {}


def characters(spark: SparkSession) -> tuple:
    """What Rule takes, as the JVM has it: the classes of word characters, small and large letters, and small forms that Python's differ from."""
    key = spark.sparkContext.applicationId
    if key not in _CHARACTERS:
        # beyond, there are no letters or numbers: planes without characters, tags, private use
        c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        rows = spark.range(0, 0x40000, 1, 8).where("id < 55296 or id > 57343").select("id", c.alias("c"))
        rows = rows.select("id", (~F.rlike("c", F.lit(SPLIT))).alias("word"), F.rlike("c", F.lit(r"\p{IsLowercase}")).alias("low"), F.rlike("c", F.lit(r"\p{IsUppercase}")).alias("up"), lowered(F.col("c")).alias("small"), "c")
        found = rows.where("word or low or up or small != c").orderBy("id").toArrow().to_pylist()
        known = {r["c"]: r["small"] for r in found}
        small = {c: known.get(c, c) for i in range(0x40000) if not 0xD800 <= i <= 0xDFFF and (c := chr(i)).lower() != known.get(c, c)}
        _CHARACTERS[key] = (*(_ranges([r["id"] for r in found if r[k]]) for k in ("word", "low", "up")), small)
    return _CHARACTERS[key]


class Rule:
    """words() and word_terms() outside the JVM, by its own characters(), so that the two never differ."""

    def __init__(self, word: str, low: str, up: str, small: dict):
        # the JVM looks behind by one UTF-16 unit, where no letter beyond 0xffff is seen
        near_low, near_up = (f"(?<=[{x}])(?<=[\\0-\\uffff])" for x in (low, up))
        self.word = np.zeros(0x110000, bool)
        for a, z in re.findall(r"\\U(\w{8})-\\U(\w{8})", word):
            self.word[int(a, 16) : int(z, 16) + 1] = True
        self.inside = re.compile(f"_+|{near_low}(?=[{up}])|{near_up}(?=[{up}][{low}])|(?<=[0-9])(?=[^0-9_])|(?<=[^0-9_])(?=[0-9])").split
        self.parted = re.compile(f"[_0-9]|[{low}][{up}]|[{up}][{up}][{low}]").search
        self.small = small

    def cut(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The words of some texts, in order, and the place of each one's text."""
        joined = "\n".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        inside = self.word[c]
        edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.searchsorted(np.cumsum(size) - size, start, "right") - 1
        raw = np.frombuffer(joined.encode(), np.uint8)
        if len(raw) > len(c):
            width = 1 + (c >= 0x80).view(np.int8) + (c >= 0x800).view(np.int8) + (c >= 0x10000).view(np.int8)
            at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            inside, start, end = np.repeat(inside, width), at[start], at[end]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[inside])), text

    def lowered(self, s: str) -> str:
        return s.lower() if s.isascii() else "".join(self.small.get(c) or c.lower() for c in s)

    def terms(self, word: str) -> list[str]:
        if word.isascii() and word.isalpha() and word[1:].islower():
            return [word.lower()]
        whole = self.lowered(word)
        if not self.parted(word):
            return [whole]
        parts = [p for p in self.inside(word) if p]
        return [whole, *(x for x in map(self.lowered, parts) if x != whole)] if len(parts) > 1 else [whole]
