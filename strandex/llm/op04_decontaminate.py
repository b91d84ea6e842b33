"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared in a normal form: lower case, each run of white space one space. An item of m characters
within `edits` = floor(rate * m) edits of a region shares at least m - q + 1 - q * edits of its q-grams with it, all on diagonals
(position in the text less position in the item) that differ by no more than `edits`. So shared q-grams are counted in bands of
2 * (edits + 1) diagonals that overlap by half, each of the item's q-grams once; bands that reach the bound, neighbours together,
are verified by banded alignment.

So that the bound is positive for every item, q is Q or, where that is less, m div (edits + 1): 5 to 7 for items of 10 to 15, 20 to
23 and 30 to 31 characters, all of an item of less than Q. Each q has an index of its own, which texts are held against only where
there are such items. Q-grams that an item holds more than REPEATS times are left out of its index, with the bound lowered by
them, as long as it stays positive; items that consist of such q-grams keep them. What a text has in common with the items is
counted in steps of bounded size, however repetitive both are.

The regions of an item in a text do not overlap: the one with the fewest edits counts first, then the one that begins first. Of
an item that repeats itself, so that a text could hold it in overlapping places, the places named are those that are verified
with the fewest edits; at least one is named wherever there is any.

The items are taken in blocks of bounded size (BLOCK characters), each against all documents, so that what goes to the
executors is bounded however many items there are.

Defined cases: null or empty texts match nothing; items with fewer than LEAST characters in normal form, which nearly every text
would hold, match nothing; repeated documents or items each give their own rows; a null doc_id or item_id is returned as it is; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

Q, LEAST, RATE, BLOCK = 8, 4, 0.1, 4_000_000
#: No character has this code.
END = 31
#: Repeats of a q-gram in an item that are indexed; pairs of places counted at a time; bands verified at once; bytes of text at a time.
REPEATS, STEP, TOGETHER, SLICE = 4, 1 << 21, 4, 4 << 20
#: Bits of the hash that most texts' q-grams fail, and what it multiplies by.
BITS, LEFT, RIGHT = 22, np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its lower case, where that is one character, and a number below 31 (0: white space)."""
    if not _TABLES:
        lower = np.arange(0x110000, dtype=np.uint32)
        code = np.full(0x110000, 30, np.uint8)
        for c in range(0x30000):
            s = chr(c)
            if len(s.lower()) == 1:
                lower[c] = ord(s.lower())
            if s.isspace():
                code[c] = 0
            elif s.isdigit():
                code[c] = 28
            elif unicodedata.category(s)[0] == "L":
                code[c] = 1 + (int(lower[c]) - 97 if 97 <= lower[c] < 123 else int(lower[c]) * 7919 % 27)
            else:
                code[c] = 29
        _TABLES.extend([lower, code])
    return _TABLES[0], _TABLES[1]


def normal(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters in normal form, their codes, and each one's place in the text."""
    lower, code = _tables()
    try:
        a = np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = code[a]
    full = c != 0
    kept = full.copy()
    kept[1:] |= full[:-1]
    at = np.flatnonzero(kept)
    if len(at) < len(a):
        a, c = a[at], c[at]
    return np.where(c == 0, 32, lower[a]).astype(np.uint32), c, at


def fours(codes: np.ndarray) -> np.ndarray:
    """Four codes of 5 bits each in one number, for every start; two of these that lie four apart are eight codes."""
    two = codes[:-1].astype(np.uint16) << 5 | codes[1:]
    return two[:-2].astype(np.uint32) << 10 | two[2:]


def hashed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * LEFT ^ second * RIGHT) >> np.uint32(32 - BITS)


def halves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first four of eight codes in one number, and the other four, for every start of four codes; END stands beyond the last."""
    if len(codes) < LEAST:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    f = fours(np.append(codes, np.full(Q - LEAST, END, np.uint8)))
    return f[:-4], f[4:]


def qgrams(first: np.ndarray, second: np.ndarray, q: int) -> np.ndarray:
    """q codes of eight in one number; those of different q differ."""
    return np.uint64(q << 40) | first.astype(np.uint64) << 20 | second >> np.uint32(5 * (Q - q))


def banded(text: np.ndarray, item: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the item that starts in the text near low..high, within `edits`; else None.

    Only cells on diagonals low - edits .. high + edits are filled in; starts and ends in the text are free.
    """
    left, width = low - edits, high - low + 2 * edits + 1
    far = edits + 1
    pad = np.full(len(item) + width + 1, 0xFFFFFFFF, np.uint32)
    a, b = max(0, left), min(len(text), left + len(pad))
    if a >= b:
        return None
    pad[a - left : b - left] = text[a:b]
    place = np.arange(width)
    inside = (place + left >= 0) & (place + left <= len(text))
    row, begin = np.where(inside, 0, far), place + left
    for i, c in enumerate(item):  # cell j of row i + 1: item[: i + 1] against text that ends before left + j + i + 1
        cost = row + (pad[i : i + width] != c)
        drop, dropped = np.append(row[1:], far) + 1, np.append(begin[1:], 0)
        from_drop = drop < cost
        new, start = np.where(from_drop, drop, cost), np.where(from_drop, dropped, begin)
        # a text character left out: the smallest new[k] + (j - k) over k <= j
        key = new - place
        best = np.minimum.accumulate(key)
        source = np.maximum.accumulate(np.where(key == best, place, 0))
        source = np.where(key[source] == best, source, place)
        row, begin = best + place, start[source]
        ends = place + left + i + 1
        row = np.where((ends >= 0) & (ends <= len(text)), row, far)
        if row.min() > edits:
            return None
    j = int(np.argmin(row))
    return (int(row[j]), int(begin[j]), int(j + left + len(item))) if row[j] <= edits else None


class Items:
    """A block of benchmark items with the index of their q-grams."""

    def __init__(self, rows: list[tuple]):
        keep = [(i, n) for i, t in rows if len((n := normal(t or ""))[0]) >= LEAST]
        self.ids = [i for i, _ in keep]
        self.chars = [n[0] for _, n in keep]
        self.words = ["".join(map(chr, x)) for x in self.chars]
        self.size = np.array([len(x) for x in self.chars], np.int64)
        self.edits = (RATE * self.size).astype(np.int64)
        self.q = np.minimum(Q, self.size // (self.edits + 1))
        self.need = self.size - self.q + 1 - self.q * self.edits
        self.repetitive = np.zeros(len(keep), bool)
        code, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (_, n) in enumerate(keep):
            q = int(self.q[i])
            g = qgrams(*halves(n[1]), q)[: len(n[1]) - q + 1]
            _, which, times = np.unique(g, return_inverse=True, return_counts=True)
            rare = times[which] <= REPEATS
            if self.need[i] > (~rare).sum():
                self.need[i] -= (~rare).sum()
                at = np.flatnonzero(rare)
            else:
                self.repetitive[i], at = True, np.arange(len(g))
            code.append(g[at]), item.append(np.full(len(at), i)), place.append(at)
        code, item, place = map(np.concatenate, (code, item, place))
        order = np.argsort(code, kind="stable")
        self.code, self.head = np.unique(code[order], return_index=True)
        self.head = np.append(self.head, len(code))
        self.item, self.place = item[order], place[order]
        #: Of every q in use, which hashes its q-grams have.
        self.seen: dict[int, np.ndarray] = {}
        for q in map(int, np.unique(self.q)):
            own = self.code[self.code >> np.uint64(40) == q]
            self.seen[q] = np.zeros(1 << BITS, bool)
            self.seen[q][hashed((own >> np.uint64(20)).astype(np.uint32) & np.uint32((1 << 20) - 1), (own & np.uint64((1 << 20) - 1)).astype(np.uint32))] = True

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the text and number of the code, for every q-gram of the text that an item has."""
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        first, second = halves(codes)
        for q, seen in self.seen.items():
            at = np.flatnonzero(seen[hashed(first, second >> np.uint32(5 * (Q - q)))])
            g = qgrams(first[at], second[at], q)
            k = np.minimum(np.searchsorted(self.code, g), len(self.code) - 1)
            ok = self.code[k] == g
            places.append(at[ok]), numbers.append(k[ok])
        return np.concatenate(places), np.concatenate(numbers)

    def _entries(self, at: np.ndarray, k: np.ndarray):
        """(item, half band, place in the item, place in the text) of every shared q-gram, a step at a time."""
        n = self.head[k + 1] - self.head[k]
        for i, j in _steps(n, STEP):
            m, first = n[i:j], self.head[k[i:j]]
            entry = np.repeat(first - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            item, place, text = self.item[entry], self.place[entry], np.repeat(at[i:j], m)
            yield item, (text - place + self.size[item]) // (self.edits[item] + 1), place, text

    def bands(self, at: np.ndarray, k: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first and last half band, shared q-grams) of the neighbouring bands that reach the bound."""
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for item, half, _, _ in self._entries(at, k):
            key, n = _counted(item << 40 | half)
            if len(keys):
                keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            else:
                keys, counts = key, n
        beside = np.concatenate([np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0), [0]]) if len(keys) else counts
        hit = np.flatnonzero(counts + beside >= self.need[keys >> 40])
        if not len(hit):
            return []
        # each of the item's places counts once in a band, and each of the text's; items made of repeats are verified as they are
        wanted, total, at_band = keys[hit], (counts + beside)[hit], [[] for _ in hit]
        sure = self.repetitive[wanted >> 40]
        for item, half, place, text in self._entries(at, k) if not sure.all() else ():
            item, half, place, text = (x[~self.repetitive[item]] for x in (item, half, place, text))
            key = item << 40 | half
            for less in (0, 1):
                to = np.minimum(np.searchsorted(wanted, key - less), len(wanted) - 1)
                ok = np.flatnonzero(wanted[to] == key - less)
                pair = to[ok] << 32
                both = (np.unique(pair | place[ok]), np.unique(pair | text[ok]))
                for h in np.unique(to[ok]):
                    at_band[h].append([x[np.searchsorted(x, h << 32) : np.searchsorted(x, h + 1 << 32)] for x in both])
        out: list[tuple[int, int, int, int]] = []
        for h, parts in enumerate(at_band):
            n = int(total[h]) if sure[h] else min(len(np.unique(np.concatenate([p[side] for p in parts]))) for side in (0, 1))
            i, half = int(wanted[h] >> 40), int(wanted[h] & (1 << 40) - 1)
            if n >= self.need[i]:
                # neighbours go together as far as two places of the item that don't overlap stay apart
                near = min(TOGETHER, (self.size[i] - 2 * self.edits[i]) // (self.edits[i] + 1) - 1)
                if out and out[-1][0] == i and half == out[-1][2] and half - out[-1][1] < near:
                    out[-1] = (i, out[-1][1], half + 1, max(n, out[-1][3]))
                else:
                    out.append((i, half, half + 1, n))
        return out

    def search(self, chars: np.ndarray, codes: np.ndarray):
        """(item, edits, start, end, shared q-grams) of the regions of a text, in normal form, that match."""
        at, k = self.shared(codes)
        if not len(at):
            return
        found, text = [], None
        for i, first, last, shared in self.bands(at, k):
            e, size = int(self.edits[i]), int(self.size[i])
            low, high = first * (e + 1) - size, (last + 1) * (e + 1) - 1 - size
            text = "".join(map(chr, chars)) if text is None else text
            exact = text.find(self.words[i], max(0, low), max(0, high + size))
            match = (0, exact, exact + size) if exact >= 0 else banded(chars, self.chars[i], low, high, e)
            if match:
                found.append((i, *match, shared))
        kept: list[tuple] = []
        for m in sorted(found):
            if not any(m[0] == o[0] and m[2] < o[3] and o[2] < m[3] for o in kept):
                kept.append(m)
        yield from kept


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts."""
    low, high = int(key.min()), int(key.max())
    if high - low > 4 * len(key):
        return np.unique(key, return_counts=True)
    n = np.bincount(key - low)
    at = np.flatnonzero(n)
    return at + low, n[at]


def _steps(n: np.ndarray, most: int):
    """Ranges of n that add up to about `most`."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def _blocks(benchmark: DataFrame):
    """The items, in blocks of at most BLOCK characters or one item, read one partition at a time."""
    rows, total = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        size = len(r.text or "")
        if rows and total + size > BLOCK:
            yield rows
            rows, total = [], 0
        rows.append((r.item_id, r.text))
        total += size
    yield rows


def _matches(items: Items, texts: list[str]):
    """For every text in turn, its matches with places in the text."""
    for t in texts:
        chars, codes, at = normal(t)
        yield [(i, e, int(at[s]), int(at[x - 1]) + 1, c) for i, e, s, x, c in items.search(chars, codes)]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, start, end (code points, end exclusive), edits, shared_qgrams; a row for each region."""
    names = ["doc_id", "item_id", "start", "end", "edits", "shared_qgrams"]
    base, out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None
    for rows in _blocks(benchmark.withColumn("item_id", F.col("item_id").cast("long"))):
        items = Items(rows)

        def run(batches, items=items):
            for b in common.sliced(batches, SLICE):
                got = [(d, items.ids[i], s, x, e, c) for d, found in zip(b.column(0).to_pylist(), _matches(items, common.texts(b)), strict=True) for i, e, s, x, c in found]
                yield pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in (zip(*got, strict=True) if got else [[]] * 6)], names=names)

        part = base.mapInArrow(run, ", ".join(f"`{n}` long" for n in names))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    at, schema, out = docs.columns.index("text"), docs.schema, docs
    for rows in _blocks(benchmark.withColumn("item_id", F.col("item_id").cast("long"))):
        items = Items(rows)

        def run(batches, items=items):
            for b in common.sliced(batches, SLICE):
                yield b.filter(pa.array([not found for found in _matches(items, [t or "" for t in b.column(at).to_pylist()])], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
