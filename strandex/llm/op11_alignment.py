"""Alignment of two tokenizers over a corpus, each distinct segment of text tokenised and aligned once.

A text, with a space before it, is split before each run of white space that begins with a space: no entry of either vocabulary
holds a space after anything but white space, which is checked when they are loaded, so no merge crosses such a place, and the first
vocabulary's pattern ends there as well. (Texts are left whole for vocabularies that fail the check.) A block of about BLOCK
bytes of texts writes its distinct segments, numbered, and its documents as sequences of these numbers. Segments that are
distinct over the whole corpus are tokenised by both and aligned; that is joined back to the blocks by segment, each of
which occurs once in a block, so no segment is a hot key however frequent it is in texts. Documents are composed of their
block's segments: both tokenizers end a token at each split, so groups and links of a document are those of its segments.

The documents that hold a pair linked are counted in the blocks and added up. A segment's links then have their sums, which go to
the blocks in the same way.

Defined cases: a null or empty text has no tokens, nor has one whose tokens don't give back its bytes (such as one with
U+2581, which the second vocabulary reads as a space); repeated rows count each; a null doc_id is returned as it is; an empty
table gives no rows; extra columns are ignored. A segment without a space in it, however long, is tokenised whole.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of text of a block, and of segments that are tokenised at a time.
BLOCK, SLICE = 32 << 20, 1 << 20
#: Segments in documents that are composed at a time.
CHUNK = 1 << 18
#: Segments of these characters only take the quick path, where both libraries agree on every class of characters.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_LOADED: dict = {}


class Vocabularies:
    """The two tokenizers, the bytes of their entries, and whether texts may be split before spaces."""

    def __init__(self, path_a: str, path_b: str):
        self.paths = path_a, path_b
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        held = dict(zip((chr(c) for c in plain), plain, strict=True)) | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        by_id = {i: bytes(held[c] for c in t) if all(c in held for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_a = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b)]
        self.space = self.b.piece_to_id("▁")
        self.split = not any(re.search(r"\S ", x.decode(errors="replace")) for x in (*self.bytes_a, *self.bytes_b))
        #: Of an id in a table.
        self.dtype = "<u2" if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else "<u4"
        ranks, self.quick = path_a.removesuffix(".json") + ".tiktoken", None
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}, special_tokens={})

    def __reduce__(self):
        return Vocabularies, self.paths

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        whole = [" " + s for s in segments]
        if self.quick is None:
            a = [e.ids for e in self.a.encode_batch(whole, add_special_tokens=False)]
        else:
            a = [None if _PLAIN.search(s) else self.quick.encode_ordinary(s) for s in whole]
            rest = [i for i, x in enumerate(a) if x is None]
            for i, e in zip(rest, self.a.encode_batch([whole[i] for i in rest], add_special_tokens=False), strict=True):
                a[i] = e.ids
        b = self.b.encode(segments, num_threads=1)
        return a, [x if s else [self.space] for x, s in zip(b, segments, strict=True)]


#: A space after white space, of any kind: there the quick way, by single spaces, isn't right.
_ODD = re.compile(r"\s |^ ")
_SPLIT = re.compile(r"(?<=\S)(?= )")


def segments(text: str, split: bool) -> list[str]:
    """The text, which has a space before it, in pieces that each have a space before them, left out here."""
    if not split:
        return [text]
    if not _ODD.search(text):
        return text.split(" ")
    return [x[1:] for x in _SPLIT.split(" " + text)]


def loaded(paths: tuple[str, str]) -> Vocabularies:
    if paths not in _LOADED:
        _LOADED[paths] = Vocabularies(*paths)
    return _LOADED[paths]


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


#: A link's flags: the first tokenizer's token ends here, the second's does.
ENDS_A, ENDS_B = 1, 2


def aligned(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, flags) of each link, in order, of two tokenisations of the same bytes.

    Two tokens overlap in one stretch without an end of either inside: so there is a link for each end of either.
    """
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    cuts = np.union1d(ends_a, ends_b)
    of_a, of_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return of_a, of_b, ENDS_A * (ends_a[of_a] == cuts) + ENDS_B * (ends_b[of_b] == cuts)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(n.sum())), n


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, … within each of so many."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def encoded(a, n_a, b, n_b, flags, n_links, dtype: str) -> pa.Array:
    """A binary value for each segment: ids of a, ids of b, flags of links."""
    sizes = n_a + n_b + n_links
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype)
    for values, n, begin in ((a, n_a, at), (b, n_b, at + n_a), (flags, n_links, at + n_a + n_b)):
        out[np.repeat(begin, n) + _within(n)] = values
    width = np.dtype(dtype).itemsize
    offsets = np.concatenate([[0], np.cumsum(sizes * width)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


class Alignment:
    """What `encoded` holds, of many segments: a, b, flags flat; n_a, n_b, n_links by segment; pair and seg of each link."""

    def __init__(self, data: list[bytes], n_a: np.ndarray, n_b: np.ndarray, dtype: str):
        flat = np.frombuffer(b"".join(data), dtype).astype(np.int64)
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // np.dtype(dtype).itemsize
        self.n_a, self.n_b, self.n_links = n_a, n_b, sizes - n_a - n_b
        at = np.cumsum(sizes) - sizes
        take = lambda begin, n: flat[np.repeat(begin, n) + _within(n)]
        self.a, self.b, self.flags = take(at, n_a), take(at + n_a, n_b), take(at + n_a + n_b, self.n_links)
        ends = [(self.flags & f) > 0 for f in (ENDS_A, ENDS_B)]
        self.of_a, self.of_b = (np.cumsum(e) - e for e in ends)  # every segment ends both
        self.pair = self.a[self.of_a] << 32 | self.b[self.of_b] if len(flat) else np.zeros(0, np.int64)
        self.seg = np.repeat(np.arange(len(data)), self.n_links)
        self.closed = ends[0] & ends[1]
        self.n_groups = np.bincount(self.seg[self.closed], minlength=len(data))

    def groups(self) -> list[str]:
        """Each segment's groups as text."""
        out: list[str] = []
        a, b = self.of_a[self.closed] + 1, self.of_b[self.closed] + 1
        ends, i, j, g = np.cumsum(self.n_groups), 0, 0, 0
        for at in range(0, len(ends), CHUNK // 16):
            to = ends[at : at + CHUNK // 16]
            k, m = (a[g : to[-1]] - i).tolist(), (b[g : to[-1]] - j).tolist()
            ids = [list(map(str, x.tolist())) for x in (self.a[i : i + k[-1]], self.b[j : j + m[-1]])] if k else []
            text = [",".join(ids[0][x:y]) + "|" + ",".join(ids[1][u:v]) for x, y, u, v in zip([0, *k], k, [0, *m], m, strict=False)]
            stops = (to - g).tolist()
            out += [";".join(text[x:y]) for x, y in zip([0, *stops], stops, strict=False)]
            if k:
                i, j, g = i + k[-1], j + m[-1], int(to[-1])
        return out


def by_planes(x: np.ndarray) -> bytes:
    """Numbers under 2**32 as their lowest bytes, then the next ones: high bytes are mostly zeros, which compress to nothing together."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_CODED = "block long, doc_id long, doc long, codes binary, no long, segment string"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def coded(docs: DataFrame, split: bool, block: int = BLOCK) -> DataFrame:
    """The blocks' documents (block, doc_id, doc: which of the block, codes: numbers of its segments in order) and segments (block, no, segment)."""

    def run(batches):
        seen = 0
        for b in common.sliced((b for b in batches if b.num_rows), block):
            known: dict[str, int] = {}
            codes = [np.array([known.setdefault(s, len(known)) for s in segments(t, split)] if t else [], "<u4") for t in common.texts(b)]
            at = (b.column(2)[0].as_py() << 24) + seen
            seen += 1
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), b.column(0), pa.array(range(n), pa.int64()), pa.array(map(by_planes, codes), pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=_names(_CODED))
            whole = list(known)
            for i, j in common.slices([len(s) for s in whole], block):
                k = j - i
                yield pa.RecordBatch.from_arrays([pa.array([at] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(i, j), pa.int64()), pa.array(whole[i:j], pa.string())], names=_names(_CODED))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, _CODED)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


#: Segments whose tokens don't give back their bytes have none.
_ALIGNED = "segment string, sid long, n_a int, n_b int, data binary"


def alignments(segments: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(segment, sid) of distinct segments -> _ALIGNED."""

    def run(batches):
        voc = loaded(paths)
        for b in common.sliced((b for b in batches if b.num_rows), SLICE, "segment"):
            texts = b.column(0).to_pylist()
            (x, n_x), (y, n_y) = map(_flat, voc.encoded(texts))
            ok = same(voc, texts, x, n_x, y, n_y)
            x, y, n_x, n_y = x[np.repeat(ok, n_x)], y[np.repeat(ok, n_y)], n_x * ok, n_y * ok
            of_x, _, flags = aligned(x, y, *voc.sizes)
            n_links = np.bincount(np.repeat(np.arange(len(texts)), n_x)[of_x], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_x, pa.int32()), pa.array(n_y, pa.int32()), encoded(x, n_x, y, n_y, flags, n_links, voc.dtype)], names=_names(_ALIGNED))

    return segments.select("segment", "sid").mapInArrow(run, _ALIGNED)


def same(voc: Vocabularies, texts: list[str], x, n_x, y, n_y) -> np.ndarray:
    """Whether each segment's tokens give back its bytes, by both tokenizers."""
    whole = [(" " + t).encode() for t in texts]
    ok = np.ones(len(texts), bool)
    for held, ids, n in ((voc.bytes_a, x.tolist(), n_x), (voc.bytes_b, y.tolist(), n_y)):
        sizes = np.array([len(held[i]) for i in ids], np.int64)
        sums = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])])
        if (sums == list(map(len, whole))).all() and b"".join([held[i] for i in ids]) == b"".join(whole):
            continue
        ends = np.cumsum(n).tolist()
        ok &= np.array([b"".join([held[i] for i in ids[i:j]]) == t for i, j, t in zip([0, *ends], ends, whole, strict=False)], bool)
    return ok


_COMPOSED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, nos binary, times binary, pair long, n long, no long, sid long"


def composed(docs: DataFrame, held: DataFrame, dtype: str) -> DataFrame:
    """docs (block, doc_id, doc, codes), held (at: the block, no, <alignment>) -> the documents with their distinct segments, the block's pairs, and its segments."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left["block"][0].as_py()
        right = right.take(pa.array(np.argsort(right["no"].to_numpy())))
        column = lambda c: right[c].to_numpy().astype(np.int64)
        n_a, n_b, count, pairs, groups = column("n_a"), column("n_b"), [], [], []
        for i in range(0, len(right), CHUNK // 4):
            some = slice(i, i + CHUNK // 4)
            al = Alignment(right["data"].slice(i, CHUNK // 4).to_pylist(), n_a[some], n_b[some], dtype)
            count.append((al.n_groups, al.n_links))
            pairs.append(al.pair)
            groups += al.groups()
        n_groups, n_links = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*count, strict=True) if count else ((), ())))
        pair, local = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]), return_inverse=True)
        local, ok, begin = local.astype(np.int32), n_a > 0, np.cumsum(n_links) - n_links
        right, pairs = right.select(["sid"]), None
        held_by, used = np.zeros(len(pair), np.int64), np.zeros(len(right), bool)
        parts = []
        for i, j in common.slices([len(c) for c in left["codes"].to_pylist()], CHUNK):
            some = left.slice(i, j - i)
            codes = list(map(from_planes, some["codes"].to_pylist()))
            n, count = np.array([len(c) for c in codes], np.int64), len(codes)
            doc, code = np.repeat(np.arange(count), n), np.concatenate(codes).astype(np.int64)
            good = n > 0
            good[doc[~ok[code]]] = False
            sums = [np.where(good, np.bincount(doc, c[code], count), 0).astype(np.int64) for c in (n_a, n_b, n_groups, n_links)]
            sha = [hashlib.sha256(";".join([groups[k] for k in c.tolist()]).encode()).hexdigest() if g else "" for c, g in zip(codes, good.tolist(), strict=True)]
            # (document, segment), then (document, pair), each once
            keep, size = good[doc], max(len(right), 1)
            each, times = np.unique(doc[keep] * size + code[keep], return_counts=True)
            of, seg = each // size, each % size
            cut, span = np.searchsorted(of, np.arange(count + 1)), n_links[seg]
            once = np.unique(np.repeat(of, span) * max(len(pair), 1) + local[np.repeat(begin[seg], span) + _within(span)])
            held_by += np.bincount(once % max(len(pair), 1), minlength=len(pair))
            used[seg] = True
            binary = lambda values, cut=cut: pa.array([by_planes(np.diff(values[x:y], prepend=0)) for x, y in zip(cut, cut[1:], strict=False)], pa.binary())
            parts.append({"doc_id": some["doc_id"].combine_chunks(), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, sums), strict=True)), "groups_sha256": pa.array(sha, pa.string()), "nos": binary(seg), "times": binary(times)})
        seen, used = np.nonzero(held_by)[0], np.nonzero(used)[0]
        parts += [{"pair": pa.array(pair[seen]), "n": pa.array(held_by[seen])}, {"no": pa.array(used), "sid": right["sid"].take(pa.array(used)).combine_chunks()}]
        common.trim()
        return pa.concat_tables([_filled(block, c, _COMPOSED) for c in parts])

    return docs.groupBy("block").cogroup(held.groupBy("at")).applyInArrow(run, _COMPOSED)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _filled(block: int, columns: dict[str, pa.Array], schema: str) -> pa.Table:
    n = len(next(iter(columns.values())))
    columns = {"block": pa.array([block] * n, pa.int64())} | columns
    return pa.Table.from_arrays([columns[c] if c in columns else pa.nulls(n, _ARROW[t]) for c, t in (x.split() for x in schema.split(", "))], names=_names(schema))


def scored(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """docs (block, <composed>), sums (at: the block, no, n_best, count_sum) -> _OUT."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["no"].to_numpy()
        by_no = np.zeros((2, int(at.max()) + 1 if len(at) else 1), np.int64)
        by_no[:, at] = right["n_best"].to_numpy(), right["count_sum"].to_numpy()
        found = np.zeros((2, len(left)), np.int64)
        for i, (nos, times) in enumerate(zip(left["nos"].to_pylist(), left["times"].to_pylist(), strict=True)):
            back = [np.cumsum(from_planes(x).view("<i4"), dtype=np.int64) for x in (nos, times)]
            found[:, i] = by_no[:, back[0]] @ back[1]
        columns = dict(zip(("n_best", "count_sum"), map(pa.array, found), strict=True))
        return pa.Table.from_arrays([columns[c] if c in columns else left[c].combine_chunks() for c in _names(_OUT)], names=_names(_OUT))

    return docs.groupBy("block").cogroup(sums.groupBy("at")).applyInArrow(run, _OUT)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n) of the blocks -> (pair, count, best): documents that hold it linked, and whether no other pair of its first id has more."""
    counts = common.saved(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    return common.saved(counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def links(alignment: DataFrame, dtype: str) -> DataFrame:
    """(sid, pair, times) of the distinct links of each segment."""

    def run(batches):
        for b in common.sliced((b for b in batches if b.num_rows), SLICE, "data"):
            sid, n_a, n_b = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sid", "n_a", "n_b"))
            al = Alignment(b.column("data").to_pylist(), n_a, n_b, dtype)
            pair, local = np.unique(al.pair, return_inverse=True)
            each, times = np.unique(al.seg * max(len(pair), 1) + local, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sid[each // max(len(pair), 1)]), pa.array(pair[each % max(len(pair), 1)]), pa.array(times)], names=["sid", "pair", "times"])

    return alignment.where("n_a > 0").select("sid", "n_a", "n_b", "data").mapInArrow(run, "sid long, pair long, times long")


def segment_sums(alignment: DataFrame, counts: DataFrame, dtype: str) -> DataFrame:
    """(sid, n_best, count_sum) of each segment. A pair that is in more than a thousandth of all segments' links, of which there are fewer than 1000, goes to all executors."""
    rows = common.saved(links(alignment, dtype), "links")
    counts = common.saved(counts.join(rows.groupBy("pair").agg(F.count("*").alias("uses")), "pair"), "uses")
    n = counts.agg(F.sum("uses")).first()[0] or 0
    hot = counts.where(F.col("uses") * 1000 > n).drop("uses")
    first = rows.join(F.broadcast(hot), "pair", "left")
    met = first.where("count is not null").unionByName(first.where("count is null").drop("count", "best").join(counts.drop("uses"), "pair"))
    return met.select("sid", "times", "best", "count").groupBy("sid").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> _OUT, a row for each row."""
    paths = paths or vocabularies()
    voc = loaded(paths)
    parts = common.saved(coded(docs, voc.split, block), "coded", common.SCAN)
    pieces = parts.where("segment is not null").select(F.col("block").alias("at"), "no", "segment")
    distinct = pieces.select("segment").distinct().withColumn("sid", F.monotonically_increasing_id())
    table = common.saved(alignments(distinct, paths), "alignments")
    whole = parts.where("doc is not null").select("block", "doc_id", "doc", "codes")
    held = common.saved(pieces.join(table, "segment").drop("segment"), "held")
    done = common.saved(composed(whole, held, voc.dtype), "composed")
    common.used_up(parts, held)
    counts = pair_counts(done.where("pair is not null").select("pair", "n"))
    sums = common.saved(segment_sums(table, counts, voc.dtype), "sums")
    common.used_up(table)
    sums = done.where("sid is not null").select(F.col("block").alias("at"), "no", "sid").join(sums, "sid").drop("sid")
    return scored(done.where("groups_sha256 is not null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "nos", "times"), sums)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(common.table(spark, sf_dir, "documents"))
