"""The inverted index as tables: docs, postings (term frequencies by field), document frequencies and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..functions import tokenize as tk
from ..storage import materialised, tasks

FIELDS = ("title", "tags", "body")
WEIGHTS = (2, 2, 1)
META = ("id", "mtype", "title", "tags", "created", "links", "harness", "core", "rationale", "scope", "confidence", "last_used", "path")


#: Bytes of text whose words one task counts, and postings that one task sorts: with the input, tasks grow in number and not in size.
COUNTED, SORTED = 8 << 20, 1_000_000


def by_document(memories: DataFrame) -> DataFrame:
    """(id, terms, tf_title, tf_tags, tf_body, len_title, len_tags, len_body), a row for each document, in the order of ids within a task.

    One shuffle, of the documents by id. A task splits each distinct word of some texts into terms once.
    """
    size = memories.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    texts = memories.select("id", "title", F.array_join("tags", " ").alias("tags"), "body")
    known = tk.characters(memories.sparkSession)
    kind = "id string, terms array<string>, " + ", ".join(f"tf_{n} array<int>" for n in FIELDS) + ", " + ", ".join(f"len_{n} long" for n in FIELDS)
    return texts.repartition(tasks(memories, size, COUNTED), "id").sortWithinPartitions("id").mapInArrow(lambda batches: _counted(batches, tk.Rule(*known)), kind)


#: Bytes of text whose words are counted at a time, and postings that are put in order at a time.
READ, RUN = 2 << 20, 1 << 18


def _counted(batches, rule: tk.Rule):
    """Batches of (id, title, tags, body), sorted by id -> of a row for each id."""
    held, size, last = [], 0, None
    for b in batches:
        ids, lo = b.column(0).to_pylist(), 0
        bytes_ = sum(pc.binary_length(b.column(k)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3)).tolist()
        for i, id_ in enumerate(ids):
            if size >= READ and id_ != last:
                held.append(b.slice(lo, i - lo))
                yield _document_rows(held, rule)
                held, size, lo = [], 0, i
            size, last = size + bytes_[i], id_
        held.append(b.slice(lo))
    if sum(b.num_rows for b in held):
        yield _document_rows(held, rule)


def _document_rows(held: list, rule: tk.Rule) -> pa.RecordBatch:
    """Of whole documents: words are cut and counted as arrays, and each distinct one is split into terms once."""
    t, stop, fields = pa.Table.from_batches(held).combine_chunks(), frozenset(tk.STOPWORDS), len(FIELDS)
    ids, texts = t.column(0).combine_chunks(), []
    for k in range(1, 1 + fields):
        # bytes that are no UTF-8 separate words, as they do in the JVM
        texts += ["" if x is None else x.decode("utf-8", "replace") for x in t.column(k).cast(pa.binary()).to_pylist()]
    id_code = ids.dictionary_encode().indices.fill_null(-1).to_numpy()
    new = np.append(True, id_code[1:] != id_code[:-1])
    doc = np.cumsum(new) - 1
    words, text = rule.cut(texts)
    code = words.dictionary_encode()
    n_words = max(len(code.dictionary), 1)
    key, n = np.unique((doc[text % len(doc)] * fields + text // len(doc)) * n_words + code.indices.to_numpy(), return_counts=True)
    names: dict = {}
    flat, size = [], []
    for w in code.dictionary.to_pylist():
        some = [names.setdefault(x, len(names)) for x in rule.terms(w) if x not in stop]
        flat += some
        size.append(len(some))
    size, n_terms = np.array(size, np.int64), max(len(names), 1)
    cell, word = np.divmod(key, n_words)
    times = size[word]
    at = np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    cell, n = np.repeat(cell, times), np.repeat(n, times)
    key, place = np.unique(cell // fields * n_terms + np.array(flat, np.int64)[at], return_inverse=True)
    of, term = np.divmod(key, n_terms)
    tfs = [np.bincount(place[cell % fields == f], n[cell % fields == f], len(key)).astype(np.int32) for f in range(fields)]
    ends = pa.array(np.searchsorted(of, np.arange(int(doc[-1]) + 2)).astype(np.int32))
    lists = [pa.array(list(names), pa.string()).take(pa.array(term)), *map(pa.array, tfs)]
    columns = [ids.filter(pa.array(new)), *(pa.ListArray.from_arrays(ends, x) for x in lists), *(pa.array(np.bincount(of, tf, int(doc[-1]) + 1).astype(np.int64)) for tf in tfs)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "terms", *(f"tf_{n}" for n in FIELDS), *(f"len_{n}" for n in FIELDS)])


def postings(memories: DataFrame) -> DataFrame:
    """(id, term, tf_title, tf_tags, tf_body) of all documents, a document's in one task."""
    return flat(by_document(memories))


def flat(documents: DataFrame) -> DataFrame:
    """by_document() -> postings, sorted by term in runs of about RUN, each of which a task puts in order where it lies."""
    return documents.select("id", "terms", *(f"tf_{n}" for n in FIELDS)).mapInArrow(_sorted_runs, "id string, term string, " + ", ".join(f"tf_{n} long" for n in FIELDS))


def _sorted_runs(batches):
    held, n = [], 0

    def run() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = [t.column(k).combine_chunks() for k in range(1, 5)]
        size = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
        code = lists[0].flatten().dictionary_encode()
        place = np.empty(len(code.dictionary), np.int32)
        place[pc.sort_indices(code.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(place), dtype=np.int32)
        order = np.argsort(place[code.indices.to_numpy()], kind="stable")
        row = pa.array(np.repeat(np.arange(len(size)), size)[order])
        columns = [t.column(0).combine_chunks().take(row), code.dictionary.take(code.indices.take(pa.array(order))), *(x.flatten().take(pa.array(order)).cast(pa.int64()) for x in lists[1:])]
        return pa.RecordBatch.from_arrays(columns, names=["id", "term", *(f"tf_{n}" for n in FIELDS)])

    for b in batches:
        for lo, hi in _cuts(b.column(1)):
            held.append(b.slice(lo, hi - lo))
            n += pc.sum(pc.list_value_length(held[-1].column(1))).as_py() or 0
            if n >= RUN:
                yield from _pieces(run())
                held, n = [], 0
    if n:
        yield from _pieces(run())


def _cuts(lists: pa.Array):
    """(from, to) of rows with about RUN items together."""
    end = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + RUN, "right")))
        yield lo, hi
        lo = hi


def _pieces(b: pa.RecordBatch):
    for lo in range(0, b.num_rows, 1 << 16):
        yield b.slice(lo, 1 << 16)


def in_order(post: DataFrame) -> DataFrame:
    """Postings, which must be a table already, ordered by term over tasks of bounded size. A frequent term's are dealt out by id."""
    return post.repartitionByRange(tasks(post, post.count(), SORTED), "term", "id").sortWithinPartitions("term", "id")


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def field_lengths(memories: DataFrame, post: DataFrame) -> DataFrame:
    """(id, len_title, len_tags, len_body) of every document."""
    sums = post.groupBy("id").agg(*(F.sum(f"tf_{n}").alias(f"len_{n}") for n in FIELDS))
    return memories.select("id").join(sums, "id", "left").select("id", *(F.coalesce(f"len_{n}", F.lit(0)).cast("long").alias(f"len_{n}") for n in FIELDS))


def hashed_text() -> Column:
    """What the content hash of a record covers: title, tags and the whole body."""
    return F.concat_ws("\n", "title", F.array_join("tags", " "), F.coalesce(F.col("body"), F.lit("")))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), *(F.coalesce(F.sum(f"len_{n}"), F.lit(0)).cast("long").alias(f"total_{n}") for n in FIELDS))


#: What a kept index says of itself: the format of its tables, and the first version whose postings count.
FORMAT, SIGN = 2, "format int, since int"
#: Versions after which the postings are written anew in order.
MOST_VERSIONS = 8


class UnusableIndex(ValueError):
    """A kept index that can't be read, or is of another format."""


def _signed(spark: SparkSession, at: str, since: int) -> None:
    spark.createDataFrame([(FORMAT, since)], SIGN).coalesce(1).write.parquet(f"{at}/sign")


def _last(spark: SparkSession, path: str) -> int | None:
    """The last version that was signed, which is when it is complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = [int(v[1:]) for v in (s.getPath().getName() for s in fs.listStatus(at)) if v[:1] == "v" and v[1:].isdigit()]
    done = [k for k in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{k}/sign/_SUCCESS"))]
    if found and not done:
        raise UnusableIndex("no version of the index is complete")
    return max(done, default=None)


@dataclass
class Index:
    """docs hold the metadata, the field lengths and the content hash; stats is one row."""

    docs: DataFrame
    postings: DataFrame
    df: DataFrame
    stats: DataFrame
    #: Where it is kept, as which version, and since which version its postings count.
    path: str | None = None
    version: int = 1
    since: int = 1
    #: by_document(), where the index was built in this session: whole documents are read from it without a shuffle.
    documents: DataFrame | None = None

    @classmethod
    def build(cls, memories: DataFrame, path: str | None = None) -> Index:
        """Computed once and kept as Parquet: as the first version below `path`, or in the shared folder. Postings are ordered by term, in runs, so that a query's terms prune pages."""
        at = f"{path}/v1"
        keep = (lambda df, name: _written(df, f"{at}/{name}")) if path else materialised
        documents = materialised(by_document(memories), "documents")
        post = keep(flat(documents), "postings")
        named = memories.columns
        text = hashed_text()
        meta = memories.select(*(c if c in named else F.lit(None).cast(_KINDS.get(c, "string")).alias(c) for c in META), fx.fnv1a64_hex(text).alias("content_hash"))
        lengths = documents.select("id", *(f"len_{n}" for n in FIELDS))
        docs = keep(meta.join(lengths, "id"), "docs")
        out = cls(docs, post, keep(document_frequencies(post), "df"), keep(corpus_stats(docs), "stats"), documents=documents)
        if path:
            _signed(memories.sparkSession, at, 1)
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index | None:
        """The last complete version below `path`; None where there is none, UnusableIndex where it can't be used.

        A version holds the postings of what it added, and the ids that it took out of those before.
        """
        last = _last(spark, path)
        if last is None:
            return None
        try:
            sign = spark.read.schema(SIGN).parquet(f"{path}/v{last}/sign").first()
            if sign is None or sign.format != FORMAT:
                raise UnusableIndex(f"index format {sign.format if sign else None}, not {FORMAT}")
            read = lambda k, name: spark.read.parquet(f"{path}/v{k}/{name}")
            post = gone = None
            for k in range(last, sign.since - 1, -1):
                part = read(k, "postings") if gone is None else read(k, "postings").join(gone, "id", "left_anti")
                post = part if post is None else part.unionByName(post)
                if k > sign.since:
                    gone = read(k, "gone") if gone is None else gone.unionByName(read(k, "gone")).distinct()
            return cls(read(last, "docs"), post, read(last, "df"), read(last, "stats"), path, last, sign.since)
        except UnusableIndex:
            raise
        except Exception as e:  # a file that is missing or isn't what it should be
            raise UnusableIndex(str(e).split("\n")[0]) from e

    def vocabulary(self) -> DataFrame:
        return self.df.select("term")


_KINDS = {"created": "long", "confidence": "long", "last_used": "long", "tags": "array<string>", "links": "array<string>"}


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def freshness(live: DataFrame, known: DataFrame) -> DataFrame:
    """(id, content_hash) now and as indexed -> (id, state): fresh, changed, new or deleted."""
    a, b = live.select("id", F.col("content_hash").alias("now")), known.select("id", F.col("content_hash").alias("was"))
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "new").when(F.col("now") == F.col("was"), "fresh").otherwise("changed")
    return a.join(b, "id", "full_outer").select("id", state.alias("state"))


def refresh(index: Index, memories: DataFrame) -> Index:
    """Entries with an unchanged hash stay, new and changed documents are tokenised, deleted ones go. Equal to a fresh build.

    Work and what is written follow the change: postings that stay are not sorted or written again, frequencies are corrected by
    those of what goes and comes. A kept index becomes its next version, unless nothing changed.
    """
    text, spark = hashed_text(), memories.sparkSession
    state = materialised(freshness(memories.select("id", fx.fnv1a64_hex(text).alias("content_hash")), index.docs).where("state != 'fresh'"), "freshness")
    named = memories.columns
    if state.isEmpty() and index.path:
        return index
    stale, again = state.where("state in ('deleted', 'changed')").select("id"), state.where("state in ('new', 'changed')").select("id")
    whole = index.path is not None and index.version - index.since + 1 >= MOST_VERSIONS
    at = f"{index.path}/v{index.version + 1}"
    keep = (lambda df, name: _written(df, f"{at}/{name}")) if index.path else materialised
    part = Index.build(memories.join(again, "id", "left_semi"))
    lengths = index.docs.join(stale, "id", "left_anti").select("id", *(f"len_{n}" for n in FIELDS)).unionByName(part.docs.select("id", *(f"len_{n}" for n in FIELDS)))
    meta = memories.select(*(c if c in named else F.lit(None).cast(_KINDS.get(c, "string")).alias(c) for c in META), fx.fnv1a64_hex(text).alias("content_hash"))
    docs = keep(meta.join(lengths, "id"), "docs")
    lost = index.postings.join(stale, "id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
    df = keep(index.df.unionByName(lost).unionByName(part.df).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"), "df")
    stats = keep(corpus_stats(docs), "stats")
    post = index.postings.join(stale, "id", "left_anti").unionByName(part.postings)
    if not index.path:
        return Index(docs, post, df, stats)
    keep(in_order(post) if whole else part.postings, "postings")
    keep(stale, "gone")
    _signed(spark, at, index.version + 1 if whole else index.since)
    return Index.load(spark, index.path)
