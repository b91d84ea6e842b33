"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles; two link when 100 * |x & y| >= PERCENT * |x | y|. The join is exact up to collisions of
hashes of 60 bits or more:

1. Every batch of documents sends its shingles' hashes, as packed arrays, to buckets by hash. A bucket counts in how many
   documents each occurs and sends back those found twice or more. What many documents of a batch share travels once for the
   batch, with its count, so that a shingle that a third of all documents hold fills no bucket.
2. A document links to another only if PERCENT of its shingles at least are found elsewhere. The others are done: most of them.
3. Equal sets are one class. A class's prefix is its rarest shared shingles, as many as make sure that linked classes share
   one of them; the rarest come first, so what everybody shares is in the prefix of nobody who has something else.
4. Similar classes gather: each is compared with the class that leads most of its prefix shingles, and what links is one
   component; twice. Links within a component are implied, so none is computed there.
5. Classes that still share a prefix shingle with another component are partitioned into groups of bounded bytes by the class
   that leads their rarest shingle. The token-group matrix holds, for each group, the union of its prefix shingles, by which a
   class finds groups to ask, and the union of all its shingles with the least and largest set in it. A class can link into a
   group only if it shares as many shingles with the union as a link with the group's best fitting member takes; groups that
   do not reach that bound stay shut. Only those that do are opened, and the class is compared with their members.

A class's queries of a group are dealt to tasks in chunks of bounded bytes, and a task returns only links that join components
which its links before don't join yet: so a component is connected, but not all pairs within it are listed.

Defined cases: null or empty texts have an empty set, link with nothing, and their own id as component; with fewer words than
`shingle` the whole sequence is the one shingle; repeated rows get a row each; a null doc_id counts as no id in the smallest,
so a document known by no id gets the smallest id it reaches, or null; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

PERCENT, SHINGLE = 75, 5
#: Bytes of text for each bucket; documents of a batch that make a shingle travel once for it.
BUCKET, OFTEN = 16_000_000, 64
#: Characters of a batch; bytes of the sets of a group, and of the queries that one task asks it.
BATCH, GROUP, CHUNK = 8_000_000, 2_000_000, 4_000_000
SENT = "part int, key long, batch long, tokens binary, docs binary, df binary, doc_id array<long>, r1 array<long>, r2 array<long>, n array<long>, s1 array<long>, s2 array<long>"
_DOC = ("doc_id", "r1", "r2", "n", "s1", "s2")
_SCHEMA = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("batch", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("df", pa.binary()), *((c, pa.list_(pa.int64())) for c in _DOC)])


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, by document, then hash."""
    w = common.Words(texts, lower=True)
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    counts = np.diff(w.first)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.nonzero((w.first[doc + 1] - np.arange(n) >= size) | ((counts[doc] < size) & (np.arange(n) == w.first[doc])))[0]
    last = np.minimum(first + size, w.first[doc[first] + 1]) - 1
    h, d = w.hashes(w.start[first], w.end[last], w.sums()), doc[first]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[fresh], h[fresh]


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _smaller(batches):
    """Batches of at most BATCH characters or one document, and of fewer documents than 16 bits number."""
    for b in batches:
        sizes = [n + BATCH // 50_000 for n in common.lengths(b)]
        for i, j in common.slices(sizes, BATCH):
            yield b.slice(i, j - i)


def _packed(token: np.ndarray, bits: int) -> bytes:
    """Sorted tokens of one bucket in 7 bytes each, without the leading bits that its number gives; plane by plane, so that the leading ones compress."""
    return (token << np.uint64(bits) >> np.uint64(8)).view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()


def _unpacked(data: bytes, bucket: int, bits: int) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(7, -1).T
    return wide.view(np.uint64)[:, 0] << np.uint64(8) >> np.uint64(bits) | np.uint64(bucket << (64 - bits))


def _sender(size: int, bits: int):
    #: What 7 bytes beside the bucket's number cannot hold is cut off.
    whole, shift, buckets = ~np.uint64((1 << max(0, 8 - bits)) - 1), np.uint64(64 - bits), 1 << bits

    def sent(b, key):
        texts, docs, hashes = common.texts(b), [np.zeros(0, np.uint16)], [np.zeros(0, np.uint64)]
        for i, j in common.slices([len(t) for t in texts], 1 << 20):
            d, h = shingles(texts[i:j], size)
            docs.append((d + i).astype(np.uint16))
            hashes.append(h & whole)
        n = np.zeros(len(texts), np.int64)
        del texts
        doc, token = np.concatenate(docs), np.concatenate(hashes)
        del docs, hashes
        n += np.bincount(doc, minlength=len(n))
        sums = []
        for salt in (0x1234567, 0x7654321):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mixed(token ^ np.uint64(salt)))])
            sums.append((total[np.cumsum(n)] - total[np.cumsum(n) - n]).view(np.int64))
        del total
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        del order
        head = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0] if len(token) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(token)))
        marks, counts = token[head[times >= OFTEN]], times[times >= OFTEN].astype(np.int32)
        often = np.repeat(times >= OFTEN, times)
        del head, times
        yield _rows([{"part": key % buckets, "key": -1 - key, "batch": key, "tokens": token[often].tobytes(), "docs": doc[often].tobytes(), **{c: b.column(i).to_pylist() for i, c in enumerate(_DOC[:3])}, "n": n.tolist(), "s1": sums[0].tolist(), "s2": sums[1].tolist()}])
        token, doc = token[~often], doc[~often]
        edges = np.arange(buckets + 1, dtype=np.uint64)
        cut, at = np.searchsorted(token >> shift, edges), np.searchsorted(marks >> shift, edges)
        rows = []
        for k in range(buckets):
            for i, j, held, of, other in ((cut[k], cut[k + 1], token, "docs", doc), (at[k], at[k + 1], marks, "df", counts)):
                if j > i:
                    rows.append({"part": k, "key": k, "batch": key, "tokens": _packed(held[i:j], bits), of: other[i:j].tobytes()})
            if len(rows) >= 64:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, b in enumerate(_smaller(batches)):
            yield from sent(b, part << 32 | number)
            common.trim()

    return run


def _bucket(bits: int):
    """Of a bucket: what is found in two documents or more, by batch, with the number of documents. Batches' own rows pass."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["key"][0].as_py()
        if bucket < 0:
            return table
        common.trim()
        docs, batch = table["docs"].to_pylist(), table["batch"].to_pylist()
        parts = [_unpacked(x, bucket, bits) for x in table["tokens"].to_pylist()]
        weight = np.concatenate([np.ones(len(p), np.int64) if d is not None else np.frombuffer(f, np.int32) for p, d, f in zip(parts, docs, table["df"].to_pylist(), strict=True)])
        doc = np.concatenate([np.frombuffer(d, np.uint16) if d is not None else np.zeros(len(p), np.uint16) for p, d in zip(parts, docs, strict=True)])
        row, token, count = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts]), np.concatenate(parts), len(parts)
        del parts
        order = np.argsort(token, kind="stable")
        sorted_token = token[order]
        head = np.nonzero(np.concatenate([[True], sorted_token[1:] != sorted_token[:-1]]))[0]
        del sorted_token
        df = np.empty(len(token), np.int64)
        df[order] = np.repeat(np.add.reduceat(weight[order], head), np.diff(np.append(head, len(token))))
        del order, weight, head
        keep = df > 1
        token, doc, row, df = token[keep], doc[keep], row[keep], np.minimum(df[keep], 65_535).astype(np.uint16)
        cut = np.searchsorted(row, np.arange(count + 1))
        return pa.Table.from_batches([_rows([{"part": bucket, "key": bucket, "batch": batch[k], "tokens": _packed(token[i:j], bits), "docs": doc[i:j].tobytes() if docs[k] is not None else None, "df": df[i:j].tobytes()} for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i])], _SCHEMA)

    return run


SETS = "doc_id long, r1 long, r2 long, n long, s1 long, s2 long, tokens binary, prefix array<long>"


def _documents(percent: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        common.trim()
        keys = table["key"].to_pylist()
        i = next(i for i, key in enumerate(keys) if key < 0)
        held = [table[c][i].as_py() for c in _DOC]
        n = held[3]
        own, own_doc = np.frombuffer(table["tokens"][i].as_py(), np.uint64), np.frombuffer(table["docs"][i].as_py(), np.uint16)
        tokens, docs, dfs, marks, marks_df = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        for key, t, d, f in zip(keys, table["tokens"].to_pylist(), table["docs"].to_pylist(), table["df"].to_pylist(), strict=True):
            if key >= 0:
                (tokens if d is not None else marks).append(_unpacked(t, key, bits))
                (dfs if d is not None else marks_df).append(np.frombuffer(f, np.uint16))
                docs += [np.frombuffer(d, np.uint16)] if d is not None else []
        mark, mark_df = np.concatenate(marks), np.concatenate(marks_df)
        order = np.argsort(mark)
        mark, mark_df = mark[order], mark_df[order]
        token, doc = np.concatenate([*tokens, own]), np.concatenate([*docs, own_doc])
        df = np.concatenate([*dfs, mark_df[np.searchsorted(mark, own)] if len(own) else np.zeros(0, np.uint16)])
        order = np.lexsort((token, doc))
        token, doc, df = token[order], doc[order], df[order]
        cut = np.searchsorted(doc, np.arange(len(n) + 1))
        sets, prefixes = [], []
        for k, size in enumerate(n):
            a, b = cut[k], cut[k + 1]
            least = (percent * size + 99) // 100
            if size and b - a >= least:
                t = token[a:b]
                sets.append(t.tobytes())
                prefixes.append(t[np.lexsort((t, df[a:b]))[: b - a - least + 1]].view(np.int64).tolist())
            else:
                sets.append(None), prefixes.append(None)
        kinds = (pa.int64(),) * 6 + (pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip((*held, sets, prefixes), kinds, strict=True)], names=[x.split()[0] for x in SETS.split(", ")])

    return run


def shared_sets(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(doc_id, r1, r2: identity of the row, n, s1, s2: hashes of the set; of documents that may link: tokens found elsewhere too, prefix)."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = max(4, int(total // BUCKET).bit_length())
    sent = docs.select(F.col("doc_id").cast("long"), *common.row_key(), F.col("text").cast("string")).mapInArrow(_sender(size, bits), SENT)
    found = sent.repartitionById(1 << bits, "part").groupBy("part", "key").applyInArrow(_bucket(bits), SENT)
    return common.saved(found.groupBy("batch").applyInArrow(_documents(percent, bits), SETS), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """Of the pairs (a, b), those that link. most: how many pairs there are at most."""

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                n, m, x, y = (b.column(k)[i].as_py() for k in range(2, 6))
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep[i] = 100 * both >= percent * (n + m - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda c, n, s: sets.select(F.col("c").alias(c), F.col("n").alias(n), F.col("tokens").alias(s))
    rows = pairs.join(side("a", "na", "sa"), "a").join(side("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return common.saved(rows.mapInArrow(run, "a long, b long"), "pairs", rows=most, each=20_000)


def _root(root: dict[int, int], g: int) -> int:
    while root[g] != g:
        root[g] = root[root[g]]
        g = root[g]
    return g


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]


def links(asking: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """Links between classes (c, g, n, tokens) that ask and members of a group, as far as they join components g anew."""
    queries, sets = _sets(asking), _sets(members)
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    n, g, c = (_column(members, k) for k in ("n", "g", "c"))
    found, root = [], {int(k): int(k) for k in (*g, *_column(asking, "g"))}
    for x, size, own, name in zip(queries, *(_column(asking, k).tolist() for k in ("n", "g", "c")), strict=True):
        low, high = np.searchsorted(token, x), np.searchsorted(token, x, side="right")
        times = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        hit = np.nonzero((g != own) & (100 * shared >= percent * (size + n - shared)))[0]
        for k in hit[np.unique(g[hit], return_index=True)[1]]:
            a, b = _root(root, own), _root(root, int(g[k]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((name, int(c[k])))
    return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])


def least_overlap(size, least, percent: int):
    """Shingles that a set must share with one of `least` or more to link, if any may: the bound of a query and a group."""
    other = np.maximum(least, -(-percent * size // 100))
    return -(-percent * (size + other) // (100 + percent))


def union(table: pa.Table) -> pa.Table:
    """A group's row of the matrix: the union of its members' tokens, the least and largest size, the least and largest component."""
    n, g = _column(table, "n"), _column(table, "g")
    tokens = np.unique(np.concatenate(_sets(table)))
    return pa.table({"block": table["block"][:1], "tokens": pa.array([tokens.tobytes()], pa.binary()), **{k: pa.array([int(v)], pa.int64()) for k, v in (("least", n.min()), ("most", n.max()), ("first", g.min()), ("last", g.max()))}})


def _asked(asking: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asking (c, g, block) -> the same with tokens and a chunk of the block's queries of bounded bytes; (block, chunk) of every block."""
    sized = asking.join(sets.select("c", "n", F.octet_length("tokens").alias("size")), "c")
    chunks = sized.groupBy("block").agg(F.ceil(F.sum("size") / CHUNK).alias("chunks"))
    dealt = sized.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("c", "block"), "chunks")).select("c", "g", "block", "chunk")
    return dealt.join(sets.select("c", "n", "tokens"), "c"), chunks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))


def opened(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that share a token of rows (token, c, n, g, lead) and are not yet in one component g."""
    home = rows.groupBy("c", "g").agg(F.min("lead").alias("home")).join(sets.select("c", F.octet_length("tokens").alias("size")), "c")
    dealt = home.groupBy("home").agg(F.ceil(F.sum("size") / GROUP).alias("blocks"))
    count = rows.count()
    home = common.saved(home.join(dealt, "home").select("c", "g", F.xxhash64("home", F.pmod(F.xxhash64("c"), "blocks")).alias("block")), "groups", rows=count)
    classes = home.count()
    members = home.join(sets.select("c", "n", "tokens"), "c")
    within = common.saved(members.groupBy("block").applyInArrow(lambda t: links(t, t, percent), "a long, b long"), "opened", rows=classes, each=2_000)
    # components that groups' own links join, by the components' names
    name = lambda side: home.select(F.col("c").alias(side), F.col("g").alias("g" + side))
    joined = components(within.join(name("a"), "a").join(name("b"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    home_now = common.saved(home.join(joined.withColumnRenamed("node", "g"), "g", "left").select("c", F.coalesce("label", "g").alias("g"), "block"), "groups", rows=classes)
    members = home_now.join(sets.select("c", "n", "tokens"), "c")
    unions = common.saved(members.groupBy("block").applyInArrow(union, "block long, tokens binary, least long, most long, first long, last long"), "unions", rows=classes, each=20_000)
    # the matrix by prefix token; of two groups the one with the smaller number asks
    held = common.saved(rows.select("token", "c", "n").join(home_now, "c"), "held", rows=count)
    other = held.select("token", F.col("block").alias("other")).distinct()
    asks = held.join(other, "token").where("block < other").select("c", "n", "g", F.col("other").alias("block")).distinct()
    fits = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent) & ~((F.col("first") == F.col("last")) & (F.col("first") == F.col("g")))
    asks = common.saved(asks.join(unions.drop("tokens"), "block").where(fits).select("c", "g", "block"), "asks", 1)
    asked = asks.count()

    def bounded(asking: pa.Table, group: pa.Table) -> pa.Table:
        if not len(asking) or not len(group):
            return pa.table({c: pa.array([], pa.int64()) for c in ("c", "g", "block")})
        whole, least = _sets(group)[0], group["least"][0].as_py()
        shared = np.array([len(np.intersect1d(x, whole, assume_unique=True)) for x in _sets(asking)])
        return asking.select(["c", "g", "block"]).filter(pa.array(shared >= least_overlap(_column(asking, "n"), least, percent)))

    def across(asking: pa.Table, group: pa.Table) -> pa.Table:
        return links(asking, group, percent) if len(asking) and len(group) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    at = ["block", "chunk"]
    asking, chunks = _asked(asks, sets)
    qualifying = asking.groupBy(*at).cogroup(unions.select("block", "tokens", "least").join(chunks, "block").groupBy(*at)).applyInArrow(bounded, "c long, g long, block long")
    qualifying = common.saved(qualifying, "qualifying", rows=asked, each=20_000)
    asking, chunks = _asked(qualifying, sets)
    between = common.saved(asking.groupBy(*at).cogroup(members.join(chunks, "block").groupBy(*at)).applyInArrow(across, "a long, b long"), "opened", rows=asked, each=2_000)
    common.used_up(home, home_now, unions, held, asks, qualifying)
    return within.unionByName(between)


def _grouped(prefix: DataFrame, links: DataFrame | None) -> DataFrame:
    """prefix (token, c, n) with the group of each class: the smallest class it reaches so far."""
    if links is None:
        return prefix.withColumn("g", F.col("c"))
    of = components(links)
    return prefix.join(of.withColumnRenamed("node", "c"), "c", "left").withColumn("g", F.coalesce("label", "c")).drop("label")


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """sets: a row for each class (c, n, tokens, prefix) -> links (a, b) that connect all classes that links reach."""
    prefix = common.saved(sets.select("c", "n", F.explode("prefix").alias("token")), "prefix", 1)
    links, rows, classes = None, prefix.count(), sets.count()
    fits = lambda n, m: F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
    for step in range(3):
        now = common.saved(_grouped(prefix, links), f"grouped{step}", rows=rows)
        # shingles that classes of two components hold in their prefixes; the first component's first class leads
        open_ = now.groupBy("token").agg(F.min(F.struct("g", "c", "n")).alias("lead"), F.max("g").alias("last")).where(F.col("lead.g") < F.col("last"))
        if step < 2:
            near = now.join(open_, "token").where((F.col("g") != F.col("lead.g")) & fits(F.col("n"), F.col("lead.n"))).groupBy("c", F.col("lead.c").alias("b")).agg(F.count("*").alias("shared"))
            pairs = near.groupBy("c").agg(F.max(F.struct("shared", "b")).alias("best")).select(F.col("c").alias("a"), F.col("best.b").alias("b"))
            got = verified(pairs, sets, percent, classes)
        else:
            still = common.saved(now.join(open_.select("token", F.col("lead.c").alias("lead")), "token"), "open", rows=rows)
            got = opened(still, sets, percent)
            common.used_up(still)
        common.used_up(now)
        links = got if links is None else common.saved(links.unionByName(got), "links-so-far", rows=3 * classes)
    common.used_up(prefix)
    return links


def membership(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """A row for each row of docs: doc_id, r1, r2, n, class_id and component (null where nothing links), component_id."""
    every = shared_sets(docs, percent, size)
    key = ["n", "s1", "s2"]
    sets = common.saved(every.where("tokens is not null").dropDuplicates(key).select(*key, "tokens", "prefix").withColumn("c", F.monotonically_increasing_id()), "classes", 1)
    of = components(class_links(sets.select("c", "n", "tokens", "prefix"), percent)).select(F.col("node").alias("c"), "label")
    rows = every.select("doc_id", "r1", "r2", *key, F.col("tokens").isNotNull().alias("maybe"))
    least = rows.where("maybe").groupBy(*key).agg(F.min("doc_id").alias("id")).join(sets.select(*key, "c"), key).join(of, "c", "left").withColumn("label", F.coalesce("label", "c"))
    named = least.join(least.groupBy("label").agg(F.min("id").alias("component_id")), "label").select(*key, F.col("c").alias("class_id"), F.col("label").alias("component"), "component_id")
    linked = rows.where("maybe").join(named, key).select("doc_id", "r1", "r2", "n", "class_id", "component", "component_id")
    none = F.lit(None).cast("long")
    return linked.unionByName(rows.where("not maybe").select("doc_id", "r1", "r2", "n", none.alias("class_id"), none.alias("component"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, class_id (of equal sets; null where nothing can link)."""
    return membership(docs, percent, size).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """docs, with all their columns, of every group of linked rows one only: that with the smallest id, null ids last.

    Decided by row, not by id: of rows with the same id and different texts, each goes only where its own group keeps another;
    of rows that are the same in id and text, one stays.
    """
    known = common.saved(membership(docs.select("doc_id", "text"), percent, size).where("component is not null"), "near", 1)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r1", "r2")
    first = known.groupBy("component").agg(F.min(row).alias("first"))
    names = ("_strandex_r1", "_strandex_r2")
    rows = lambda df: df.select(*(F.col(c).alias(n) for c, n in zip(("r1", "r2"), names, strict=True)))
    gone = rows(known.join(first, "component").where((F.col("r1") != F.col("first.r1")) | (F.col("r2") != F.col("first.r2")))).distinct()
    twice = common.saved(rows(known.groupBy("r1", "r2").count().where("count > 1")), "twice", 1)
    left = docs.withColumns(dict(zip(names, common.row_key(), strict=True))).join(gone.hint("shuffle_hash"), [*names], "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, [*names], "left_anti").unionByName(left.join(twice, [*names], "left_semi").dropDuplicates([*names]))
    return left.select(*docs.columns)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("class_id")
