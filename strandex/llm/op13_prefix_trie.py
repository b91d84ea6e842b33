"""The trie of conversations' beginnings, from the longest common prefixes of neighbours in a global sort.

Each turn is a code of fixed width (a hash of 128 bits of role and text, and its number of words), a conversation the string of
its turns' codes. Equal conversations become one row, which knows its conversations' number and the hash of their ids. Distinct
strings are sorted over all partitions; the turns that two neighbours share are the intervals' depths, and a stack swept along
a partition closes a node when the common prefix falls below it: all of its members have been seen then.

What is open at a partition's ends is stitched: nodes on the path of the first or the last string of a partition are fragments, as
many as these two have turns, and one more sweep, of fragments instead of strings, in the order of the partitions, merges those of
one node. Nodes whose parent is a fragment get its id after that, by a join on (partition, fragment).

Hashes of a node's ids are sequential by nature: a group of equal conversations streams through one task, ids only, none kept.

Defined cases: rows without conv_id belong to no conversation; a null role or text is empty; a null turn comes first, turns of one
number follow their hashes, repeated rows are turns of their own; an empty table gives no nodes; extra columns are ignored.
A conversation's codes are one value: 40 bytes a turn.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of a turn's code: those of its hash, and of its number of words.
HASH, COUNT = 32, 8
WIDTH = HASH + COUNT
NOTHING = hashlib.sha256(b"").hexdigest()
#: Conversations with one base take their first turns from it: parameters of the query.
EVERY, HEADS = 20, 4
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A node as swept: parent is the fragment that has its parent's id, where that is one; fragment is its own number, if it is one.
SWEPT = NODE + ", parent long, fragment long, words long, key string"
_NAMES = [x.split()[0] for x in SWEPT.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in SWEPT.split(", ")]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, code) of each turn."""
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return c.select("conv_id", "turn", F.concat(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")), F.lpad(F.hex(words), COUNT, "0")).alias("code"))


def _codes(t: Column) -> Column:
    return F.array_join(F.transform(t, lambda x: x.code), "")


def _ordered() -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), "turn", "code")))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, key): the codes of a conversation's turns in their order."""
    return turns(conversations).groupBy("conv_id").agg(_codes(_ordered()).alias("key"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key) where conversation c begins with the first crc32(c) % HEADS turns of c - c % EVERY instead of its own. One shuffle."""
    rows = turns(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).repartition("base")
    whole = rows.groupBy("base", "conv_id").agg(_ordered().alias("turns"))
    heads = whole.where("conv_id = base").select("base", F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    none = F.slice("turns", 1, 0)
    begin = F.coalesce(F.slice("head", 1, h), none)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return whole.join(heads, "base", "left").select("conv_id", _codes(F.concat(begin, rest)).alias("key"))


def classes(seqs: DataFrame) -> DataFrame:
    """(conv_id, key) -> (key, conv_id, n, sha): each distinct key with its smallest id, their number, and the hash of all in order."""

    def run(batches):
        key, first, n, sha = None, 0, 0, None
        for b in batches:
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, i = [], 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != key:
                    if key is not None:
                        out.append((key, first, n, sha.hexdigest()))
                    key, first, n, sha = keys[i], ids[i], 0, hashlib.sha256()
                sha.update(((("," if n else "") + ",".join(map(str, ids[i:j])))).encode())
                n += j - i
                i = j
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "conv_id", "n", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, first, n, sha.hexdigest())], names=["key", "conv_id", "n", "sha"])

    return seqs.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key string, conv_id long, n long, sha string")


class Open:
    """A node that may still get members: what it has so far, without its open child's."""

    __slots__ = ("children", "conv", "kids", "leaves", "n", "of", "saved", "sha", "words")

    def __init__(self, words: int):
        self.conv, self.n, self.children, self.leaves, self.saved, self.words, self.sha = None, 0, 0, 0, 0, words, NOTHING
        self.kids: list[int] = []  # rows that get this node's id as their parent's
        self.of: list[int] = []  # fragments that it is made of

    def holds(self, conv: int | None, n: int) -> None:
        if conv is not None:
            self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n


class Nodes:
    """Closed nodes, column by column."""

    def __init__(self):
        self.at = [array("q") for _ in range(7)]  # conv, depth, parent's conv, n, children, leaves, saved
        self.sha: list[str] = []

    def close(self, node: Open, depth: int, parent: Open | None) -> int:
        """The node's row; its members, leaves and tokens count for the parent."""
        saved, leaves = node.saved + (node.n - 1) * node.words, node.leaves if node.children else 1
        for a, v in zip(self.at, (node.conv, depth, -1, node.n, node.children, leaves, saved), strict=True):
            a.append(v)
        self.sha.append(node.sha)
        row = len(self.sha) - 1
        for k in node.kids:
            self.at[2][k] = node.conv
        if parent is not None:
            parent.holds(node.conv, node.n)
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
            parent.kids.append(row)
        return row


def shared(a: str, b: str) -> int:
    """Turns that two keys have in common at their beginning."""
    n, i = min(len(a), len(b)), 0
    while i < n and a[i : i + WIDTH] == b[i : i + WIDTH]:
        i += WIDTH
    return i // WIDTH


def _words(key: str, depth: int) -> int:
    return int(key[depth * WIDTH - COUNT : depth * WIDTH], 16) if depth else 0


def _table(nodes: Nodes, parent: list, known: bool) -> pa.RecordBatch:
    """parent: of each row, the fragment that has its parent's id, or None; known: the rows without one have their parent's id."""
    c = [pa.array(a, pa.int64()) for a in nodes.at]
    above = pa.array([v if p is None and known else None for v, p in zip(nodes.at[2], parent, strict=True)], pa.int64())
    n = len(parent)
    return pa.RecordBatch.from_arrays([c[0], c[1], above, *c[3:], pa.array(nodes.sha, pa.string()), pa.array(parent, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=_NAMES)


def swept(distinct: DataFrame) -> DataFrame:
    """(key, conv_id, n, sha) of distinct keys -> SWEPT: closed nodes of each partition, and its fragments.

    A partition's nodes are held until it ends, as numbers; a fragment's number is its partition's, times 2**32, plus its own.
    """

    def run(batches):
        part, nodes, stack, first, key, left = 0, Nodes(), [Open(0)], None, None, []
        on_first = 0  # so many of the stack's nodes are on the first key's path
        for b in batches:
            part = b.column(4)[0].as_py() << 32 if b.num_rows else part
            for text, conv, n, sha in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                size = len(text) // WIDTH
                if key is None:
                    first = text
                keep = shared(key, text) if key is not None else 0
                while len(stack) > keep + 1:
                    node = stack.pop()
                    if len(stack) < on_first:
                        left.append((node, len(stack)))
                    else:
                        nodes.close(node, len(stack), stack[-1])
                on_first = min(on_first, keep + 1) if key is not None else size + 1
                for d in range(len(stack), size + 1):
                    stack.append(Open(_words(text, d)))
                stack[size].holds(conv, n)
                stack[size].sha = sha
                key = text
        if key is None:
            return
        pieces = [*reversed(left), *((x, d) for d, x in enumerate(stack))]
        parent: list = [None] * len(nodes.sha)
        for i, (x, _) in enumerate(pieces):
            for k in x.kids:
                parent[k] = part + i
        if nodes.sha:
            yield _table(nodes, parent, True)
        ends = {0: first, len(pieces) - 1: key}  # one piece: both are the empty key
        rows = [(x.conv, d, None, x.n, x.children, x.leaves, x.saved, x.sha, None, part + i, x.words, ends.get(i)) for i, (x, d) in enumerate(pieces)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    # the partition's own number: a task may be given several of them, one after the other
    return distinct.repartitionByRange("key").sortWithinPartitions("key").select("key", "conv_id", "n", "sha", F.spark_partition_id().alias("part")).mapInArrow(run, SWEPT)


def stitched(fragments: DataFrame) -> DataFrame:
    """The fragments of SWEPT -> nodes, as SWEPT, and for each fragment a row (fragment, conv_id) of the node it belongs to.

    One task: it reads as many rows as the first and the last key of each partition have turns, however long the input is.
    """

    def run(batches):
        nodes, stack, known, before = Nodes(), [], [], None

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                node = stack.pop()
                nodes.close(node, len(stack), stack[-1] if stack else None)
                known.extend((f, node.conv) for f in node.of)

        for pieces in _by_partition(batches):
            first, last = pieces[0][-1], pieces[-1][-1]
            root = next(i for i, p in enumerate(pieces) if p[1] == 0)
            fresh, path = pieces[:root], pieces[root:]  # on the first key's path alone; on the last key's
            common_to = fresh[0][1] if fresh else len(first) // WIDTH + 1  # nodes of both paths, from the root
            keep = shared(before, first) + 1 if before is not None else 0
            close(keep)
            for d, p in enumerate([*path[:common_to], *fresh]):
                if d >= keep:
                    stack.append(Open(p[6]))
                _merge(stack[d], p)
            close(common_to)
            for p in path[common_to:]:
                stack.append(Open(p[6]))
                _merge(stack[-1], p)
            before = last
        if not stack:
            return
        close(0)
        out = _table(nodes, [None] * len(nodes.sha), True)
        above = pa.array([*out.column(2).to_pylist()[:-1], None], pa.int64())  # the root closes last and has no parent
        yield pa.RecordBatch.from_arrays([above if i == 2 else c for i, c in enumerate(out.columns)], names=_NAMES)
        n = len(known)
        fill = {"conv_id": pa.array([c for _, c in known], pa.int64()), "fragment": pa.array([f for f, _ in known], pa.int64())}
        yield pa.RecordBatch.from_arrays([fill.get(name, pa.nulls(n, t)) for name, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)

    return fragments.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "ends_sha256", "fragment", "key").coalesce(1).sortWithinPartitions("fragment").mapInArrow(run, SWEPT)


def _by_partition(batches):
    """The fragments of each partition in turn."""
    held: list = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[8] >> 32 != held[0][8] >> 32:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _merge(node: Open, piece: tuple) -> None:
    conv, _, n, children, leaves, saved, _, sha, fragment, _ = piece
    node.holds(conv, n)
    node.children += children
    node.leaves += leaves
    node.saved += saved
    node.sha = sha if sha != NOTHING else node.sha
    node.of.append(fragment)


def trie(seqs: DataFrame) -> DataFrame:
    """(conv_id, key) -> NODE."""
    distinct = common.saved(classes(seqs), "classes")
    parts = common.saved(swept(distinct), "swept")
    ends = common.saved(stitched(parts.where("fragment is not null")), "stitched", 1)
    common.used_up(distinct)
    node = [x.split()[0] for x in NODE.split(", ")]
    inner = parts.where("fragment is null and parent is null").select(*node)
    of = ends.where("fragment is not null").select(F.col("fragment").alias("parent"), F.col("conv_id").alias("above"))
    below = parts.where("fragment is null and parent is not null").join(of, "parent").select(*(F.col("above").alias(c) if c == "parent_conv_id" else F.col(c) for c in node))
    return inner.unionByName(below).unionByName(ends.where("fragment is null").select(*node))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> NODE of each distinct beginning, from the root."""
    return trie(sequences(conversations))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(common.table(spark, sf_dir, "conversations")))
