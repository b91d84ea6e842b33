"""What happens to hits after scoring: decay, diversity, token budget."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..functions.fixedpoint import SCALE
from ..storage import materialised, tasks
from .bm25 import SMALL, small

_LEAST = np.iinfo(np.int64).min


def ranked(hits: DataFrame, score: str = "score_micros") -> DataFrame:
    """rank from 1 for each query: score, largest first, then id."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(score), "id")).cast("long"))


#: Hits that one task puts in order.
ORDERED = 1_000_000


def placed(hits: DataFrame, score: str = "score_micros") -> DataFrame:
    """ranked(), where all ranks are needed: no task gets all hits of a query.

    Hits are cut into ranges of their order, counted by range and query, and numbered within each from where those before end.
    """
    hits = materialised(hits, "unordered")
    n, columns = tasks(hits, hits.count(), ORDERED), hits.columns
    cut = materialised(hits.repartitionByRange(n, F.col("qid"), F.desc(score), F.col("id")).withColumn("__range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("__n").over(W.partitionBy("qid").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    start = cut.groupBy("qid", "__range").agg(F.count("*").alias("__n")).select("qid", "__range", before.alias("__before"))
    within = F.row_number().over(W.partitionBy("qid", "__range").orderBy(F.desc(score), "id"))
    return cut.withColumn("__within", within).join(small(start), ["qid", "__range"]).select(*columns, (F.col("__before") + F.col("__within")).alias("rank"))


def with_decay(hits: DataFrame, now: int, half_life: int = fx.HALF_LIFE, weight: int = fx.DECAY_WEIGHT) -> DataFrame:
    """Scores less the penalty of decayed confidence; hits carry confidence, last_used and created."""
    c = fx.decayed(F.coalesce("confidence", F.lit(fx.FULL).cast("long")), F.coalesce("last_used", "created"), F.lit(now).cast("long"), F.lit(half_life).cast("long"))
    return hits.withColumn("score_micros", F.col("score_micros") - fx.decay_penalty(c, F.lit(weight).cast("long")))


def _key(v: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v // 2, -(-v // 2))


class Picks:
    """Hits chosen so far, with an index from their terms to them: similarities of other hits to the nearest of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.holder = np.repeat(np.arange(len(sets)), self.size)[order]
        self.terms, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(flat)))

    def near(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The largest similarity, in micro-units, of each of some sets of terms, which follow one another in flat."""
        p = len(self.sets)
        if not p or not len(size):
            return np.zeros(len(size), np.int64)
        row = np.repeat(np.arange(len(size)), size)
        at = np.minimum(np.searchsorted(self.terms, flat), max(len(self.terms) - 1, 0))
        hit = self.terms[at] == flat if len(self.terms) else np.zeros(len(flat), bool)
        row, at = row[hit], at[hit]
        span = self.count[at]
        pick = self.holder[np.repeat(self.first[at] - (np.cumsum(span) - span), span) + np.arange(span.sum())]
        common = np.bincount(np.repeat(row, span) * p + pick, minlength=len(size) * p).reshape(len(size), p)
        union = size[:, None] + self.size[None, :] - common
        return (common * SCALE // np.maximum(union, 1)).max(1)


def greedy(rel: np.ndarray, near: np.ndarray, rank: np.ndarray, sets: list[np.ndarray], most: int, outside: tuple[int, int] | None = None) -> tuple[list[int], int | None]:
    """Places by maximal marginal relevance, `most` at most, of hits in the order of rank; earlier ones win ties.

    outside: (key, rank) that no hit elsewhere can be better than. Where the best here is not better than that, choosing stops, and
    the best's key is returned too: a hit's key only falls as others are chosen, so what was chosen is right.
    """
    n, near, left, out = len(rel), near.copy(), np.ones(len(rel), bool), []
    size, whole = np.array([len(x) for x in sets], np.int64), Picks(sets)
    for _ in range(min(n, most)):
        keys = np.where(left, _key(rel - near), _LEAST)
        best = int(keys.argmax())
        if outside is not None and (keys[best], -rank[best]) <= (outside[0], -outside[1]):
            return out, int(keys[best])
        left[best] = False
        out.append(best)
        at = np.searchsorted(whole.terms, sets[best])
        span = whole.count[at]
        other = whole.holder[np.repeat(whole.first[at] - (np.cumsum(span) - span), span) + np.arange(span.sum())]
        common = np.bincount(other, minlength=n)
        near = np.maximum(near, common * SCALE // np.maximum(size + size[best] - common, 1))
    # all are chosen: what comes next is elsewhere
    return out, (int(_LEAST) if outside is not None and len(out) < most else None)


def mmr_order(scores: list[int], sets: list[frozenset]) -> list[int]:
    """Places in the order of maximal marginal relevance; earlier ones win ties."""
    toward_zero = lambda a, b: a // b if a >= 0 else -(-a // b)
    top, names = max(1, *scores), {}
    rel = np.array([toward_zero(s * SCALE, top) for s in scores], np.int64)
    coded = [np.array(sorted(names.setdefault(t, len(names)) for t in x), np.int64) for x in sets]
    return greedy(rel, np.zeros(len(rel), np.int64), np.arange(len(rel)), coded, len(rel))[0]


#: Hits of a query that are compared with each other at a time; how far a key may lie below the last best before its hit is looked at, twice as far in each round.
WINDOW, SLACK = 512, 25_000
#: Picks that are held at a time: so many queries are ordered together that they have no more.
HELD = 20_000
_SETS = "qid {0}, id string, rank long, rel long, bound long, terms array<long>"


def diversified(hits: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """hits (qid, id, score_micros, rank), terms (id, terms) -> the first k of each query by maximal marginal relevance, ranked anew.

    In rounds, lazily. A hit's relevance bounds its key, and falls only when something like it is chosen. A round takes those whose
    relevance reaches a threshold, compares them with all that is chosen already where they lie, and brings the best WINDOW of each
    query together, which are chosen from while none elsewhere can be better. Then the threshold falls. So no task gets more than a
    window, copies of what is chosen drop out before that, and hits far down are never looked at. Work grows with k; for k as large as
    all hits it is the square of their number. Terms are compared by hashes of 64 bits.
    """
    kind = dict(hits.dtypes)["qid"]
    rows = hits.select("qid", "id", "score_micros", "rank").join(terms.select("id", F.transform("terms", lambda t: F.xxhash64(t)).alias("terms")), "id", "left")
    rel = F.expr(f"cast(score_micros as decimal(38,0)) * {SCALE} div greatest(top, 1)").cast("long")
    tops = hits.groupBy("qid").agg(F.max("score_micros").alias("top"), F.count("*").alias("n"))
    sets = rows.join(tops.select("qid", "top"), "qid").select("qid", "id", "rank", rel.alias("rel"), F.coalesce(F.array_sort("terms"), F.array().cast("array<bigint>")).alias("terms"))
    sets = materialised(sets, "sets")
    lowest = {r.qid: int(_key(np.int64(r.low))) for r in sets.groupBy("qid").agg(F.min("rel").alias("low")).orderBy("qid").collect()}
    queries, each, out, spark = list(lowest), max(1, HELD // max(k, 1)), [], hits.sparkSession
    for i in range(0, len(queries), each):
        block = {q: lowest[q] for q in queries[i : i + each]}
        part = sets if len(queries) <= each else sets.where(F.col("qid").isin(list(block)))
        out += _chosen(part, block, k, kind)
    order = spark.createDataFrame(out, f"qid {kind}, id string, rank long")
    return hits.drop("rank").join(F.broadcast(order) if len(out) <= SMALL else order, ["qid", "id"])


def _chosen(sets: DataFrame, queries: dict, k: int, kind: str) -> list[tuple]:
    """(qid, id, rank) of the first k of each query; queries: the lowest key of relevance of each."""
    picked = {q: ([], []) for q in queries}  # ids and their terms
    below: dict = dict.fromkeys(queries)  # the threshold of each query that has more to choose; None: by rank alone
    slack = SLACK
    while below:
        state = {q: (t, set(picked[q][0]), Picks(picked[q][1]), k - len(picked[q][0]), queries[q]) for q, t in below.items()}
        for q, ids, terms, stopped in _round(sets, state, kind):
            picked[q][0].extend(ids)
            picked[q][1].extend(terms)
            if len(picked[q][0]) >= k or stopped is None:
                del below[q]
            else:
                below[q] = max(stopped - slack, queries[q])
            state.pop(q)
        for q in state:  # nothing was left of these at their threshold
            if below[q] is None or below[q] <= queries[q]:
                del below[q]
            else:
                below[q] = max(below[q] - slack, queries[q])
        slack *= 2
    return [(q, id_, n) for q, (ids, _) in picked.items() for n, id_ in enumerate(ids, 1)]


def _round(sets: DataFrame, state: dict, kind: str):
    """state: of each query the threshold, the ids chosen, their Picks, how many are wanted, and the lowest key -> (qid, ids, terms, key at which it stopped) of each that had hits."""

    def bounds(batches):
        for b in batches:
            if not b.num_rows:
                continue
            qid, ids, rel = (b.column(i).to_pylist() for i in (0, 1, 3))
            rel, rank = np.array(rel, np.int64), b.column(2).to_numpy()
            keep, near = np.zeros(len(rel), bool), np.zeros(len(rel), np.int64)
            of: dict = {}
            for i, q in enumerate(qid):
                if q in state:
                    of.setdefault(q, []).append(i)
            for q, at in of.items():
                threshold, gone, picks, _, _ = state[q]
                at = np.array(at, np.int64)
                fits = rank[at] <= WINDOW + 1 if threshold is None else _key(rel[at]) >= threshold
                at = at[fits & np.array([ids[i] not in gone for i in at], bool)]
                some = b.column(4).take(pa.array(at))
                step = max(1, (1 << 20) // max(len(picks.sets), 1))
                for lo in range(0, len(at), step):
                    part = some.slice(lo, step)
                    near[at[lo : lo + step]] = picks.near(part.flatten().to_numpy(), np.asarray(part.value_lengths(), np.int64))
                keep[at] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(rel - near), b.column(4)], names=["qid", "id", "rank", "rel", "bound", "terms"]).filter(pa.array(keep))

    def choose(group: pa.Table) -> pa.Table:
        q = group["qid"][0].as_py()
        threshold, _, _, wanted, lowest = state[q]
        outside = [] if threshold is None or threshold <= lowest else [(threshold - 1, -1)]
        order = np.lexsort((group["rank"].to_numpy(), -_key(group["bound"].to_numpy())))
        if len(order) > WINDOW:
            last = int(order[WINDOW])
            outside.append((int(_key(group["bound"].to_numpy())[last]), group["rank"][last].as_py()))
        inside = order[:WINDOW]
        inside = inside[np.argsort(group["rank"].to_numpy()[inside])]
        g = group.take(pa.array(inside)).combine_chunks()
        rel, bound, rank = (g[c].to_numpy() for c in ("rel", "bound", "rank"))
        terms = [np.array(t, np.int64) for t in g["terms"].to_pylist()]
        places, stopped = greedy(rel, rel - bound, rank, terms, wanted, max(outside, key=lambda x: (x[0], -x[1])) if outside else None)
        if stopped == _LEAST:  # all here are chosen
            stopped = max(x[0] for x in outside)
        return pa.table({"qid": pa.array([q], group["qid"].type), "ids": pa.array([[g["id"][p].as_py() for p in places]], pa.list_(pa.string())), "terms": pa.array([[terms[p] for p in places]], pa.list_(pa.list_(pa.int64()))), "stopped": pa.array([stopped], pa.int64())})

    rows = sets.where(F.col("qid").isin(list(state)))
    if all(s[0] is None for s in state.values()):
        rows = rows.where(F.col("rank") <= WINDOW + 1)
    else:
        lowest = min(s[0] for s in state.values())
        rows = rows.where(F.col("rel") >= 2 * lowest - 2)
    key = F.expr("bound div 2")
    best = rows.select("qid", "id", "rank", "rel", "terms").mapInArrow(bounds, _SETS.format(kind)).withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(key), "rank"))).where(F.col("n") <= WINDOW + 1)
    got = best.drop("n").groupBy("qid").applyInArrow(choose, f"qid {kind}, ids array<string>, terms array<array<long>>, stopped long")
    return [(r.qid, r.ids, [np.array(t, np.int64) for t in r.terms], r.stopped) for r in got.collect()]


def packed(hits: DataFrame, k: int = 10, budget: int | None = None, cost: Column | None = None) -> DataFrame:
    """The first k hits of each query by rank; with a budget, hits that would pass it are skipped, never the first.

    With a budget, each batch of hits first drops, where it lies, those that can't be kept; what is left of a query goes to one
    task, sorted, and streams through a fold that holds the sum and number kept so far. Costs are not negative; a null one is none.
    """
    if budget is None:
        return hits.where(F.col("rank") <= k)
    names = hits.columns
    qid, rank = names.index("qid"), names.index("rank")
    priced = hits.withColumn("__cost", F.coalesce(cost, F.lit(0)).cast("long"))

    def pruned(batches):
        for b in batches:
            yield b.filter(pa.array(hopeful(b.column(qid).to_pylist(), b.column(rank).to_pylist(), b.column(len(names)).to_pylist(), k, budget), pa.bool_()))

    def fold(batches):
        state = None  # query, sum and number kept
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (q, c) in enumerate(zip(b.column(qid).to_pylist(), b.column(len(names)).to_pylist(), strict=True)):
                if state is None or state[0] != q:
                    state = (q, 0, 0)
                _, spent, n = state
                if n < k and (not n or spent + c <= budget):
                    keep[i], state = True, (q, spent + c, n + 1)
            yield b.select(names).filter(pa.array(keep))

    return priced.mapInArrow(pruned, priced.schema).repartition("qid").sortWithinPartitions("qid", "rank").mapInArrow(fold, hits.schema)


def hopeful(qid: list, rank: list[int], cost: list[int], k: int, budget: int) -> list[bool]:
    """Of some hits of each query, in any order, whether they may be among those that packing keeps of all its hits.

    The sum kept only grows, so after a hit that is not kept no later one that costs as much is. A hit is kept only if all those
    before it that cost as much or less are: so with them it is one of k at most, and within the budget. The first always stays.
    """
    keep, state = [False] * len(qid), {}
    for i in sorted(range(len(qid)), key=rank.__getitem__):
        c, seen = cost[i], state.get(qid[i])
        if seen is None:
            keep[i], state[qid[i]] = True, [float("inf"), [c]]  # costs from which none is kept; lesser costs of hits that may be
        elif c < seen[0]:
            at = bisect.bisect_right(seen[1], c)
            if at < k and sum(seen[1][:at]) + c <= budget:
                keep[i] = True
                seen[1].insert(at, c)
            else:
                seen[0] = c
                del seen[1][bisect.bisect_left(seen[1], c) :]
    return keep
