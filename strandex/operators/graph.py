"""The link graph: undirected edges, personalized PageRank in fixed point, and the strongest seed beside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixedpoint as fx
from ..storage import materialised
from .bm25 import small

# Rounds, and the mass from which a document counts as reached.
ROUNDS, FLOOR = 30, fx.SCALE // 50
#: Rounds between two cuts of the lineage. It divides ROUNDS, so equal masses at two cuts are the masses after ROUNDS.
STEP = 5


def edges(docs: DataFrame) -> DataFrame:
    """(src, dst), both ways, each once; only between documents that exist; a link to itself stays one edge."""
    links = docs.select(F.col("id").alias("src"), F.explode("links").alias("dst")).join(docs.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def personalized_pagerank(edge: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """seeds (qid, id, weight) -> (qid, id, mass): half of the mass restarts at the seeds, half walks; integer division at each step."""
    p = seeds.where("weight > 0").join(seeds.where("weight > 0").groupBy("qid").agg(F.sum("weight").alias("total")), "qid")
    p = materialised(p.select("qid", "id", fx.div(F.col("weight").cast("decimal(19,0)") * fx.SCALE, F.col("total")).alias("mass")), "restart")
    out = small(materialised(edge.join(edge.groupBy("src").agg(F.count("*").alias("deg")), "src"), "walk"))
    restart = p.select("qid", "id", fx.div("mass", 2).alias("mass"))
    r, before = p, None
    for k in range(0, rounds, STEP):
        for _ in range(min(STEP, rounds - k)):
            share = r.join(out, r.id == out.src).select("qid", F.col("dst").alias("id"), fx.div(fx.div("mass", 2), "deg").alias("mass")).where("mass > 0")
            r = restart.unionByName(share).groupBy("qid", "id").agg(F.sum("mass").alias("mass"))
        r = materialised(r, "mass")
        now = r.agg(F.count("*"), F.sum("mass"), F.sum(F.xxhash64("qid", "id", "mass").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return r


def strongest_seed(edge: DataFrame, reached: DataFrame, seeds: DataFrame) -> DataFrame:
    """reached (qid, id) -> (qid, id, via): the neighbour with the largest seed weight, then the smallest id; none without such."""
    near = reached.join(edge, reached.id == edge.src).select("qid", "id", F.col("dst").alias("n"))
    rows = near.join(seeds.select("qid", F.col("id").alias("n"), "weight").where("weight > 0"), ["qid", "n"])
    return rows.groupBy("qid", "id").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("n"))).alias("b")).select("qid", "id", F.col("b.n").alias("via"))
