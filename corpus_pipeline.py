"""From raw documents to packed training sequences.

Five stages, each one of the corpus operators. Every stage works on all that the one before kept; all but the last return the
columns of documents:

toxicity: documents predicted toxic go. line_dedup: later copies of repeated line runs of 50 words or more go, and documents of
which no line is left. ngram_join: of every group of near duplicates the document with the smallest id stays. decontamination:
documents that hold a benchmark item go. packing: what is left, in sequences.

Defined cases are those of the operators; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandex.llm import common, op04_decontaminate, op06_line_dedup, op08_ngram_join, op09_packing, op10_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents that it is given."""
    return op10_toxicity.harmless(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_line_dedup.dedup_lines(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op04_decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_packing.packed(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]

#: No SQL expresses the learned grades, the tokens or the packing: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not packing:
            docs = common.saved(docs, f"pipeline-{name}")
    return docs
