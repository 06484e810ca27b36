"""Corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents that hold benchmark
passages go, and what is left is mixed to target weights.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  Empty tables pass through as
empty tables; nulls are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import toxicity
from spanloom.llm.common import settle, table
from spanloom.llm.decontaminate import drop_contaminated
from spanloom.llm.mixing import mix
from spanloom.llm.near_dup import drop_near_duplicates


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't predict toxic; the lexicon is learned from the labelled documents."""
    return toxicity.drop_toxic(docs, toxicity.learn(toxicity.labelled(docs, table(spark, sf_dir, "labels"))))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of the documents of which the mix takes words."""
    return mix(docs).where("taken > 0")


STAGES = [("toxicity", reject_toxic), ("near_dedup", dedup), ("decontamination", decontaminate), ("mixing", mix_sources)]

#: The stages' own rules (a learned lexicon, signatures, seeds) have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
