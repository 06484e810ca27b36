"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import mixing, tool_calls, toxicity
from spanloom.llm.ann import nearest
from spanloom.llm.common import table
from spanloom.llm.decontaminate import contaminated
from spanloom.llm.html_extract import extract
from spanloom.llm.licenses import scan_licenses
from spanloom.llm.lm_score import lm_scores
from spanloom.llm.mixing import mix
from spanloom.llm.near_dup import near_duplicates
from spanloom.llm.token_counts import token_counts


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(table(spark, sf_dir, "conversations"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.toxicity(docs, lexicon)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_learned_partitions_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_benchmark_decontamination,
        op3_source_mixing,
        op4_minhash_near_dedup,
        op5_lm_scoring,
        op6_tool_call_linking,
        op7_toxicity,
        op8_license_scan,
        op9_token_counts,
        op10_learned_partitions_ann,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_tool_call_linking": tool_calls.SQL,
    "op3_source_mixing": f"with docs as (select doc_id, source, text from documents), {mixing.SQL} select doc_id, source, size, source_size, target, taken from mixed",
}
