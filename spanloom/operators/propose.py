"""Proposers: who answers a window's prompt.  All give (episode, chunk, obj, error, meta...) from requests (episode,
chunk, key, ...); a null obj is a failed call.

RuleProposer writes replies by column expressions, ReplayProposer looks recorded ones up by key, CallProposer calls a
function for each request inside Arrow batches (for services; at most ``tries`` attempts, one after the other in a
task, so the number of tasks bounds the calls in flight).  Loggers and recorders are plain functions of the replies.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.sinks.records import latest


class Proposer(Protocol):
    def reply(self, requests: DataFrame) -> DataFrame: ...


class RuleProposer:
    """Spans of segments that a condition marks, as replies; one span a segment, merged later by the ladder."""

    def __init__(self, condition: Column, kind: Column | None = None, confidence: Column | None = None) -> None:
        self.condition, self.kind, self.confidence = condition, F.lit("midroll") if kind is None else kind, F.lit(0.9) if confidence is None else confidence

    def reply(self, shown: DataFrame) -> DataFrame:
        """shown: segments of each window (episode, chunk, idx, text, is_context)."""
        evidence = F.array_join(F.slice(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), 1, 8), " ")
        span = F.when(self.condition & ~F.col("is_context"), F.struct(F.col("idx").alias("start_index"), F.col("idx").alias("end_index"), self.kind.alias("kind"), self.confidence.alias("confidence"), evidence.alias("evidence"), F.lit("").alias("end_evidence")))
        by = shown.groupBy("episode", "chunk").agg(F.array_sort(F.collect_list(span)).alias("ad_spans"))
        return by.select("episode", "chunk", F.to_json(F.struct("ad_spans")).alias("obj"), F.lit(None).cast("string").alias("error"))


class ReplayProposer:
    def __init__(self, responses: DataFrame) -> None:
        self.responses = responses

    def reply(self, requests: DataFrame) -> DataFrame:
        out = requests.join(self.responses.select("key", "obj"), "key", "left")
        return out.withColumn("error", F.when(F.col("obj").isNull(), "no recorded reply"))


class CallProposer:
    def __init__(self, call: Callable[[str], str], tries: int = 4, wait: float = 1.0) -> None:
        self.call, self.tries, self.wait = call, tries, wait

    def reply(self, requests: DataFrame) -> DataFrame:
        call, tries, wait = self.call, self.tries, self.wait

        def one(prompt: str) -> tuple[str | None, str | None]:
            for k in range(tries):
                try:
                    return call(prompt), None
                except Exception as e:  # noqa: BLE001
                    said = str(e)[:400]
                    time.sleep(wait * 2**k if k + 1 < tries else 0)
            return None, said

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [one(p) for p in b.prompt]
                yield pd.DataFrame({"episode": b.episode.astype(str), "chunk": b.chunk, "obj": [f[0] for f in found], "error": [f[1] for f in found]})

        out = requests.select(F.col("episode").cast("string").alias("episode"), "chunk", "prompt").mapInPandas(run, "episode string, chunk int, obj string, error string")
        kind = dict(requests.dtypes)["episode"]
        return out.withColumn("episode", F.col("episode").cast(kind))


def record_replies(old: DataFrame, replies: DataFrame) -> DataFrame:
    """The store of replies with new ones added; the last of a key stays."""
    return latest(old.withColumn("_new", F.lit(0)).unionByName(replies.withColumn("_new", F.lit(1)), allowMissingColumns=True), ["key"], ["_new"]).drop("_new")


#: Model prices (a million tokens in, out), windows and aliases: a dimension table.
CAPABILITIES = (("small", 0.15, 0.60, 128_000), ("medium", 1.0, 5.0, 200_000), ("large", 3.0, 15.0, 200_000))
ALIASES = (("mini", "small"), ("base", "medium"))


def with_capabilities(runs: DataFrame) -> DataFrame:
    """``runs`` (model) with prices and window of the model or its alias; null where neither is known."""
    spark = runs.sparkSession
    alias = spark.createDataFrame(ALIASES, "model string, canonical string")
    table = spark.createDataFrame(CAPABILITIES, "canonical string, price_in double, price_out double, window int")
    return runs.join(F.broadcast(alias), "model", "left").withColumn("canonical", F.coalesce("canonical", "model")).join(F.broadcast(table), "canonical", "left")
