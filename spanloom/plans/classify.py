"""Classification of all episodes as one plan: windows, replies, ladder, gates, one retry in half windows, record.

segments: (episode, idx, start, end, text, words); times in milliseconds.  The retry is a filter, a second pass and a
union; nothing is looped or collected.  What several later steps read (replies, spans, states) is settled once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import constants as C
from spanloom.operators.chunking import plan_chunks, prompts, with_context
from spanloom.operators.gates import episode_gates, flag_strings, flags, span_stats
from spanloom.operators.ladder import capped, run_pass
from spanloom.operators.propose import RuleProposer
from spanloom.operators.refine import refine_starts
from spanloom.store import settle

Extension = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Result:
    """episodes: status, statistics, flags; spans: trusted spans; rejections; chunks: the call log, passes 1 and 2."""

    episodes: DataFrame
    spans: DataFrame
    rejections: DataFrame
    chunks: DataFrame


def effective_version(version: str, suffixes: tuple[str, ...] = ()) -> str:
    return "+".join((version, *suffixes))


def _one_pass(segments: DataFrame, proposer: object, max_tokens: int, context: int, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = settle(plan_chunks(segments.select("episode", "idx", "text"), max_tokens, context))
    if isinstance(proposer, RuleProposer):
        replies = proposer.reply(with_context(chunks, segments, context))
    else:
        replies = proposer.reply(prompts(chunks, segments, context).withColumn("key", F.sha2("prompt", 256)))
    replies = settle(replies.select("episode", "chunk", "obj", "error"))
    log = chunks.join(replies.select("episode", "chunk", "error"), ["episode", "chunk"], "left").withColumn("pass", F.lit(number))
    spans, rejected = run_pass(segments, chunks, replies.where("obj is not null").select("episode", "chunk", "obj"))
    return settle(spans), rejected.withColumn("pass", F.lit(number)), log


def classify(segments: DataFrame, proposer: object, max_tokens: int = 6000, context: int = C.CONTEXT_SEGMENTS, extension: Extension | None = None) -> Result:
    """Statuses: no_transcript can't occur here (an episode without segments has no rows); failed where every call of an
    episode failed and nothing was found; else what the gates say, after the second pass where the first over-labels."""
    small = segments.groupBy("episode").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < C.MIN_SEGMENTS).select("episode")
    live = segments.join(small, "episode", "left_anti")
    first, rejected, log = _one_pass(live, proposer, max_tokens, context, 1)
    gated = episode_gates(live, first)
    again = settle(gated.where("status = 'rejected_overlabel'").select("episode"))
    second, rejected2, log2 = _one_pass(live.join(again, "episode", "left_semi"), proposer, max(200, max_tokens // 2), context, 2)
    spans = first.join(again, "episode", "left_anti").unionByName(second)
    rejected, log = rejected.unionByName(rejected2), log.unionByName(log2)
    gated = episode_gates(segments, spans)
    calls = log.groupBy("episode").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("incomplete_chunks"))
    found = spans.select("episode").distinct().withColumn("any", F.lit(True))
    gated = gated.join(calls, "episode", "left").join(found, "episode", "left")
    gated = gated.withColumn("status", F.when((F.col("calls") > 0) & (F.col("calls") == F.col("incomplete_chunks")) & F.col("any").isNull(), "failed").otherwise(F.col("status")))
    gated = settle(gated)
    spans = refine_starts(spans.join(gated.where("status = 'ok'").select("episode"), "episode", "left_semi"), segments)
    if extension is not None:
        spans = extension(spans)
    spans = settle(spans)
    flagged = flags(segments.select("episode", "idx", "start", "end"), spans)
    ok = gated.select("episode", "status", F.coalesce("incomplete_chunks", F.lit(0)).alias("incomplete_chunks"))
    text = flag_strings(flagged)
    stats = span_stats(flagged, spans)
    episodes = ok.join(stats, "episode").join(text, "episode").withColumn("flags", F.when(F.col("status") == "ok", F.col("flags")).otherwise(""))
    return Result(episodes, spans, capped(rejected), log)


def dry_run(segments: DataFrame, max_tokens: int = 6000, context: int = C.CONTEXT_SEGMENTS, price_in: float = 3.0, price_out: float = 15.0, reply_tokens: int = 400) -> DataFrame:
    """Chunks, prompt tokens and cost of each episode, without a call."""
    p = prompts(plan_chunks(segments.select("episode", "idx", "text"), max_tokens, context), segments, context)
    by = p.groupBy("episode").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.floor(F.length("prompt") / 4)).alias("prompt_tokens"))
    return by.withColumn("cost", (F.col("prompt_tokens") * price_in + F.col("chunks") * reply_tokens * price_out) / 1_000_000)
