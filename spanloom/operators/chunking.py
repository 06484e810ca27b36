"""Windows over an episode's segments: a greedy planner with a token budget, and read-only context around each window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import constants as C
from spanloom.functions.text import token_estimate


def plan_chunks(segments: DataFrame, max_tokens: int, context: int = C.CONTEXT_SEGMENTS) -> DataFrame:
    """(episode, chunk, a, b, est_tokens): half-open windows [a, b) that tile each episode's segments (idx, text).

    A window closes once it has 3 * context segments and the next would pass the budget, unless under ``context``
    segments are left, which then join the last window.  est_tokens leaves such a joined tail out.  The plan is a fold
    over one array of costs an episode, so an episode is one row and never a window of its own.
    """
    costs = segments.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("idx", token_estimate("text").cast("long").alias("cost")))).alias("xs"))
    costs = costs.select("episode", F.transform("xs", lambda x: x["cost"]).alias("costs"))
    least = 3 * context
    costs = costs.withColumn("n", F.size("costs")).withColumn("total", F.aggregate("costs", F.lit(0).cast("long"), lambda a, x: a + x))
    costs = costs.withColumn("budget", F.greatest(F.lit(8 * least).cast("long"), F.lit(max_tokens) - 2 * context * (F.floor(F.col("total") / F.col("n")) + 1)))
    start = "named_struct('a', 0, 'used', 0L, 'cuts', array(0), 'used_by', cast(array() as array<bigint>))"
    step = (
        f"if(i - acc.a >= {least} and acc.used + costs[i] > budget and n - i >= {context}, "
        "named_struct('a', i, 'used', costs[i], 'cuts', concat(acc.cuts, array(i)), 'used_by', concat(acc.used_by, array(acc.used))), "
        # A tail too short for a window of its own is not counted.
        f"named_struct('a', acc.a, 'used', if(i - acc.a >= {least} and acc.used + costs[i] > budget, acc.used, acc.used + costs[i]), 'cuts', acc.cuts, 'used_by', acc.used_by))"
    )
    plan = costs.withColumn("plan", F.expr(f"aggregate(sequence(0, n - 1), {start}, (acc, i) -> {step})"))
    plan = plan.select("episode", "n", F.col("plan.cuts").alias("cuts"), F.concat(F.col("plan.used_by"), F.array("plan.used")).alias("used"))
    plan = plan.select("episode", "n", "cuts", F.posexplode("used").alias("chunk", "est_tokens"))
    return plan.select("episode", "chunk", F.col("cuts")[F.col("chunk")].alias("a"), F.coalesce(F.get("cuts", F.col("chunk") + 1), F.col("n")).alias("b"), "est_tokens")


def with_context(chunks: DataFrame, segments: DataFrame, context: int = C.CONTEXT_SEGMENTS) -> DataFrame:
    """Segments that each window shows, with is_context for those around it: an index equi-join, no range join."""
    shown = chunks.select("episode", "chunk", "a", "b", F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - context), F.col("b") + context - 1)).alias("idx"))
    return shown.join(segments, ["episode", "idx"]).withColumn("is_context", (F.col("idx") < F.col("a")) | (F.col("idx") >= F.col("b")))


def prompt_lines(shown: DataFrame) -> DataFrame:
    """``[CONTEXT] idx<TAB>seconds<TAB>text`` for each shown segment (start in milliseconds)."""
    text = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n", "  "))
    tenths = F.floor((F.col("start") + 50) / 100)
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    mark = F.when(F.col("is_context"), "[CONTEXT] ").otherwise("")
    return shown.withColumn("line", F.concat(mark, F.col("idx").cast("string"), F.lit("\t"), seconds, F.lit("\t"), text))


def prompts(chunks: DataFrame, segments: DataFrame, context: int = C.CONTEXT_SEGMENTS, tail: str = "\n\nReturn the spans as JSON.") -> DataFrame:
    """(episode, chunk, prompt): header, lines in order, tail."""
    lines = prompt_lines(with_context(chunks, segments, context))
    last = segments.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    body = lines.groupBy("episode", "chunk", "a", "b").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(
        F.format_string("Transcript segments %d-%d of %d.\n", "lo", "hi", "n"), F.format_string("LABELABLE INDICES: %d through %d (inclusive).", "a", F.col("b") - 1),
        F.when((F.col("lo") < F.col("a")) | (F.col("hi") >= F.col("b")), "\nLines marked [CONTEXT] are read-only.").otherwise(""), F.lit("\n"),
    )
    return body.join(last, "episode").select("episode", "chunk", F.concat(head, F.lit("\n"), "body", F.lit(tail)).alias("prompt"))
