"""Leaderboards over runs: telemetry of chunks, scores of episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def episode_rows(chunks: DataFrame) -> DataFrame:
    """(run, episode) with sums over its chunk records; a chunk with an error makes it incomplete."""
    return chunks.groupBy("run", "episode").agg(F.count(F.lit(1)).alias("chunks"), F.sum("wall").alias("wall"), F.sum("cost").alias("cost"), F.sum("thinking").alias("thinking"), F.count_if(F.col("error").isNotNull()).alias("incomplete_chunks"))


def leaderboard(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """One row a run: episodes, episodes with truth, sums, the least recall and the largest boundary (nulls skipped), and
    whether any episode fails a gate."""
    both = rows.join(scores, ["run", "episode"], "left")
    return both.groupBy("run").agg(
        F.count(F.lit(1)).alias("episodes"), F.count("loss").alias("with_truth"), F.sum("cost").alias("cost"), F.sum("wall").alias("wall"), F.sum("loss").alias("loss"), F.min("recall").alias("least_recall"),
        F.max("boundary").alias("most_boundary"), F.coalesce(F.bool_or((F.col("loss") > 5) | (F.col("recall") < 0.7) | (F.col("boundary") > 3)), F.lit(False)).alias("any_fail"),
    )
