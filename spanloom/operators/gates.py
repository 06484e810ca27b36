"""Episode-level gates, flags and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import constants as C
from spanloom.operators.intervals import explode_indices


def flags(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """One flag for each segment: the highest state of the spans over it, a over u over c."""
    rank = F.when(F.col("state") == "ad", 2).when(F.col("state") == "uncertain", 1).otherwise(0)
    marked = explode_indices(spans.select("episode", "start_index", "end_index", rank.alias("rank"))).groupBy("episode", "idx").agg(F.max("rank").alias("rank"))
    out = segments.join(marked, ["episode", "idx"], "left")
    return out.withColumn("flag", F.element_at(F.array(F.lit("c"), F.lit("u"), F.lit("a")), F.coalesce("rank", F.lit(0)) + 1)).drop("rank")


def flag_strings(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("episode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "flag"))), lambda x: x["flag"]), "").alias("flags"))


def span_stats(flagged: DataFrame, spans: DataFrame) -> DataFrame:
    """ad_spans, ad_segments, uncertain_segments, ad_ms, duration_ms of each episode (segments as start, end, flag)."""
    length = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    by = flagged.groupBy("episode").agg(F.count_if(F.col("flag") == "a").alias("ad_segments"), F.count_if(F.col("flag") == "u").alias("uncertain_segments"), F.sum(F.when(F.col("flag") == "a", length).otherwise(0)).alias("ad_ms"), F.max("end").alias("duration_ms"))
    n = spans.where("state = 'ad'").groupBy("episode").agg(F.count(F.lit(1)).alias("ad_spans"))
    return by.join(n, "episode", "left").withColumn("ad_spans", F.coalesce("ad_spans", F.lit(0)))


def episode_gates(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """status of each episode: degenerate with few segments, no duration or one span over most of it; overlabel where
    the distinct segments under live spans are too much of it; else ok."""
    length = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    whole = segments.groupBy("episode").agg(F.count(F.lit(1)).alias("n_segments"), F.max("end").alias("duration_ms"))
    live = spans.where("state in ('ad', 'uncertain')")
    longest = live.groupBy("episode").agg(F.max(F.col("end") - F.col("start")).alias("longest_ms"))
    covered = explode_indices(live.select("episode", "start_index", "end_index")).select("episode", "idx").distinct().join(segments, ["episode", "idx"]).groupBy("episode").agg(F.sum(length).alias("covered_ms"))
    out = whole.join(longest, "episode", "left").join(covered, "episode", "left").fillna(0, ["longest_ms", "covered_ms"])
    status = (
        F.when((F.col("n_segments") < C.MIN_SEGMENTS) | (F.col("duration_ms") <= 0) | (F.col("longest_ms") > F.col("duration_ms") * C.DEGENERATE), "rejected_degenerate")
        .when(F.col("covered_ms") > F.col("duration_ms") * C.MAX_AD_FRACTION, "rejected_overlabel").otherwise("ok")
    )
    return out.withColumn("status", status)
