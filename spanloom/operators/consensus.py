"""Agreement of several models over the same segments.  votes: (model, episode, idx, flag), one row for each segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.islands import runs


def pairwise_jaccard(votes: DataFrame, segments: DataFrame) -> DataFrame:
    """Jaccard similarity in time of the ad flags of each pair of models; null where neither has any.

    A segment's models are held in one array, so that the self-join is a pair of elements of it.
    """
    length = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    by = votes.groupBy("episode", "idx").agg(F.array_sort(F.collect_list(F.struct("model", "flag"))).alias("ms"))
    by = by.join(segments.select("episode", "idx", length.alias("ms_long")), ["episode", "idx"])
    pairs = by.select("episode", "ms_long", F.explode(F.expr("flatten(transform(ms, (x, i) -> transform(slice(ms, i + 2, size(ms)), y -> struct(x as a, y as b))))")).alias("p"))
    a, b = F.col("p.a.flag") == "a", F.col("p.b.flag") == "a"
    both = F.sum(F.when(a & b, F.col("ms_long")).otherwise(0))
    either = F.sum(F.when(a | b, F.col("ms_long")).otherwise(0))
    return pairs.groupBy("episode", F.col("p.a.model").alias("model_a"), F.col("p.b.model").alias("model_b")).agg((both / F.nullif(either, F.lit(0))).alias("jaccard"))


def tally(votes: DataFrame) -> DataFrame:
    """Votes of each segment and the models that gave them."""
    return votes.groupBy("episode", "idx").agg(F.count_if(F.col("flag") == "a").alias("votes"), F.array_sort(F.collect_set(F.when(F.col("flag") == "a", F.col("model")))).alias("models"))


def consensus_runs(tallied: DataFrame, least: int) -> DataFrame:
    """Runs of segments with ``least`` votes, each with the run of any votes around it, its least votes and models."""
    marked = tallied.withColumns({"agreed": F.col("votes") >= least, "any": F.col("votes") >= 1})
    inner = runs(marked, ["episode"], "agreed").where("agreed").drop("agreed")
    outer = runs(marked, ["episode"], "any").where("any").select("episode", F.col("first_idx").alias("outer_first"), F.col("last_idx").alias("outer_last"))
    # A run of agreement lies in exactly one outer run: both are met over indices.
    at = outer.select("episode", "outer_first", "outer_last", F.explode(F.sequence("outer_first", "outer_last")).alias("first_idx"))
    out = inner.join(at, ["episode", "first_idx"])
    held = out.select("episode", "first_idx", F.explode(F.sequence("first_idx", "last_idx")).alias("idx")).join(tallied, ["episode", "idx"])
    inside = held.groupBy("episode", "first_idx").agg(F.min("votes").alias("votes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"))
    return out.join(inside, ["episode", "first_idx"]).select("episode", "first_idx", "last_idx", "outer_first", "outer_last", "votes", "models")


def with_times(found: DataFrame, segments: DataFrame) -> DataFrame:
    """Consensus runs with their times and the time of the outer run that isn't agreed on."""
    at = lambda idx, source, to: segments.select("episode", F.col("idx").alias(idx), F.col(source).alias(to))
    out = found
    for idx, source, to in (("first_idx", "start", "s"), ("last_idx", "end", "e"), ("outer_first", "start", "outer_s"), ("outer_last", "end", "outer_e")):
        out = out.join(at(idx, source, to), ["episode", idx])
    return out.withColumn("disputed_ms", (F.col("outer_e") - F.col("outer_s")) - (F.col("e") - F.col("s")))


def kinds(found: DataFrame, spans: DataFrame) -> DataFrame:
    """The most frequent kind of model spans (model_ord, span_no, start_index, end_index, kind) over each run; ties to
    the kind seen first; midroll where no span meets it."""
    at = found.select("episode", "first_idx", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    met = spans.select("episode", "model_ord", "span_no", "kind", F.explode(F.sequence("start_index", "end_index")).alias("idx")).join(at, ["episode", "idx"]).select("episode", "first_idx", "model_ord", "span_no", "kind").distinct()
    n = met.groupBy("episode", "first_idx", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("model_ord", "span_no")).alias("seen"))
    best = n.groupBy("episode", "first_idx").agg(F.min_by("kind", F.struct(-F.col("n"), "seen")).alias("kind"))
    return found.join(best, ["episode", "first_idx"], "left").fillna("midroll", ["kind"])


def single_model(tallied: DataFrame, least: int) -> DataFrame:
    """Runs of any votes that nowhere reach ``least``, with the models at their first index."""
    marked = tallied.withColumn("any", F.col("votes") >= 1)
    outer = runs(marked, ["episode"], "any").where("any").drop("any")
    held = outer.withColumn("idx", F.explode(F.sequence("first_idx", "last_idx"))).join(tallied, ["episode", "idx"])
    return held.groupBy("episode", "first_idx", "last_idx").agg(F.max("votes").alias("most"), F.min_by("models", "idx").alias("models")).where(F.col("most") < least).drop("most")
