"""Further scores of spans against truth: a grid of seconds, events by overlap, an ensemble of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(intervals: DataFrame, step_ms: int = 1000) -> DataFrame:
    """(episode, cell): the cells of ``step_ms`` whose middle an interval (episode, s, e) covers."""
    first, last = F.ceil(F.col("s") / step_ms - 0.5), F.ceil(F.col("e") / step_ms - 0.5) - 1
    return intervals.withColumns({"_a": first.cast("long"), "_b": last.cast("long")}).where("_a <= _b").select("episode", F.explode(F.sequence("_a", "_b")).alias("cell")).distinct()


def grid_scores(found: DataFrame, truth: DataFrame, media: DataFrame, step_ms: int = 1000) -> DataFrame:
    """(episode, tp, fp, fn, tn, mcc) over the cells of each episode (episode, duration_ms); mcc is null where undefined."""
    p, t = grid(found, step_ms).withColumn("p", F.lit(1)), grid(truth, step_ms).withColumn("t", F.lit(1))
    cells = p.join(t, ["episode", "cell"], "full").groupBy("episode").agg(F.count_if(F.expr("p = 1 and t = 1")).alias("tp"), F.count_if(F.expr("p = 1 and t is null")).alias("fp"), F.count_if(F.expr("p is null and t = 1")).alias("fn"))
    both = media.select("episode", F.ceil(F.col("duration_ms") / step_ms).cast("long").alias("n")).join(cells, "episode", "left").na.fill(0, ["tp", "fp", "fn"])
    both = both.withColumn("tn", F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")))
    d = lambda c: F.col(c).cast("double")
    bottom = F.sqrt((d("tp") + d("fp")) * (d("tp") + d("fn")) * (d("tn") + d("fp")) * (d("tn") + d("fn")))
    return both.select("episode", "tp", "fp", "fn", "tn", F.try_divide(d("tp") * d("tn") - d("fp") * d("fn"), bottom).alias("mcc"))


def event_scores(found: DataFrame, truth: DataFrame, least: float = 0.5, beta: float = 0.5) -> DataFrame:
    """(episode, n_found, n_truth, hits, f): events (episode, s, e) hit where intersection by union reaches ``least``."""
    a, b = found.select("episode", "s", "e"), truth.select("episode", F.col("s").alias("ts"), F.col("e").alias("te"))
    shared = F.least("e", "te") - F.greatest("s", "ts")
    near = a.join(b, "episode").where((F.col("s") < F.col("te")) & (F.col("e") > F.col("ts"))).where(shared >= least * (F.greatest("e", "te") - F.least("s", "ts")))
    hits = near.select("episode", "s", "e").distinct().groupBy("episode").agg(F.count(F.lit(1)).alias("hits"))
    met = near.select("episode", "ts", "te").distinct().groupBy("episode").agg(F.count(F.lit(1)).alias("met"))
    counts = a.groupBy("episode").agg(F.count(F.lit(1)).alias("n_found")).join(b.groupBy("episode").agg(F.count(F.lit(1)).alias("n_truth")), "episode", "full")
    out = counts.join(hits, "episode", "left").join(met, "episode", "left").na.fill(0)
    precision, recall = F.col("hits") / F.nullif("n_found", F.lit(0)), F.col("met") / F.nullif("n_truth", F.lit(0))
    f = F.try_divide((1 + beta * beta) * precision * recall, beta * beta * precision + recall)
    return out.select("episode", "n_found", "n_truth", "hits", F.coalesce(f, F.lit(0.0)).alias("f"))


def agreement(tally: DataFrame, models: int) -> DataFrame:
    """(episode, idx, share): of tallied segments (episode, idx, votes) the share of the models that found them."""
    return tally.where("votes > 0").select("episode", "idx", (F.col("votes") / models).alias("share"))
