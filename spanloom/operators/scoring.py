"""Time-weighted scores of flags against truth, and their aggregates.  Times are milliseconds until the last step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import constants as C
from spanloom.operators.intervals import explode_indices, nearest_block
from spanloom.operators.islands import runs


def truth_flags(segments: DataFrame, truth: DataFrame) -> DataFrame:
    """Segments with tflag: a under a truth span, else c."""
    marked = explode_indices(truth).select("episode", "idx").distinct().withColumn("tflag", F.lit("a"))
    return segments.join(marked, ["episode", "idx"], "left").fillna("c", ["tflag"])


def truth_delivery(segments: DataFrame, truth: DataFrame, inserted_docs: DataFrame, inserted: DataFrame) -> DataFrame:
    """Delivery of each truth segment: its span's own, else the episode's (truth.default), else h or i by whether an
    inserted span covers it where such a document exists (no spans in it means all host-read), else ``?``.

    truth: episode, start_index, end_index, delivery, default, span_no (later spans win); inserted_docs: episode.
    """
    own = explode_indices(truth).groupBy("episode", "idx").agg(F.max_by(F.struct("delivery", "default"), "span_no").alias("d")).select("episode", "idx", F.substring(F.coalesce("d.delivery", "d.default"), 1, 1).alias("given"))
    within = explode_indices(inserted).select("episode", "idx").distinct().withColumn("in_inserted", F.lit(True))
    out = own.join(inserted_docs.select("episode").distinct().withColumn("has_doc", F.lit(True)), "episode", "left").join(within, ["episode", "idx"], "left")
    out = out.select("episode", "idx", F.coalesce("given", F.when(F.col("has_doc"), F.when(F.col("in_inserted"), "i").otherwise("h")), F.lit("?")).alias("delivery"))
    return segments.join(out, ["episode", "idx"], "left")


def block_table(scored: DataFrame, flag: str) -> DataFrame:
    """Blocks of flag ``a`` with their indices and ends in time."""
    found = runs(scored, ["episode"], flag).where(F.col(flag) == "a")
    first = scored.select("episode", F.col("idx").alias("first_idx"), F.col("start").alias("s"))
    last = scored.select("episode", F.col("idx").alias("last_idx"), F.col("end").alias("e"))
    return found.join(first, ["episode", "first_idx"]).join(last, ["episode", "last_idx"]).withColumn("block", F.col("first_idx").cast("long"))


def score(flagged: DataFrame) -> DataFrame:
    """Scores of each episode from (episode, idx, start, end, flag, tflag, delivery): one aggregate and one window.

    recall is of flag a only; loss is content flagged a; boundary figures are of truth blocks whose nearest found block
    shares an index with them.
    """
    length = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    true, ad = F.col("tflag") == "a", F.col("flag") == "a"
    total = lambda c: F.sum(F.when(c, length).otherwise(0))
    by = flagged.groupBy("episode").agg(
        total(true).alias("true_ms"), total(~true).alias("content_ms"), total(ad).alias("pred_ms"), total(ad & ~true).alias("loss_ms"), total(ad & true).alias("caught_ms"),
        total(~true & (F.col("flag") == "u")).alias("uncertain_content_ms"), total(true & (F.col("delivery") == "h")).alias("host_ms"), total(true & ad & (F.col("delivery") == "h")).alias("host_caught_ms"),
        total(true & (F.col("delivery") == "i")).alias("inserted_ms"), total(true & ad & (F.col("delivery") == "i")).alias("inserted_caught_ms"),
    )
    near = nearest_block(block_table(flagged, "tflag"), block_table(flagged, "flag"), ["episode"])
    blocks = near.groupBy("episode").agg(F.count(F.lit(1)).alias("true_blocks"), F.count_if("matched").alias("matched_blocks"), F.sum(F.when(F.col("matched"), F.col("start_gap") + F.col("end_gap"))).alias("gap_ms"))
    out = by.join(blocks, "episode", "left").fillna(0, ["true_blocks", "matched_blocks"])
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return out.withColumns({
        "missed_ms": F.col("true_ms") - F.col("caught_ms"), "recall": ratio("caught_ms", "true_ms"), "host_recall": ratio("host_caught_ms", "host_ms"), "inserted_recall": ratio("inserted_caught_ms", "inserted_ms"),
        "boundary_ms": F.col("gap_ms") / F.nullif(F.col("matched_blocks") * 2, F.lit(0)),
    })


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """One row over all episodes: sums, recalls as ratios of sums, the mean of the episodes' boundary figures, and the
    gates, both over the sum and over each episode."""
    ratio = lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0))
    out = scores.agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("true_ms").alias("true_ms"), F.sum("loss_ms").alias("loss_ms"), F.sum("caught_ms").alias("caught_ms"), ratio("caught_ms", "true_ms").alias("recall"),
        ratio("host_caught_ms", "host_ms").alias("host_recall"), ratio("inserted_caught_ms", "inserted_ms").alias("inserted_recall"), F.avg("boundary_ms").alias("boundary_ms"), F.max("loss_ms").alias("worst_loss_ms"),
    )
    return out.withColumns({
        "pass_loss": F.col("loss_ms") <= C.GATE_LOSS_MS, "pass_loss_each": F.col("worst_loss_ms") <= C.GATE_LOSS_MS, "pass_recall": F.coalesce(F.col("recall") >= C.GATE_RECALL, F.lit(True)), "pass_boundary": F.coalesce(F.col("boundary_ms") <= C.GATE_BOUNDARY_MS, F.lit(True)),
    })
