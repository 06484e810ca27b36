"""Gap and islands: merges of spans, intervals, turns and flags as one window and one aggregate, on one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom import constants as C


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int, order: list[str] | None = None) -> DataFrame:
    """``df`` with island: rows join the one before while start - largest end so far <= gap."""
    w = Window.partitionBy(*keys).orderBy(start, end, *(order or []))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_spans(spans: DataFrame, keys: list[str] | None = None, gap: int = C.MERGE_GAP) -> DataFrame:
    """Spans (start_index, end_index, kind, confidence, evidence, end_evidence, ord) merged across at most ``gap``.

    Confidence is the least; kind and end_evidence (and dialogue_suspect and evidence_straddles, if there) are the first
    span's, evidence the first that isn't empty.
    """
    keys = keys or ["episode"]
    place = F.struct("start_index", "end_index", "ord")
    marked = islands(spans, keys, "start_index", "end_index", gap, ["ord"])
    return marked.groupBy(*keys, "island").agg(
        F.min("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.min("confidence").alias("confidence"), F.min_by("kind", place).alias("kind"),
        F.min_by("evidence", F.when(F.col("evidence") != "", place)).alias("evidence"), F.min_by("end_evidence", place).alias("end_evidence"), F.min("ord").alias("ord"),
        *[F.min_by(c, place).alias(c) for c in ("evidence_straddles", "dialogue_suspect") if c in spans.columns],
    ).drop("island")


def merge_intervals(df: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Intervals (s, e) merged where they touch; n counts them."""
    return islands(df, keys, "s", "e", gap).groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).drop("island")


def breaks(creatives: DataFrame, keys: list[str], gap: int = C.BREAK_GAP_MS) -> DataFrame:
    """Breaks from creatives (s, e, slot): number of creatives and their slots, sorted."""
    return islands(creatives, keys, "s", "e", gap).groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("creatives"), F.array_sort(F.collect_set("slot")).alias("slots")).drop("island")


def kind_of_slots(slots: Column) -> Column:
    """All pre: preroll; all post: postroll; else midroll."""
    return F.when(slots == F.array(F.lit("pre")), "preroll").when(slots == F.array(F.lit("post")), "postroll").otherwise("midroll")


def turns(segments: DataFrame, keys: list[str], speaker: str, gap: int = C.TURN_GAP_MS) -> DataFrame:
    """Consecutive segments (idx, start, end) of one speaker at most ``gap`` apart; the end is the last one's."""
    w = Window.partitionBy(*keys).orderBy("idx")
    new = F.when(F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & (F.col("start") - F.lag("end").over(w) <= gap), 0).otherwise(1)
    marked = segments.withColumn("_new", new).withColumn("turn_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "turn_no").agg(F.min_by(speaker, "idx").alias(speaker), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), F.count(F.lit(1)).alias("segments"))


def runs(flags: DataFrame, keys: list[str], flag: str = "flag") -> DataFrame:
    """Maximal runs of equal flags over consecutive idx."""
    own = Window.partitionBy(*keys, flag).orderBy("idx")
    return flags.withColumn("_at", F.col("idx") - F.row_number().over(own)).groupBy(*keys, flag, "_at").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).drop("_at")
