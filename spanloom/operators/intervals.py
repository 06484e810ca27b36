"""Interval joins and interval algebra.

Spark has no range join: without an equality an inequality join is a nested loop.  Every join here has one.  Index
ranges are exploded to indices; time ranges are cut into buckets of ``bucket`` milliseconds and joined on (key,
bucket), each pair being kept in the first bucket that both reach, so nothing needs to be made distinct.  A long
key (a hot episode) is so spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.spans import overlap
from spanloom.operators.islands import merge_intervals

BUCKET_MS = 600_000


def _bucketed(df: DataFrame, s: str, e: str, bucket: int) -> DataFrame:
    low, high = F.floor(F.col(s) / bucket), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / bucket)
    return df.withColumn("_low", low).withColumn("bucket", F.explode(F.sequence(low, high)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str = "s", le: str = "e", rs: str = "rs", re: str = "re", bucket: int = BUCKET_MS) -> DataFrame:
    """All pairs of equal keys whose half-open intervals overlap.  Columns other than the keys must differ by name."""
    a = _bucketed(left, ls, le, bucket).withColumnRenamed("_low", "_la")
    b = _bucketed(right, rs, re, bucket).withColumnRenamed("_low", "_lb")
    pairs = a.join(b, [*keys, "bucket"]).where((F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & (F.col("bucket") == F.greatest("_la", "_lb")))
    return pairs.drop("bucket", "_la", "_lb")


def intersect(a: DataFrame, b: DataFrame, keys: list[str], bucket: int = BUCKET_MS) -> DataFrame:
    """Merged intersections of two interval sets (s, e)."""
    b = b.select(*keys, F.col("s").alias("rs"), F.col("e").alias("re"))
    cut = overlap_join(a.select(*keys, "s", "e"), b, keys, bucket=bucket)
    cut = cut.select(*keys, F.greatest("s", "rs").alias("s"), F.least("e", "re").alias("e"))
    return merge_intervals(cut, keys).drop("n")


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What of a isn't in b: a sweep over the ends of both with running counts; touching rests merge."""
    ends = None
    for df, side in ((a, "a"), (b, "b")):
        for at, step in (("s", 1), ("e", -1)):
            part = df.where("e > s").select(*keys, F.col(at).alias("p"), F.lit(step if side == "a" else 0).alias("da"), F.lit(step if side == "b" else 0).alias("db"))
            ends = part if ends is None else ends.unionByName(part)
    w = Window.partitionBy(*keys).orderBy("p")
    swept = ends.groupBy(*keys, "p").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.select(*keys, F.col("p").alias("s"), F.lead("p").over(w).alias("e"), F.sum("da").over(so_far).alias("ina"), F.sum("db").over(so_far).alias("inb"))
    return merge_intervals(swept.where("ina > 0 and inb = 0 and e is not null").select(*keys, "s", "e"), keys).drop("n")


def complement(whole: DataFrame, a: DataFrame, keys: list[str]) -> DataFrame:
    """What of the whole (s, e of each key) isn't in a."""
    return subtract(whole, a, keys)


def map_to_segments(breaks: DataFrame, segments: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """first_idx and last_idx of the segments (idx, start, end) that lie in a break (break_no, s, e) by half at least."""
    found = overlap_join(breaks.select(*keys, "break_no", "s", "e"), segments.where("end > start").select(*keys, "idx", F.col("start").alias("rs"), F.col("end").alias("re")), keys)
    found = found.where(overlap("s", "e", "rs", "re") >= share * (F.col("re") - F.col("rs")))
    return found.groupBy(*keys, "break_no").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def explode_indices(spans: DataFrame, first: str = "start_index", last: str = "end_index") -> DataFrame:
    """One row for each index of a closed range: turns an index-range join into a hash join."""
    return spans.where(F.col(first) <= F.col(last)).withColumn("idx", F.explode(F.sequence(first, last)))


def span_at(points: DataFrame, spans: DataFrame, keys: list[str], point_id: list[str]) -> DataFrame:
    """Each point (t) with the first span (s, e, span_no) that holds it, start <= t < end; null if none."""
    held = overlap_join(points.select(*keys, *point_id, "t", (F.col("t") + 1).alias("t1")), spans.select(*keys, F.col("s").alias("rs"), F.col("e").alias("re"), "span_no"), keys, "t", "t1")
    first = held.groupBy(*keys, *point_id).agg(F.min_by("span_no", F.struct("rs", "span_no")).alias("span_no"))
    return points.join(first, [*keys, *point_id], "left")


def nearest_block(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Each truth block (block, first_idx, last_idx, s, e) with the found block of nearest end (ties: the earliest), and
    whether the two share an index; there is no second choice.

    The nearest end stands right before or after in order of ends, so both sides go through one window instead of a
    join of all pairs of a key.
    """
    both = truth.select(*keys, F.lit(1).alias("side"), F.col("block").alias("t_block"), F.lit(None).cast("long").alias("p_block"), "first_idx", "last_idx", "s", "e").unionByName(
        found.select(*keys, F.lit(0).alias("side"), F.lit(None).cast("long").alias("t_block"), F.col("block").alias("p_block"), "first_idx", "last_idx", "s", "e")
    )
    own = F.when(F.col("side") == 0, F.struct("p_block", "first_idx", "last_idx", "s", "e"))
    up = Window.partitionBy(*keys).orderBy("e", "side", F.desc("p_block")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("e"), "side", F.desc("p_block")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before", F.last(own, True).over(up)).withColumn("after", F.last(own, True).over(down)).where("side = 1")
    gap = lambda c: F.abs(F.col(f"{c}.e") - F.col("e"))
    first = F.col("after").isNull() | (gap("before") < gap("after")) | ((gap("before") == gap("after")) & (F.col("before.p_block") <= F.col("after.p_block")))
    both = both.withColumn("near", F.when(F.col("before").isNotNull() & first, F.col("before")).otherwise(F.col("after")))
    shared = (F.col("near.first_idx") <= F.col("last_idx")) & (F.col("near.last_idx") >= F.col("first_idx"))
    return both.select(*keys, F.col("t_block").alias("block"), F.col("near.p_block").alias("p_block"), gap("near").alias("end_gap"), F.abs(F.col("near.s") - F.col("s")).alias("start_gap"), F.coalesce(shared, F.lit(False)).alias("matched"))


def asof_backward(points: DataFrame, cues: DataFrame, keys: list[str], slack: int = 300) -> DataFrame:
    """Each point (t, point_no) with the last cue (cue_no, s, e) that began by then, null if t >= e + slack: one window
    over both sides, whatever the number of cues of a key."""
    both = points.select(*keys, F.col("t"), F.lit(1).alias("side"), "point_no", F.lit(None).cast("long").alias("cue_no"), F.lit(None).cast("long").alias("e")).unionByName(
        cues.select(*keys, F.col("s").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("point_no"), "cue_no", "e")
    )
    w = Window.partitionBy(*keys).orderBy("t", "side", "cue_no").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("cue_no", "e")), True).over(w)
    both = both.withColumn("cue", last).where("side = 1")
    return both.select(*keys, "point_no", "t", F.when(F.col("t") < F.col("cue.e") + slack, F.col("cue.cue_no")).alias("cue_no"))


def time_shift(points: DataFrame, inserted: DataFrame, keys: list[str]) -> DataFrame:
    """Points (point_no, t in the shorter time line) moved by the inserted pieces (s in the longer time line, dur) that
    begin before them: t + sum of durations of pieces with start < shifted t."""
    w = Window.partitionBy(*keys).orderBy("s", "dur")
    pieces = inserted.withColumn("before", F.coalesce(F.sum("dur").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A piece applies from s - before on in the shorter time line.
    cues = pieces.select(*keys, (F.col("s") - F.col("before")).alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("point_no"), "dur")
    both = points.select(*keys, "t", F.lit(1).alias("side"), "point_no", F.lit(0).cast("long").alias("dur")).unionByName(cues)
    order = Window.partitionBy(*keys).orderBy("t", F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("shift", F.sum("dur").over(order)).where("side = 1").select(*keys, "point_no", "t", (F.col("t") + F.col("shift")).alias("shifted"))


def range_by(column: Column, low: Column, high: Column) -> Column:
    return (column >= low) & (column < high)
