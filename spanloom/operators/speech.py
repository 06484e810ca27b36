"""What transcription needs besides an engine: equal pieces, their shift back into one time line, tidy segments, pairing
of transcripts with truth and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def equal_pieces(media: DataFrame, most_ms: int) -> DataFrame:
    """(episode, piece, offset, length) in milliseconds: each duration in the fewest equal pieces of at most ``most_ms``."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / most_ms)).cast("long")
    rows = media.select("episode", "duration_ms", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    begin = lambda k: F.expr(f"duration_ms * ({k}) div n")
    return rows.select("episode", "piece", begin("piece").alias("offset"), (begin("piece + 1") - begin("piece")).alias("length"))


def join_pieces(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """Turns of pieces (episode, piece, idx, start, end, speaker, text) in the episode's time, with one number for each
    speaker of each piece: a speaker of one piece isn't taken for one of another."""
    both = turns.join(pieces.select("episode", "piece", "offset"), ["episode", "piece"])
    speaker = F.dense_rank().over(Window.partitionBy("episode").orderBy("piece", "speaker")) - 1
    moved = both.withColumns({"start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset"), "speaker": F.when(F.col("speaker").isNotNull(), speaker)})
    place = F.row_number().over(Window.partitionBy("episode").orderBy("piece", "idx")) - 1
    return moved.withColumn("idx", place).drop("offset", "piece")


def join_fragments(segments: DataFrame, least_ms: int = 1000) -> DataFrame:
    """Segments (episode, idx, start, end, text), those shorter than ``least_ms`` joined to what comes before."""
    w = Window.partitionBy("episode").orderBy("idx")
    marked = segments.withColumn("_first", F.when((F.col("end") - F.col("start") < least_ms) & (F.row_number().over(w) > 1), 0).otherwise(1))
    marked = marked.withColumn("_g", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("episode", "_g").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"))
    return out.select("episode", (F.row_number().over(Window.partitionBy("episode").orderBy("first")) - 1).alias("idx"), "first", "n", "start", "end", F.array_join("t.text", " ").alias("text"))


def pair_fixtures(truth: DataFrame, transcripts: DataFrame, predictions: DataFrame) -> DataFrame:
    """(stem, status) of every transcript with a truth (stem each): ``ok``, or ``no prediction`` where none was made."""
    there = predictions.select("stem").distinct().withColumn("_there", F.lit(True))
    pairs = transcripts.select("stem").distinct().join(truth.select("stem").distinct(), "stem").join(there, "stem", "left")
    return pairs.select("stem", F.when(F.col("_there"), "ok").otherwise("no prediction").alias("status"))


def fingerprint(content: Column) -> Column:
    """bytes and sha256 of a file's content (binary)."""
    return F.struct(F.length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))
