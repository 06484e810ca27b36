"""Word-precise span starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import normalize_quote, word_index_of


def refine_starts(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """``spans`` with start_exact, end_exact and splits (index, at, ad_side).

    The start moves to the first word of the quote if that word isn't the segment's first and lies strictly inside it;
    the end is never trimmed.  segments: words array<struct<w, s, e>> in milliseconds.
    """
    first = segments.select("episode", F.col("idx").alias("start_index"), F.col("words").alias("_words"), F.col("end").alias("_end"))
    both = spans.join(first, ["episode", "start_index"], "left")
    tokens = F.transform(F.coalesce("_words", F.array().cast("array<struct<w:string,s:bigint,e:bigint>>")), lambda w: F.replace(normalize_quote(w["w"]), F.lit(" "), F.lit("")))
    target = F.filter(F.split(normalize_quote("evidence"), " "), lambda w: w != "")
    both = both.withColumn("_k", word_index_of(tokens, target)).withColumn("_at", F.get(F.col("_words"), F.col("_k"))["s"])
    moved = (F.col("_k") > 0) & (F.col("_at") > F.col("start")) & (F.col("_at") < F.col("_end"))
    split = F.array(F.struct(F.col("start_index").alias("index"), F.col("_at").alias("at"), F.lit("after").alias("ad_side")))
    return both.withColumns({"start_exact": F.when(moved, F.col("_at")).otherwise(F.col("start")), "end_exact": F.col("end"), "splits": F.when(moved, split).otherwise(F.array().cast("array<struct<index:int,at:bigint,ad_side:string>>"))}).drop("_words", "_end", "_k", "_at")
