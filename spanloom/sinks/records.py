"""The canonical record, its checks, and keyed stores (replies, manifests)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom import constants as C
from spanloom.functions.spans import action_for, category_of, form_of, position_of


def record_spans(spans: DataFrame) -> DataFrame:
    """Spans (episode, start, end, start_exact, end_exact, kind, state, confidence, advertiser) as record spans with
    their ids, in order of start."""
    no = F.row_number().over(Window.partitionBy("episode").orderBy("start", "end"))
    out = spans.withColumns({"id": F.concat(F.lit("ad-"), F.lpad(no.cast("string"), 4, "0")), "category": category_of("kind"), "form": form_of("kind"), "position": position_of("kind")})
    moved = F.col("start_exact").isNotNull() & (F.col("start_exact") != F.col("start"))
    return out.select(
        "episode", "id", F.coalesce("start_exact", "start").alias("start"), F.coalesce("end_exact", "end").alias("end"), "category", "form", "position", action_for("category", "state").alias("action"), "state", "confidence",
        F.when(moved, "word").otherwise("segment").alias("edge_mode"), F.nullif(F.trim(F.coalesce("advertiser", F.lit(""))), F.lit("")).alias("advertiser"),
    )


def build_records(media: DataFrame, spans: DataFrame) -> DataFrame:
    """One row an episode: profile, status, duration, thresholds and its spans in order."""
    held = spans.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("start", "end", "id", "category", "form", "position", "action", "state", "confidence", "edge_mode", "advertiser"))).alias("spans"))
    thresholds = F.struct(F.lit(C.AD_THRESHOLD).alias("ad"), F.lit(C.UNCERTAIN).alias("uncertain"), F.lit(C.MAX_AD_FRACTION).alias("max_fraction"), F.lit(C.MAX_SPAN_MS / 1000).alias("max_span_seconds"))
    out = media.join(held, "episode", "left").withColumn("spans", F.when(F.col("status") == "ok", F.col("spans")))
    return out.withColumns({"profile": F.lit(C.PROFILE), "thresholds": thresholds, "spans": F.coalesce("spans", F.array())})


def problems(records: DataFrame) -> DataFrame:
    """``records`` with problems: what is wrong with each, empty if nothing is."""
    span = lambda x: F.array_compact(F.array(
        F.when(x["start"].isNull() | x["end"].isNull(), F.concat(x["id"], F.lit(": no times"))).when(x["end"] <= x["start"], F.concat(x["id"], F.lit(": end before start"))),
        F.when(~F.coalesce(x["state"].isin(*C.STATES), F.lit(False)), F.concat(x["id"], F.lit(": unknown state"))), F.when(~F.coalesce(x["action"].isin(*C.ACTIONS), F.lit(False)), F.concat(x["id"], F.lit(": unknown action"))),
        F.when(~F.coalesce(x["confidence"].between(0, 1), F.lit(True)), F.concat(x["id"], F.lit(": confidence out of range"))),
    ))
    whole = F.array_compact(F.array(F.when(~F.col("profile").eqNullSafe(F.lit(C.PROFILE)), "unknown profile"), F.when(F.col("status").isNull(), "no status"), F.when(F.col("duration_ms").isNull(), "no duration")))
    return records.withColumn("problems", F.concat(whole, F.flatten(F.transform("spans", span))))


def content_hash(segments: DataFrame) -> DataFrame:
    """sha256 of each episode's segments in order (milliseconds and text, tab and newline between)."""
    line = F.concat_ws("\t", F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("text", F.lit("")))
    return segments.groupBy("episode").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("sha256"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``old`` whose keys aren't in ``new``, and the last row of each key of ``new`` by ``order``."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).where("_n = 1").drop("_n")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).where("_n = 1").drop("_n")


def write_new(df: DataFrame, path: str, force: bool = False) -> None:
    """Parquet at ``path``; refuses to replace what is there unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def table_line(*columns: str) -> Column:
    """One line of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))


def analysis(results: DataFrame, ids: Column | str = "span_ids") -> DataFrame:
    """The local tier of results (one row an episode): everything they hold, the profile and the record's span ids."""
    return results.withColumns({"profile": F.lit(C.PROFILE), "record_span_ids": F.col(ids) if isinstance(ids, str) else ids})
