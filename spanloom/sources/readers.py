"""Readers: transcripts, captions, feeds, stitch maps, disclosure tracks, edit lists, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.text import clean_caption, stem_of_path
from spanloom.functions.times import parse_stamp, rfc822, to_ms

#: Words of some engines are {word, start, end}; both are read and become {w, s, e} in milliseconds.
WORD = "struct<w:string,s:double,e:double,word:string,start:double,end:double>"
TRANSCRIPT = f"engine string, model string, timing string, has_words boolean, segments array<struct<start:double,end:double,text:string,speaker:string,words:array<{WORD}>>>"
JUNK = ("", "you", "thank you.", "thanks for watching!", "[music]", "(music)", "...")


def normal_words(words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(F.coalesce(w["w"], w["word"]).alias("w"), to_ms(F.coalesce(w["s"], w["start"])).alias("s"), to_ms(F.coalesce(w["e"], w["end"])).alias("e")))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(episode, idx, start, end, text, speaker, words) of transcript JSON files; malformed files give no segments."""
    files = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return files.select(stem_of_path("_metadata.file_path").alias("episode"), F.posexplode("segments").alias("idx", "s")).select("episode", "idx", to_ms("s.start").alias("start"), to_ms("s.end").alias("end"), F.coalesce("s.text", F.lit("")).alias("text"), "s.speaker", normal_words(F.col("s.words")).alias("words"))


def drop_junk(segments: DataFrame) -> DataFrame:
    return segments.where(~F.lower(F.trim("text")).isin(*JUNK))


def parse_captions(files: DataFrame) -> DataFrame:
    """(episode, idx, start, end, text) of VTT and SRT texts (episode, raw): header, note, style and region blocks, cue
    settings and tags fall away, as do cues without valid times or text."""
    raw = F.regexp_replace(F.regexp_replace("raw", "^﻿", ""), "\r\n?", "\n")
    blocks = files.select("episode", F.posexplode(F.split(raw, "\n[ \t]*\n+")).alias("ord", "block")).where(~F.trim("block").rlike("^(WEBVTT|NOTE|STYLE|REGION)"))
    times = F.regexp_extract("block", r"(?m)^(.*-->.*)$", 1)
    side = F.split(times, "-->")
    cues = blocks.where(F.col("block").contains("-->")).select("episode", "ord", parse_stamp(side[0]).alias("start"), parse_stamp(F.split(F.trim(side[1]), r"\s+")[0]).alias("end"), clean_caption(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "")).alias("text"))
    cues = cues.where("start is not null and end is not null and text <> ''")
    return cues.select("episode", (F.row_number().over(Window.partitionBy("episode").orderBy("start", "end", "ord")) - 1).alias("idx"), "start", "end", "text")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(stem_of_path("_metadata.file_path").alias("episode"), F.col("value").alias("raw"))
    return parse_captions(files)


def proportional(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences of texts (text, start, duration) with times in proportion to their characters, from integer sums."""
    rows = texts.select(*keys, "start", "duration", F.posexplode(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")).alias("idx", "sentence"))
    rows = rows.withColumn("n", F.length("sentence"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"total": F.sum("n").over(w), "before": before})
    return rows.select(*keys, "idx", "sentence", (F.col("start") + F.expr("duration * before div total")).alias("start"), (F.col("start") + F.expr("duration * (before + n) div total")).alias("end"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(guid, title, published, enclosure, duration) of the items of RSS files."""
    schema = "guid string, title string, pubDate string, enclosure struct<_url:string,_type:string,_length:string>, `itunes:duration` string"
    items = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", False).schema(schema).load(path)
    return items.select(F.trim("guid").alias("guid"), F.trim("title").alias("title"), rfc822("pubDate").alias("published"), F.col("enclosure._url").alias("enclosure"), F.col("`itunes:duration`").alias("duration"))


def read_stitch_maps(spark: SparkSession, path: str) -> DataFrame:
    """(episode, s, e, slot, campaign, ad_id) of stitch maps."""
    schema = "ad_map struct<ads:array<struct<start_sec:double,end_sec:double,slot:string,campaign:string,ad_id:string>>>"
    maps = spark.read.schema(schema).option("multiLine", True).json(path)
    return maps.select(stem_of_path("_metadata.file_path").alias("episode"), F.explode("ad_map.ads").alias("a")).select("episode", to_ms("a.start_sec").alias("s"), to_ms("a.end_sec").alias("e"), "a.slot", "a.campaign", "a.ad_id")


def decode_stitch_header(headers: DataFrame) -> DataFrame:
    """(episode, ad, s, e, slot, campaign) of headers ``ad#end#slot#idx#start#campaign...,...@guid#bps#id3`` (bytes)."""
    tail = F.split(F.element_at(F.split("header", "@"), -1), "#")
    ms = lambda byte: F.round((byte.cast("long") - F.col("id3")) * 8000 / F.col("bps")).cast("long")
    rows = headers.select("episode", tail[1].cast("long").alias("bps"), tail[2].cast("long").alias("id3"), F.explode(F.split(F.split("header", "@")[0], ",")).alias("item")).withColumn("p", F.split("item", "#"))
    return rows.select("episode", F.col("p")[0].alias("ad"), ms(F.col("p")[4]).alias("s"), ms(F.col("p")[1]).alias("e"), F.col("p")[2].alias("slot"), F.col("p")[5].alias("campaign"))


def parse_disclosure(files: DataFrame) -> DataFrame:
    """Spans of metadata tracks (episode, raw): the JSON of each cue's second line; cues without are skipped."""
    blocks = files.select("episode", F.posexplode(F.split(F.replace("raw", F.lit("\r\n"), F.lit("\n")), "\n\n")).alias("ord", "block")).where(F.col("block").contains("-->") & ~F.trim("block").rlike("^(WEBVTT|NOTE)"))
    times = F.split(F.regexp_extract("block", r"(?m)^(.*-->.*)$", 1), "-->")
    body = F.split(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n", ""), "\n")
    rows = blocks.select("episode", "ord", parse_stamp(times[0]).alias("start"), parse_stamp(F.split(F.trim(times[1]), r"\s+")[0]).alias("end"), body[0].alias("token"), F.try_parse_json(F.get(body, F.lit(1))).alias("v"))
    get = lambda k, t: F.expr(f"try_variant_get(v, '$.{k}', '{t}')").alias(k)
    return rows.where("v is not null").select("episode", "start", "end", "token", *[get(k, "string") for k in ("id", "category", "form", "position", "action", "state", "advertiser")], get("confidence", "double"))


def parse_edl(files: DataFrame) -> DataFrame:
    """(episode, s, e, action) of edit lists (episode, raw); lines of fewer than three fields are skipped."""
    lines = files.select("episode", F.explode(F.split("raw", "\n")).alias("line")).withColumn("p", F.split(F.trim("line"), r"\s+"))
    return lines.where(F.size("p") >= 3).select("episode", to_ms(F.col("p")[0]).alias("s"), to_ms(F.col("p")[1]).alias("e"), F.col("p")[2].cast("int").alias("action"))


def replay(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with the recorded reply of their key; a miss is an error of its own row."""
    return requests.join(responses, "key", "left").withColumn("error", F.when(F.col("obj").isNull(), "no recorded reply"))


def best_prediction(files: DataFrame) -> DataFrame:
    """One prediction file (path) a stem: the plain result before the analysis before the record."""
    rank = F.when(F.col("path").endswith("_ads.json"), 0).when(F.col("path").endswith(".analysis.json"), 1).otherwise(2)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(_ads\.json|\.[a-z]+\.json)$", "")
    return files.withColumns({"stem": stem, "_rank": rank}).groupBy("stem").agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))


def select_feed(items: DataFrame, excluded: DataFrame, until: Column, days: int, count: int, seed: int) -> DataFrame:
    """Items with an enclosure, published in the window, whose normal title begins with no excluded one, in a seeded
    order: ``drawn`` for the first ``count``.  The order is by md5 of guid and seed, the same on every engine."""
    from spanloom.functions.text import norm_title

    inside = items.where(F.col("enclosure").isNotNull() & (F.col("published") <= until) & (F.col("published") >= until - F.expr(f"INTERVAL {days} DAYS"))).withColumn("norm", norm_title("title"))
    bad = excluded.select(norm_title("prefix").alias("bad")).where("bad <> ''")
    kept = inside.join(bad, F.col("norm").startswith(F.col("bad")), "left_anti")
    order = Window.partitionBy(F.lit(0)).orderBy("h", "guid")
    return kept.withColumn("h", F.md5(F.concat(F.col("guid").cast("string"), F.lit(f"#{seed}")))).withColumn("place", F.row_number().over(order)).withColumn("drawn", F.col("place") <= count).drop("norm", "h")


def compare_copies(downloads: DataFrame) -> DataFrame:
    """Two downloads of one item (guid, copy a or b, sha256, bytes, duration_ms): identical or differs, with deltas."""
    by = downloads.groupBy("guid").agg(*[F.max(F.when(F.col("copy") == c, F.col(k))).alias(f"{k}_{c}") for c in "ab" for k in ("sha256", "bytes", "duration_ms")])
    return by.select("guid", F.when(F.col("sha256_a") == F.col("sha256_b"), "identical").otherwise("differs").alias("verdict"), (F.col("bytes_b") - F.col("bytes_a")).alias("size_delta"), (F.col("duration_ms_b") - F.col("duration_ms_a")).alias("duration_delta_ms"))


