"""Text formats of span records, as one aggregate an episode.

Records: media (episode, duration_ms, sha256, path) and spans (episode, id, start, end, category, form, position,
action, state, confidence, advertiser), times in milliseconds.  Every renderer returns (episode, body); an episode
without spans gets the format's empty form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom import constants as C
from spanloom.functions.spans import overlap, title_of
from spanloom.functions.text import escape_cue
from spanloom.functions.times import format_seconds, format_stamp


def _joined(rows: DataFrame, media: DataFrame, text: Column, order: list[str], between: str = "", head: str | Column = "", tail: str = "", empty: str | None = None) -> DataFrame:
    lines = rows.withColumn("_text", text).groupBy("episode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_text"))), lambda x: x["_text"]), between).alias("_body"))
    out = media.join(lines, "episode", "left")
    head = F.lit(head) if isinstance(head, str) else head
    body = F.concat(head, F.col("_body"), F.lit(tail))
    return out.select("episode", F.coalesce(body, F.lit(empty) if empty is not None else F.concat(head, F.lit(tail))).alias("body"))


def edl(media: DataFrame, spans: DataFrame) -> DataFrame:
    """start, end and action 3 of skippable spans, tab-separated."""
    return _joined(spans.where("action = 'skip'"), media, F.concat(format_seconds("start"), F.lit("\t"), format_seconds("end"), F.lit("\t3\n")), ["start", "end"], empty="")


def audacity(media: DataFrame, spans: DataFrame) -> DataFrame:
    return _joined(spans, media, F.concat(format_seconds("start"), F.lit("\t"), format_seconds("end"), F.lit("\t"), title_of("category", "advertiser"), F.lit("\n")), ["start", "end"], empty="")


def rttm(media: DataFrame, spans: DataFrame) -> DataFrame:
    name = F.regexp_replace(F.element_at(F.split(F.coalesce("path", F.lit("media")), "/"), -1), "\\.[^.]+$", "")
    rows = spans.join(media.select("episode", name.alias("name")), "episode")
    return _joined(rows, media, F.concat(F.lit("SPEAKER "), "name", F.lit(" 1 "), format_seconds("start"), F.lit(" "), format_seconds(F.col("end") - F.col("start")), F.lit(" <NA> <NA> "), "category", F.lit(" <NA> <NA>\n")), ["start", "end"], empty="")


def _numbered(spans: DataFrame) -> DataFrame:
    return spans.withColumn("no", F.row_number().over(Window.partitionBy("episode").orderBy("start", "end", "id")))


def srt(media: DataFrame, spans: DataFrame) -> DataFrame:
    """Subtitle track of the spans; a cue never ends on a bare number."""
    title = title_of("category", "advertiser")
    title = F.when(F.trim(title).rlike("^[0-9]+$"), F.concat(title, F.lit(" ."))).otherwise(title)
    return _joined(_numbered(spans), media, F.concat(F.col("no").cast("string"), F.lit("\n"), format_stamp("start", ","), F.lit(" --> "), format_stamp("end", ","), F.lit("\n"), title, F.lit("\n\n")), ["no"], empty="")


def vtt(media: DataFrame, spans: DataFrame) -> DataFrame:
    """Metadata track: the category's token, then one line of JSON that can't close a cue."""
    rows = spans.join(media.select("episode", F.substring("sha256", 1, 16).alias("media")), "episode")
    json = F.to_json(F.struct(F.lit(C.PROFILE).alias("v"), "id", "media", "category", "form", "position", "action", "state", "confidence", F.nullif(F.trim(F.coalesce("advertiser", F.lit(""))), F.lit("")).alias("advertiser")))
    for text, safe in (("-->", "--\\u003e"), ("<", "\\u003c"), ("&", "\\u0026")):
        json = F.replace(json, F.lit(text), F.lit(safe))
    head = f"WEBVTT - {C.PROFILE}\n\nNOTE\nDisclosure track: line 1 of a cue is its category, line 2 a JSON object.\n\n"
    return _joined(_numbered(rows), media, F.concat("id", F.lit("\n"), format_stamp("start"), F.lit(" --> "), format_stamp("end"), F.lit("\n"), F.upper("category"), F.lit("\n"), json, F.lit("\n\n")), ["no"], head=head)


def sponsorblock(media: DataFrame, spans: DataFrame) -> DataFrame:
    rows = spans.where("action = 'skip'").join(media.select("episode", F.substring(F.coalesce("sha256", F.lit("")), 1, 12).alias("sha"), "duration_ms"), "episode")
    item = F.to_json(F.struct(
        F.array(F.col("start") / 1000, F.col("end") / 1000).alias("segment"), "category", F.lit("skip").alias("actionType"), (F.col("duration_ms") / 1000).alias("videoDuration"), F.concat(F.lit("span-"), "sha", F.lit("-"), "id").alias("UUID"),
        F.lit(0).alias("locked"), F.lit(0).alias("votes"), F.coalesce("advertiser", F.lit("")).alias("description"),
    ), {"ignoreNullFields": "false"})
    return _joined(rows, media, item, ["start", "end"], ",", "[", "]\n")


def chapter_list(media: DataFrame, spans: DataFrame, style: str = "label") -> DataFrame:
    """(episode, no, start, end, title, id, ...) of chapters that cover the file: spans, the gaps of over half a second
    between them as numbered parts, a start at 0, and the last one halved until there are three (if the duration is
    known)."""
    w = Window.partitionBy("episode").orderBy("start", "end", "id")
    cols = ["category", "form", "action", "confidence"]
    marked = spans.withColumn("prev", F.coalesce(F.lag("end").over(w), F.lit(0).cast("long")))
    own = marked.select("episode", "start", "end", title_of("category", "advertiser", style).alias("title"), "id", *cols)
    gaps = marked.where(F.col("start") > F.col("prev") + C.CHAPTER_GAP_MS).select("episode", F.col("prev").alias("start"), F.col("start").alias("end"))
    last = spans.groupBy("episode").agg(F.max_by("end", F.struct("start", "end", "id")).alias("last"))
    rest = media.join(last, "episode", "left").fillna(0, ["last"]).where(F.col("duration_ms") > F.col("last") + C.CHAPTER_GAP_MS).select("episode", F.col("last").cast("long").alias("start"), F.col("duration_ms").alias("end"))
    parts = gaps.unionByName(rest).withColumn("title", F.concat(F.lit("Part "), F.row_number().over(Window.partitionBy("episode").orderBy("start")).cast("string")))
    all_ = own.unionByName(parts, allowMissingColumns=True)
    first = all_.groupBy("episode").agg(F.min("start").alias("first"))
    lead = media.join(first, "episode", "left").where("first is null or first > 0").select("episode", F.lit(0).cast("long").alias("start"), F.coalesce("first", "duration_ms").alias("end"), F.lit("Start").alias("title"))
    all_ = all_.unionByName(lead, allowMissingColumns=True)
    n = Window.partitionBy("episode")
    all_ = all_.withColumns({"n": F.count(F.lit(1)).over(n), "no": F.row_number().over(Window.partitionBy("episode").orderBy("start", F.col("id").isNull().desc())), "parts": F.count_if(F.col("title").startswith("Part ")).over(n)})
    all_ = all_.join(media.select("episode", F.col("duration_ms").isNotNull().alias("known")), "episode")
    # The last of one chapter becomes three pieces, that of two becomes two.
    third = F.col("end") - F.floor((F.col("end") - F.col("start")) / 2)
    quarter = F.col("end") - F.floor((F.col("end") - third) / 2)
    empty = lambda t: F.lit(None).cast(t)
    piece = lambda s, e, title, keep: F.struct(s.alias("start"), e.alias("end"), title.alias("title"), (F.col("id") if keep else empty("string")).alias("id"), *[(F.col(c) if keep else empty(t)).alias(c) for c, t in zip(cols, ("string", "string", "string", "double"), strict=True)])
    more = lambda k: F.concat(F.lit("Part "), (F.col("parts") + F.lit(k)).cast("string"))
    split = F.when(F.col("known") & (F.col("no") == F.col("n")) & (F.col("n") == 2), F.array(piece(F.col("start"), third, F.col("title"), True), piece(third, F.col("end"), more(2), False)))
    split = split.when(F.col("known") & (F.col("no") == F.col("n")) & (F.col("n") == 1), F.array(piece(F.col("start"), third, F.col("title"), True), piece(third, quarter, more(1), False), piece(quarter, F.col("end"), more(2), False)))
    split = split.otherwise(F.array(piece(F.col("start"), F.col("end"), F.col("title"), True)))
    out = all_.select("episode", F.posexplode(split).alias("k", "c"), "no").select("episode", "no", "k", "c.*")
    return out.withColumn("no", F.row_number().over(Window.partitionBy("episode").orderBy("no", "k"))).drop("k")


def ffmeta(media: DataFrame, spans: DataFrame) -> DataFrame:
    title = F.regexp_replace("title", r"([\\=;#])", r"\\$1")
    text = F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start").cast("string"), F.lit("\nEND="), F.col("end").cast("string"), F.lit("\ntitle="), title, F.lit("\n"))
    return _joined(chapter_list(media, spans), media, text, ["no"], head=";FFMETADATA1\n")


def chapters(media: DataFrame, spans: DataFrame) -> DataFrame:
    """JSON chapters 1.2; chapters of spans carry their end and a ``span`` object."""
    plain = F.struct((F.col("start") / 1000).alias("startTime"), "title", F.lit(True).alias("toc"))
    own = F.struct((F.col("start") / 1000).alias("startTime"), "title", F.lit(True).alias("toc"), (F.col("end") / 1000).alias("endTime"), F.struct("id", "category", "form", "action", "confidence", F.lit(C.PROFILE).alias("profile")).alias("span"))
    item = F.when(F.col("id").isNull(), F.to_json(plain)).otherwise(F.to_json(own, {"ignoreNullFields": "false"}))
    return _joined(chapter_list(media, spans), media, item, ["no"], ",", '{"version":"1.2.0","chapters":[', "]}\n")


def caption_cues(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(episode, idx, piece, s, e, text, id, state, ...) of the whole transcript, marked with the spans of state ad or
    uncertain.

    A segment with words is cut at span edges inside it: a cue holds the words that begin in its piece and takes the
    span at its middle.  Without words a segment takes the span at its middle, else the one that overlaps it most, if
    spans cover half of it.  Empty and zero-length segments make no cue.
    """
    live = spans.where("state in ('ad', 'uncertain')")
    cols = ["id", "category", "advertiser", "state"]
    held = live.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("start", "end", *cols))).alias("live"))
    rows = segments.where("end > start and trim(coalesce(text, '')) <> ''").join(held, "episode", "left").withColumn("live", F.coalesce("live", F.array()))
    rows = rows.withColumn("live", F.filter("live", lambda x: (x["start"] < F.col("end")) & (x["end"] > F.col("start"))))
    edges = F.flatten(F.transform("live", lambda x: F.array(x["start"], x["end"])))
    edges = F.array_sort(F.array_distinct(F.filter(edges, lambda p: (p > F.col("start")) & (p < F.col("end")))))
    has = F.size(F.coalesce("words", F.array())) > 0
    rows = rows.withColumn("_e", F.when(has, edges).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_e", F.concat(F.array("start"), "_e", F.array("end")))
    rows = rows.select("*", F.posexplode(F.arrays_zip(F.slice("_e", 1, F.size("_e") - 1).alias("a"), F.slice("_e", 2, F.size("_e") - 1).alias("b"))).alias("piece", "p"))
    cut = F.size("_e") > 2
    own = F.filter("words", lambda w: (w["s"] >= F.col("p.a")) & (w["s"] < F.col("p.b")))
    rows = rows.withColumn("_w", F.when(cut, own)).where(F.col("_w").isNull() | (F.size("_w") > 0))
    s = F.when(cut, F.greatest(F.col("p.a"), F.element_at("_w", 1)["s"])).otherwise(F.col("start"))
    rows = rows.withColumn("s", s)
    e = F.when(cut, F.greatest(F.col("s") + 1, F.least(F.col("p.b"), F.array_max(F.transform("_w", lambda w: w["e"]))))).otherwise(F.col("end"))
    rows = rows.withColumn("e", e).withColumn("text", F.when(cut, F.array_join(F.transform("_w", lambda w: F.trim(w["w"])), " ")).otherwise(F.trim("text")))
    middle = (F.col("s") + F.col("e")) / 2
    at = F.get(F.filter("live", lambda x: (x["start"] <= middle) & (x["end"] > middle)), F.lit(0))
    shared = lambda x: overlap(x["start"], x["end"], F.col("s"), F.col("e"))
    most = F.aggregate("live", F.lit(0).cast("long"), lambda m, x: F.greatest(m, shared(x)))
    total = F.aggregate("live", F.lit(0).cast("long"), lambda m, x: m + shared(x))
    best = F.get(F.filter("live", lambda x: shared(x) == most), F.lit(0))
    span = F.when(cut, at).when(total * 2 >= F.col("e") - F.col("s"), F.coalesce(at, best))
    return rows.withColumn("span", span).select("episode", "idx", "piece", "s", "e", "text", *[F.col(f"span.{c}").alias(c) for c in cols])


def _caption_text() -> Column:
    mark = F.when(F.col("state") == "uncertain", "[Ad?]").otherwise(title_of("category", "advertiser"))
    return F.when(F.col("id").isNull(), F.col("text")).otherwise(F.concat(mark, F.lit(" "), "text"))


def _cue_rows(segments: DataFrame, spans: DataFrame) -> DataFrame:
    return caption_cues(segments, spans).withColumn("no", F.row_number().over(Window.partitionBy("episode").orderBy("idx", "piece")))


def captions_vtt(media: DataFrame, spans: DataFrame, segments: DataFrame) -> DataFrame:
    body = escape_cue(_caption_text())
    body = F.when(F.col("id").isNull(), body).otherwise(F.concat(F.lit("<c.span-ad>"), body, F.lit("</c>")))
    name = F.concat(F.coalesce("id", F.lit("seg")), F.lit("."), F.col("no").cast("string"))
    head = f"WEBVTT - {C.PROFILE} captions\n\nSTYLE\n::cue(.span-ad) {{ font-style: italic; }}\n\n"
    return _joined(_cue_rows(segments, spans), media, F.concat(name, F.lit("\n"), format_stamp("s"), F.lit(" --> "), format_stamp("e"), F.lit("\n"), body, F.lit("\n\n")), ["no"], head=head)


def captions_srt(media: DataFrame, spans: DataFrame, segments: DataFrame) -> DataFrame:
    return _joined(_cue_rows(segments, spans), media, F.concat(F.col("no").cast("string"), F.lit("\n"), format_stamp("s", ","), F.lit(" --> "), format_stamp("e", ","), F.lit("\n"), _caption_text(), F.lit("\n\n")), ["no"], empty="")


RENDER: dict[str, Callable[..., DataFrame]] = {"edl": edl, "ffmeta": ffmeta, "chapters": chapters, "sponsorblock": sponsorblock, "vtt": vtt, "srt": srt, "audacity": audacity, "rttm": rttm}
WITH_TRANSCRIPT: dict[str, Callable[..., DataFrame]] = {"captions-vtt": captions_vtt, "captions-srt": captions_srt}
SUFFIX = {"edl": ".edl", "ffmeta": ".ffmeta", "chapters": ".chapters.json", "sponsorblock": ".sponsorblock.json", "vtt": ".spans.vtt", "srt": ".spans.srt", "audacity": ".labels.txt", "rttm": ".rttm", "captions-vtt": ".captions.vtt", "captions-srt": ".captions.srt"}


def export_all(media: DataFrame, spans: DataFrame, segments: DataFrame | None = None, formats: list[str] | None = None) -> DataFrame:
    """(fmt, episode, body) of the formats; those that show the transcript have null bodies without segments."""
    out = None
    for fmt in formats or [*RENDER, *WITH_TRANSCRIPT]:
        if fmt in RENDER:
            part = RENDER[fmt](media, spans)
        elif segments is not None:
            part = WITH_TRANSCRIPT[fmt](media, spans, segments)
        else:
            part = media.select("episode", F.lit(None).cast("string").alias("body"))
        part = part.select(F.lit(fmt).alias("fmt"), "episode", "body")
        out = part if out is None else out.unionByName(part)
    return out


def write_exports(rendered: DataFrame, path: str) -> None:
    """One folder a format, committed as a whole by Spark's writer."""
    rendered.where("body is not null").write.partitionBy("fmt").mode("overwrite").json(path)
