"""Queries of records and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans import views as V
from spanloom.plans.register import Book
from spanloom.sinks import exporters, records
from spanloom.sources import readers

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql

_SEC = "{0} // 1000 || '.' || lpad(({0} % 1000)::varchar, 3, '0')"
_STAMP = "printf('%02d:%02d:%02d{1}%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_TITLE = "case category when 'sponsor' then '[Ad]' else '[Promo]' end || case when advertiser is not null then ' ' || advertiser else '' end"


@book.add(f"with {V.RECORD} select episode, id, s as start, e as \"end\", category, form, position, action, state, confidence, edge_mode, advertiser from rec")
def record_struct(spark: SparkSession, d: str) -> DataFrame:
    return V.record(spark, d)[1]


@book.add(f"with {V.RECORD} select m.episode, duration_ms, count(id) as n_spans, count(*) filter (action = 'skip') as n_skip, case when count(*) filter (e <= s) > 0 then string_agg(case when e <= s then id || ': end before start' end, '; ' order by s, e, id) else '' end as problems from media m left join rec r on r.episode = m.episode group by m.episode, duration_ms")
def record_check(spark: SparkSession, d: str) -> DataFrame:
    media, spans = V.record(spark, d)
    out = records.problems(records.build_records(media, spans))
    return out.select("episode", "duration_ms", F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda x: x["action"] == "skip")).cast("long").alias("n_skip"), F.array_join("problems", "; ").alias("problems"))


@book.add(f"with {V.RECORD} select m.episode, coalesce(string_agg({_SEC.format('s')} || chr(9) || {_SEC.format('e')} || chr(9) || '3' || chr(10), '' order by s, e), '') as body from media m left join (select * from rec where action = 'skip') r on r.episode = m.episode group by m.episode")
def export_edl(spark: SparkSession, d: str) -> DataFrame:
    return exporters.edl(*V.record(spark, d))


@book.add(f"with {V.RECORD} select m.episode, coalesce(string_agg({_SEC.format('s')} || chr(9) || {_SEC.format('e')} || chr(9) || {_TITLE} || chr(10), '' order by s, e), '') as body from media m left join rec r on r.episode = m.episode group by m.episode")
def export_audacity(spark: SparkSession, d: str) -> DataFrame:
    return exporters.audacity(*V.record(spark, d))


@book.add(f"with {V.RECORD} select m.episode, coalesce(string_agg('SPEAKER user-' || r.episode || ' 1 ' || {_SEC.format('s')} || ' ' || {_SEC.format('(e - s)')} || ' <NA> <NA> ' || category || ' <NA> <NA>' || chr(10), '' order by s, e), '') as body from media m left join rec r on r.episode = m.episode group by m.episode")
def export_rttm(spark: SparkSession, d: str) -> DataFrame:
    return exporters.rttm(*V.record(spark, d))


@book.add(f"with {V.RECORD}, n as (select *, row_number() over (partition by episode order by s, e, id) as no from rec) select m.episode, coalesce(string_agg(no || chr(10) || {_STAMP.format('s', ',')} || ' --> ' || {_STAMP.format('e', ',')} || chr(10) || {_TITLE} || chr(10) || chr(10), '' order by no), '') as body from media m left join n on n.episode = m.episode group by m.episode")
def export_srt(spark: SparkSession, d: str) -> DataFrame:
    return exporters.srt(*V.record(spark, d))


@book.add(f"with {V.RECORD} select r.episode, s as start, e as \"end\", upper(category) as token, id, category, form, position, action, state, advertiser, confidence from rec r")
def export_vtt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The metadata track, written and read back."""
    body = exporters.vtt(*V.record(spark, d))
    return readers.parse_disclosure(body.withColumnRenamed("body", "raw"))


_CHAPTERS = f"""{V.RECORD}, mk as (select *, coalesce(lag(e) over (partition by episode order by s, e, id), 0) as prev from rec),
gaps as (select episode, prev as s, s as e from mk where s > prev + 500 union all select m.episode, coalesce(l.last, 0), m.duration_ms from media m left join (select episode, arg_max(e, (s, e, id)) as last from rec group by episode) l on l.episode = m.episode where m.duration_ms > coalesce(l.last, 0) + 500),
parts as (select episode, s, e, 'Part ' || row_number() over (partition by episode order by s) as title, null as id from gaps),
a0 as (select episode, s, e, title, id from parts union all select episode, s, e, {_TITLE}, id from rec),
a1 as (select * from a0 union all select m.episode, 0, coalesce(f, m.duration_ms), 'Start', null from media m left join (select episode, min(s) as f from a0 group by episode) x on x.episode = m.episode where f is null or f > 0),
a2 as (select *, count(*) over (partition by episode) as n, row_number() over (partition by episode order by s, (id is null) desc) as no from a1),
a3 as (select *, n < 3 and no = n as halved, e - (e - s) // 2 as h, count(*) filter (starts_with(title, 'Part ')) over (partition by episode) as np from a2),
a4 as (select episode, s, case when halved then h else e end as e, title, id from a3 union all
  select episode, h, case n when 1 then e - (e - h) // 2 else e end, 'Part ' || (np + case n when 1 then 1 else 2 end), null from a3 where halved union all
  select episode, e - (e - h) // 2, e, 'Part ' || (np + 2), null from a3 where halved and n = 1),
ch as (select *, row_number() over (partition by episode order by s, (id is null) desc) as no from a4)"""


@book.add(f"with {_CHAPTERS} select episode, no::int as no, s as start, e as \"end\", title, id from ch")
def chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapter lists of all episodes, short ones halved."""
    return exporters.chapter_list(*V.record(spark, d)).select("episode", "no", "start", "end", "title", "id")


@book.add(f"with {_CHAPTERS} select episode, ';FFMETADATA1' || chr(10) || string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || s || chr(10) || 'END=' || e || chr(10) || 'title=' || title || chr(10), '' order by no) as body from ch group by episode")
def export_ffmeta(spark: SparkSession, d: str) -> DataFrame:
    return exporters.ffmeta(*V.record(spark, d))


@book.add()
def export_json_formats(spark: SparkSession, d: str) -> DataFrame:
    """chapters and sponsorblock; their JSON numbers are printed differently by other engines."""
    return exporters.export_all(*V.record(spark, d), formats=["chapters", "sponsorblock"])


@book.add(f"with {V.CONV}, sp as (select episode, idx as k, start_ms + 1000 as s, end_ms + 1500 as e, 'ad-' || lpad(idx::varchar, 4, '0') as id, case when idx % 4 = 2 then 'uncertain' else 'ad' end as state from conv where idx % 2 = 0), g as (select c.episode, c.idx, c.start_ms, c.end_ms, c.text, sum(greatest(0, least(s.e, c.end_ms) - greatest(s.s, c.start_ms))) as total, arg_min(struct_pack(id := s.id, state := s.state), (s.s, s.e)) filter (s.s <= (c.start_ms + c.end_ms) / 2 and s.e > (c.start_ms + c.end_ms) / 2) as mid, arg_min(struct_pack(id := s.id, state := s.state), (-greatest(0, least(s.e, c.end_ms) - greatest(s.s, c.start_ms)), s.s, s.e)) as best from conv c left join sp s on s.episode = c.episode and s.s < c.end_ms and s.e > c.start_ms where c.end_ms > c.start_ms and trim(coalesce(c.text, '')) <> '' group by all) select episode, idx, start_ms as s, end_ms as e, trim(text) as text, case when total * 2 >= end_ms - start_ms then coalesce(mid, best).id end as id, case when total * 2 >= end_ms - start_ms then coalesce(mid, best).state end as state from g")
def caption_cues(spark: SparkSession, d: str) -> DataFrame:
    conv = V.conv(spark, d)
    spans = conv.where("idx % 2 = 0").select("episode", (F.col("start") + 1000).alias("start"), (F.col("end") + 1500).alias("end"), F.concat(F.lit("ad-"), F.lpad(F.col("idx").cast("string"), 4, "0")).alias("id"), F.lit("sponsor").alias("category"), F.lit(None).cast("string").alias("advertiser"), F.when(F.col("idx") % 4 == 2, "uncertain").otherwise("ad").alias("state"))
    segments = conv.select("episode", "idx", "start", "end", "text", F.array().cast("array<struct<w:string,s:bigint,e:bigint>>").alias("words"))
    return exporters.caption_cues(segments, spans).select("episode", "idx", "s", "e", "text", "id", "state")


@book.add(f"with {V.CONV} select episode, count(*) as cues, min(start_ms) as first_ms, max(end_ms) as last_ms, sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))))::bigint as chars from conv where end_ms > start_ms and trim(text) <> '' group by episode")
def captions_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whole transcripts as subtitles without marks, written and read back."""
    conv = V.conv(spark, d)
    segments = conv.select("episode", "idx", "start", "end", "text", F.array().cast("array<struct<w:string,s:bigint,e:bigint>>").alias("words"))
    none = spark.createDataFrame([], "episode bigint, start bigint, end bigint, id string, category string, advertiser string, state string")
    body = exporters.captions_srt(conv.select("episode").distinct(), none, segments)
    cues = readers.parse_captions(body.withColumnRenamed("body", "raw"))
    return cues.groupBy("episode").agg(F.count(F.lit(1)).alias("cues"), F.min("start").alias("first_ms"), F.max("end").alias("last_ms"), F.sum(F.length("text")).alias("chars"))
