"""Queries of readers, formats and small rules that the other books don't run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import spans, text, times
from spanloom.operators import align, metrics, speech
from spanloom.plans import views as V
from spanloom.plans.register import Book
from spanloom.sinks import exporters, records
from spanloom.sources import readers

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql


@book.add("select event_id as episode, 'A' || event_id as ad, user_id * 100 as s, user_id * 100 + 1601 as e, event_type as slot from events")
def stitch_header(spark: SparkSession, d: str) -> DataFrame:
    """Headers of one insertion each, decoded; times in milliseconds, which the header's bytes give as whole ones."""
    n = F.col("user_id") * 1600
    header = F.concat_ws("#", F.concat(F.lit("A"), F.col("event_id").cast("string")), (n + 25616 + 10).cast("string"), "event_type", F.lit("0"), (n + 10).cast("string"), F.lit("c1"))
    rows = V.read(spark, d, "events").select(F.col("event_id").alias("episode"), F.concat(header, F.lit("@guid#128000#10")).alias("header"))
    return readers.decode_stitch_header(rows).select("episode", "ad", "s", "e", "slot")


@book.add(f"with {V.RECORD} select episode, s, e, 3 as action from rec where action = 'skip'")
def edl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse_edl(exporters.edl(*V.record(spark, d)).withColumnRenamed("body", "raw")).select("episode", "s", "e", "action")


@book.add("with p as (select doc_id // 3 as k, doc_id % 3 as r from documents), q as (select k, min(r) as r from p group by k) select 'ep' || k as stem, 'run/ep' || k || case r when 0 then '_ads.json' when 1 then '.analysis.json' else '.spans.json' end as path from q")
def run_pick(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("run/ep"), F.floor(F.col("doc_id") / 3).cast("string"), F.element_at(F.array(F.lit("_ads.json"), F.lit(".analysis.json"), F.lit(".spans.json")), (F.col("doc_id") % 3 + 1).cast("int")))
    return readers.best_prediction(V.read(spark, d, "documents").select(name.alias("path"))).select("stem", "path")


@book.add("select event_id, date_trunc('second', ts) as at, strftime(ts, '%Y-%m-%d_%H%M') || '_' || event_type as stem, (user_id // 3600) || ':' || lpad((user_id // 60 % 60)::varchar, 2, '0') || ':' || lpad((user_id % 60)::varchar, 2, '0') as clock from events")
def dates(spark: SparkSession, d: str) -> DataFrame:
    """Feed dates written and read back (with a zone, without, GMT), stems and clock times."""
    zone = F.element_at(F.array(F.lit(" +0000"), F.lit(""), F.lit(" GMT")), (F.col("event_id") % 3 + 1).cast("int"))
    written = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), zone)
    t = V.read(spark, d, "events").withColumn("written", written)
    return t.select("event_id", times.rfc822("written").cast("timestamp_ntz").alias("at"), text.make_stem("ts", "event_type").alias("stem"), times.clock("user_id").alias("clock"))


@book.add("with t as (select event_id, case event_id % 5 when 0 then ' [Music] ' when 1 then 'You' when 2 then 'Thank you.' when 3 then '' else event_type end as text from events) select event_id, text from t where lower(trim(text)) not in ('', 'you', 'thank you.', 'thanks for watching!', '[music]', '(music)', '...')")
def junk_filter(spark: SparkSession, d: str) -> DataFrame:
    t = F.element_at(F.array(F.lit(" [Music] "), F.lit("You"), F.lit("Thank you."), F.lit(""), F.col("event_type")), (F.col("event_id") % 5 + 1).cast("int"))
    return readers.drop_junk(V.read(spark, d, "events").select("event_id", t.alias("text")))


@book.add("select page_id, case when page_id % 2 = 0 then 'ep' || page_id else 'ep' || page_id || '.v1' end as stem from pages")
def stem_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/x/ep"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "_stt.json").otherwise(".v1.json"))
    return V.read(spark, d, "pages").select("page_id", text.stem_of_path(path).alias("stem"))


@book.add("select page_id, replace(replace(left(html, 200), '-->', '-- >'), '<', '&lt;') as cue from pages")
def cue_escape(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "pages").select("page_id", text.escape_cue(F.substring("html", 1, 200)).alias("cue"))


@book.add("select event_id, case when event_id % 2 = 0 then user_id % 128 * 16384 + event_id % 128 + 10 else 0 end as size from events")
def id3_sizes(spark: SparkSession, d: str) -> DataFrame:
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    header = F.concat(F.when(F.col("event_id") % 2 == 0, F.unhex(F.lit("494433040000"))).otherwise(F.unhex(F.lit("000000040000"))), byte(F.lit(0)), byte(F.col("user_id") % 128), byte(F.lit(0)), byte(F.col("event_id") % 128))
    return V.read(spark, d, "events").select("event_id", spans.id3_size(header).alias("size"))


@book.add("with w as (select user_id % 20 as pair, (user_id % 7) / 4.0 + (event_id % 3) / 2.0 as off, value / 200 as ncc from events), g as (select pair, count(*) as windows, median(off)::double as \"offset\", (max(off) - min(off))::double as spread from w where ncc >= 0.4 group by pair) select *, spread <= 1.0 as consistent from g")
def offset_verdict(spark: SparkSession, d: str) -> DataFrame:
    w = V.read(spark, d, "events").select((F.col("user_id") % 20).alias("pair"), ((F.col("user_id") % 7) / 4 + (F.col("event_id") % 3) / 2).alias("offset"), (F.col("value") / 200).alias("ncc"))
    return align.verdict(w, ["pair"], 0.4)


@book.add("select case when contains(lower(url), 'afternoon') then 'afternoon' when contains(lower(url), 'sitrep') or contains(lower(url), 'situation report') then 'sitrep' else 'morning' end as kind, lang, count(*) as n from (select replace(url, '/en/', '/afternoon/') as url, regexp_extract(url, '/(..)/', 1) as lang from pages) group by all")
def draw_mix(spark: SparkSession, d: str) -> DataFrame:
    t = V.read(spark, d, "pages").select(F.replace("url", F.lit("/en/"), F.lit("/afternoon/")).alias("title"), F.regexp_extract("url", "/(..)/", 1).alias("lang"))
    return t.groupBy(text.kind_of_title("title").alias("kind"), "lang").agg(F.count(F.lit(1)).alias("n"))


@book.add("with m as (select doc_id as episode, coalesce(n_chars, 0) * 60 as dur from documents), n as (select *, greatest(1, ceil(dur / 7000.0))::bigint as n from m) select episode, piece, dur * piece // n as \"offset\", dur * (piece + 1) // n - dur * piece // n as length from (select *, unnest(range(0, n)) as piece from n)")
def equal_pieces(spark: SparkSession, d: str) -> DataFrame:
    return speech.equal_pieces(V.read(spark, d, "documents").select(F.col("doc_id").alias("episode"), (F.coalesce("n_chars", F.lit(0)) * 60).alias("duration_ms")), 7000)


@book.add("with t as (select conv_id as episode, turn // 4 as piece, turn % 4 as idx, role as speaker from conversations) select episode, row_number() over (partition by episode order by piece, idx) - 1 as idx, piece * 9000 + idx * 100 as start, piece * 9000 + idx * 100 + 90 as \"end\", case when speaker is not null then dense_rank() over (partition by episode order by piece, speaker nulls first) - 1 end as speaker from t")
def piece_join(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of pieces, shifted and numbered anew."""
    t = V.read(spark, d, "conversations").select(F.col("conv_id").alias("episode"), F.floor(F.col("turn") / 4).alias("piece"), (F.col("turn") % 4).alias("idx"), F.col("role").alias("speaker"))
    pieces = t.select("episode", "piece").distinct().withColumn("offset", F.col("piece") * 9000)
    turns = t.withColumns({"start": F.col("idx") * 100, "end": F.col("idx") * 100 + 90})
    return speech.join_pieces(turns, pieces).select("episode", F.col("idx").cast("long").alias("idx"), "start", "end", F.col("speaker").cast("long").alias("speaker"))


@book.add(f"with {V.CONV}, f as (select *, case when end_ms - start_ms < 6000 and row_number() over (partition by episode order by idx) > 1 then 0 else 1 end as first from conv), g as (select *, sum(first) over (partition by episode order by idx rows unbounded preceding) as g from f), a as (select episode, min(idx) as first, count(*) as n, min(start_ms) as start, max(end_ms) as \"end\", string_agg(text, ' ' order by idx) as text from g group by episode, g) select episode, row_number() over (partition by episode order by first) - 1 as idx, first, n, start, \"end\", coalesce(text, '') as text from a")
def fragments(spark: SparkSession, d: str) -> DataFrame:
    return speech.join_fragments(V.conv(spark, d).select("episode", "idx", "start", "end", "text"), 6000).withColumn("idx", F.col("idx").cast("long"))


@book.add("select distinct 'ep' || d.doc_id as stem, case when d.doc_id % 3 = 0 then 'no prediction' else 'ok' end as status from documents d join labels l on l.doc_id = d.doc_id")
def fixture_pairs(spark: SparkSession, d: str) -> DataFrame:
    stem = lambda t, c: V.read(spark, d, t).select(F.concat(F.lit("ep"), F.col(c).cast("string")).alias("stem"), F.col(c).alias("id"))
    return speech.pair_fixtures(stem("labels", "doc_id"), stem("documents", "doc_id"), stem("documents", "doc_id").where("id % 3 <> 0"))


@book.add("select doc_id, octet_length(encode(text)) as bytes, sha256(text) as sha256 from documents where text is not null")
def media_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    t = V.read(spark, d, "documents").where("text is not null")
    return t.select("doc_id", speech.fingerprint(F.col("text").cast("binary")).alias("f")).select("doc_id", "f.*")


@book.add(f"with {V.RECORD} select episode, s as start, e as \"end\", category, 'rec-' || episode || '-' || id as uuid from rec where action = 'skip'")
def sponsorblock_json(spark: SparkSession, d: str) -> DataFrame:
    """The exported JSON, parsed again, its seconds as whole milliseconds."""
    body = exporters.sponsorblock(*V.record(spark, d))
    rows = body.select("episode", F.explode(F.from_json("body", "array<struct<segment:array<double>,category:string,UUID:string>>")).alias("x"))
    return rows.select("episode", F.round(F.col("x.segment")[0] * 1000).cast("long").alias("start"), F.round(F.col("x.segment")[1] * 1000).cast("long").alias("end"), F.col("x.category").alias("category"), F.concat(F.lit("rec-"), F.col("episode").cast("string"), F.lit("-"), F.regexp_extract("x.UUID", "(ad-[0-9]+)$", 1)).alias("uuid"))


@book.add(f"with {V.EVT}, {V.IVA}, {V.IVB}, m as (select episode, max(e) as d from (select * from iva union all select * from ivb) group by episode), z as (select episode, min(s) as z from (select * from iva union all select * from ivb) group by episode), p as (select distinct i.episode, unnest(range(ceil((s - z) / 60000.0 - 0.5)::bigint, ceil((e - z) / 60000.0 - 0.5)::bigint)) as cell from iva i join z using (episode)), t as (select distinct i.episode, unnest(range(ceil((s - z) / 60000.0 - 0.5)::bigint, ceil((e - z) / 60000.0 - 0.5)::bigint)) as cell from ivb i join z using (episode)), c as (select coalesce(p.episode, t.episode) as episode, count(*) filter (p.cell is not null and t.cell is not null) as tp, count(*) filter (t.cell is null) as fp, count(*) filter (p.cell is null) as fn from p full join t on p.episode = t.episode and p.cell = t.cell group by 1), x as (select z.episode, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, ceil((d - z) / 60000.0)::bigint as n from z join m using (episode) left join c using (episode)), y as (select *, greatest(0, n - tp - fp - fn) as tn from x) select episode, tp, fp, fn, tn, (tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0) as mcc from y")
def grid_scores(spark: SparkSession, d: str) -> DataFrame:
    a, b = V.intervals(spark, d, "click"), V.intervals(spark, d, "purchase")
    zero = a.unionByName(b).groupBy("episode").agg(F.min("s").alias("zero"), F.max("e").alias("to"))
    at = lambda t: t.join(zero, "episode").select("episode", (F.col("s") - F.col("zero")).alias("s"), (F.col("e") - F.col("zero")).alias("e"))
    return metrics.grid_scores(at(a), at(b), zero.select("episode", (F.col("to") - F.col("zero")).alias("duration_ms")), 60_000)


@book.add(f"with {V.IVA}, {V.IVB}, near as (select a.episode, a.s, a.e, b.s as ts, b.e as te from iva a join ivb b on a.episode = b.episode and a.s < b.e and a.e > b.s where least(a.e, b.e) - greatest(a.s, b.s) >= 0.1 * (greatest(a.e, b.e) - least(a.s, b.s))), h as (select episode, count(*) as hits from (select distinct episode, s, e from near) group by episode), g as (select episode, count(*) as met from (select distinct episode, ts, te from near) group by episode), na as (select episode, count(*) as n_found from iva group by episode), nb as (select episode, count(*) as n_truth from ivb group by episode), x as (select episode, coalesce(n_found, 0) as n_found, coalesce(n_truth, 0) as n_truth, coalesce(hits, 0) as hits, coalesce(met, 0) as met from na full join nb using (episode) left join h using (episode) left join g using (episode)), y as (select *, hits::double / nullif(n_found, 0) as p, met::double / nullif(n_truth, 0) as r from x) select episode, n_found, n_truth, hits, coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0) as f from y")
def event_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.event_scores(V.intervals(spark, d, "click"), V.intervals(spark, d, "purchase"), 0.1)


@book.add(f"with {V.VOTES} select episode, idx, votes / 3.0::double as share from tally where votes > 0")
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    tally = V.votes(spark, d).groupBy("episode", "idx").agg(F.count_if(F.col("flag") == "a").alias("votes"))
    return metrics.agreement(tally, 3)


@book.add("select event_type, '| ' || event_type || ' | ' || count(*) || ' | ' || count(distinct user_id) || ' |' as line from events group by event_type")
def table_lines(spark: SparkSession, d: str) -> DataFrame:
    t = V.read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return t.select("event_type", records.table_line("event_type", "n", "users").alias("line"))
