"""Queries of text, time stamps, windows, quotes and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import model_json, spans, text, times
from spanloom.operators import chunking
from spanloom.operators.align import align
from spanloom.operators.quotes import match_quotes
from spanloom.plans import views as V
from spanloom.plans.register import Book
from spanloom.sinks import records
from spanloom.sources import readers

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql

#: Twins of the text expressions in DuckDB's SQL.
_W = r"[\p{L}\p{N}_]"


def _norm_sql(t: str) -> str:
    s = f"translate(lower(coalesce({t}, '')), '’‘—–', '''''  ')"
    for _ in range(2):
        s = f"regexp_replace({s}, '({_W})-({_W})', '\\1\\2', 'g')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]+', ' ', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def _spoken_sql(t: str) -> str:
    """Words of reduced text are apart by single spaces, so word borders are spaces; every rule runs twice for neighbours."""
    s = f"' ' || {t} || ' '"
    s = f"regexp_replace({s}, ' dot com ', ' com ', 'g')"
    for w in ("slash", "and", "the"):
        for _ in range(2):
            s = f"replace({s}, ' {w} ', '  ')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


@book.add(f"with {V.CONV} select episode, idx, start_ms as start, end_ms as \"end\" from conv")
def seg_conv(spark: SparkSession, d: str) -> DataFrame:
    return V.conv(spark, d).select("episode", "idx", "start", "end")


@book.add(f"with {V.CONV}, m as (select episode, idx as turn, start_ms, dur, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(10) || chr(9)) <> '') as xs from conv where text is not null), u as (select episode, turn, start_ms, dur, i - 1 as idx, xs[i] as sentence from (select *, unnest(range(1, len(xs) + 1)) as i from m)), c as (select *, length(sentence) as n, sum(length(sentence)) over w as total, coalesce(sum(length(sentence)) over (w order by idx rows between unbounded preceding and 1 preceding), 0) as before from u window w as (partition by episode, turn)) select episode, turn, idx::int as idx, sentence, (start_ms + dur * before // total)::bigint as start, (start_ms + dur * (before + n) // total)::bigint as \"end\" from c")
def seg_sentence(spark: SparkSession, d: str) -> DataFrame:
    t = V.conv(spark, d).select("episode", F.col("idx").alias("turn"), "start", F.col("dur").alias("duration"), "text")
    return readers.proportional(t, ["episode", "turn"])


@book.add("select page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) as text from pages")
def caption_clean(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "pages").select("page_id", text.clean_caption("html").alias("text"))


@book.add(f"with {V.CONV} select episode, idx, printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) as stamp, start_ms as parsed, (start_ms // 3600000 * 3600000) + start_ms % 3600000 as comma from conv")
def ts_parse(spark: SparkSession, d: str) -> DataFrame:
    t = V.conv(spark, d).withColumn("stamp", times.format_stamp("start"))
    return t.select("episode", "idx", "stamp", times.parse_stamp("stamp").alias("parsed"), times.parse_stamp(times.format_stamp("start", ",")).alias("comma"))


@book.add("select doc_id, (length(coalesce(text, '')) // 4 + 8)::bigint as tokens, ((length(coalesce(text, '')) // 4 + 8) * 2.5::double + 0) / 1000000 as cost from documents")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select("doc_id", text.token_estimate("text").alias("tokens")).withColumn("cost", spans.cost("tokens", F.lit(0), F.lit(2.5), F.lit(0.0)))


_PLAN = f"""{V.LINES}, cost as (select episode, idx, (length(text) // 4 + 8)::bigint as c from lines), tot as (select episode, count(*) as n, sum(c) as total from cost group by episode),
bud as (select episode, n, greatest(8 * 9, 400 - 6 * (total // n + 1)) as budget from tot),
walk as (select c.episode, c.idx, 0 as a, c as used, c as est, n, budget, 0 as chunk from cost c join bud b using (episode) where idx = 0
  union all select w.episode, c.idx, case when cut and long then c.idx else w.a end, case when cut and long then c.c else case when cut then w.used else w.used + c.c end end, 0, w.n, w.budget, case when cut and long then w.chunk + 1 else w.chunk end
  from (select w.*, c.c, c.idx as ci, c.idx - w.a >= 9 and w.used + c.c > budget as cut, n - c.idx >= 3 as long from walk w join cost c on c.episode = w.episode and c.idx = w.idx + 1) w join cost c on c.episode = w.episode and c.idx = w.ci)"""


@book.add(f"with recursive {_PLAN} select episode, chunk, min(idx)::int as a, (max(idx) + 1)::int as b, arg_max(used, idx)::bigint as est_tokens from walk group by episode, chunk")
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return chunking.plan_chunks(V.lines(spark, d).select("episode", "idx", "text"), 400, 3)


@book.add(f"with recursive {_PLAN}, ch as (select episode, chunk, min(idx) as a, max(idx) + 1 as b from walk group by episode, chunk) select l.episode, ch.chunk, l.idx, l.idx < a or l.idx >= b as is_context, case when l.idx < a or l.idx >= b then '[CONTEXT] ' else '' end || l.idx || chr(9) || l.idx || '.0' || chr(9) || trim(translate(l.text, chr(9) || chr(10), '  ')) as line from ch join lines l on l.episode = ch.episode and l.idx >= a - 3 and l.idx < b + 3")
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    t = V.lines(spark, d)
    return chunking.prompt_lines(chunking.with_context(chunking.plan_chunks(t.select("episode", "idx", "text"), 400, 3), t, 3)).select("episode", "chunk", "idx", "is_context", "line")


@book.add(f"with {V.CONV} select episode, count(*) as segments, sum(length(text) - length(replace(text, '.', '')))::bigint as stops, sum(length(text) - length(replace(text, '?', '')))::bigint as questions, sum(length(text) - length(replace(text, '.', '')))::double / count(*) as density from conv group by episode")
def question_density(spark: SparkSession, d: str) -> DataFrame:
    stops = F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))
    return V.conv(spark, d).groupBy("episode").agg(F.count(F.lit(1)).alias("segments"), F.sum(stops).alias("stops"), F.sum(text.question_count("text")).alias("questions"), (F.sum(stops) / F.count(F.lit(1))).alias("density"))


@book.add(f"with {V.EVT} select episode, idx, greatest(0, least(idx - 2, idx + 3))::int as i, least(idx + 3, 19)::int as j, case when idx - 2 > 19 then 'outside' when idx - 2 < 0 or idx + 3 > 19 then 'clipped' else 'kept' end as what from evt")
def span_clip(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators.ladder import clip

    t = V.evt(spark, d).select("episode", "idx")
    cand = t.select("episode", F.lit(0).alias("chunk"), F.col("idx").alias("ord"), (F.col("idx") - 2).alias("start_index"), (F.col("idx") + 3).alias("end_index"))
    chunks = t.select("episode").distinct().select("episode", F.lit(0).alias("chunk"), F.lit(0).alias("a"), F.lit(20).alias("b"))
    kept, log = clip(cand, chunks)
    what = log.select(F.col("episode").alias("e"), F.col("ord").alias("o"), F.when(F.col("reason") == "clipped", "clipped").otherwise("outside").alias("what"))
    kept = kept.select(F.col("episode").alias("e"), F.col("ord").alias("o"), F.col("start_index").alias("i"), F.col("end_index").alias("j"))
    same = F.col("episode").eqNullSafe(F.col("e")) & (F.col("idx") == F.col("o"))
    out = t.join(kept, same, "left").drop("e", "o").join(what, same, "left")
    return out.select("episode", "idx", F.coalesce("i", F.col("idx") - 2).alias("i"), F.coalesce("j", F.lit(19)).alias("j"), F.coalesce("what", F.lit("kept")).alias("what"))


@book.add(f"with {V.EVT}, s as (select episode, idx, confidence, case when confidence >= 0.75 then 'ad' when confidence >= 0.4 then 'uncertain' else 'content' end as state, case kind when 'other' then 'midroll' else kind end as kind from evt) select episode, idx, confidence, state, kind, case kind when 'house' then 'selfpromo' else 'sponsor' end as category, 'host_read' as form, case kind when 'house' then 'unknown' else kind end as position, case when state = 'ad' and kind <> 'house' then 'skip' when state <> 'content' then 'prompt' else 'none' end as action from s")
def state_action(spark: SparkSession, d: str) -> DataFrame:
    t = V.evt(spark, d).select("episode", "idx", spans.clamp_confidence(F.col("value") / 200).alias("confidence"), spans.kind_or_default("kind").alias("kind"))
    t = t.withColumns({"state": spans.state_for("confidence"), "category": spans.category_of("kind"), "form": spans.form_of("kind"), "position": spans.position_of("kind")})
    return t.withColumn("action", spans.action_for("category", "state"))


@book.add(f"select doc_id, {_norm_sql('text')} as text from documents")
def quote_norm(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select("doc_id", text.normalize_quote("text").alias("text"))


@book.add(f"""with q as (select item_id, {_norm_sql('text')} as n from benchmark), h as (select doc_id, {_norm_sql('text')} as h from documents),
qf as (select item_id, n, replace(n, ' ', '') as tn, {_spoken_sql('n')} as sn, string_split(n, ' ') as nt from q where n <> ''), hf as (select doc_id, h, replace(h, ' ', '') as th, {_spoken_sql('h')} as sh, list_distinct(string_split(h, ' ')) as ht from h where h <> ''),
p as (select item_id, doc_id, case when contains(h, n) then 'exact' when contains(th, tn) then 'spaceless' when sn <> '' and contains(sh, sn) then 'spoken' when len(list_filter(nt, lambda w: list_contains(ht, w)))::double / len(nt) >= 0.7 then 'overlap' end as tier from qf cross join hf)
select item_id, doc_id, tier from p where tier is not null""")
def quote_match(spark: SparkSession, d: str) -> DataFrame:
    return match_quotes(V.read(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")), V.read(spark, d, "documents").select("doc_id", "text"))


@book.add(f"""with {V.LINES}, l as (select *, lead(text) over (partition by episode order by idx) as t1 from lines), q as (select *, array_to_string(list_slice(string_split(text || ' ' || t1, ' '), greatest(1, len(string_split(text, ' ')) - 1), greatest(1, len(string_split(text, ' ')) - 1) + 4), ' ') as quote from l where t1 is not null)
select episode, idx, contains({_norm_sql('text')}, {_norm_sql('quote')}) as first, contains({_norm_sql("text || ' ' || t1")}, {_norm_sql('quote')}) as across from q where {_norm_sql('quote')} <> ''""")
def quote_straddle(spark: SparkSession, d: str) -> DataFrame:
    t = V.lines(spark, d).withColumn("t1", F.lead("text").over(Window.partitionBy("episode").orderBy("idx"))).where("t1 is not null")
    at = F.greatest(F.lit(1), F.size(F.split("text", " ")) - 1)
    both = F.concat("text", F.lit(" "), "t1")
    t = t.withColumn("quote", F.array_join(F.slice(F.split(both, " "), at, 5), " ")).where(text.normalize_quote("quote") != "")
    return t.select("episode", "idx", F.contains(text.normalize_quote("text"), text.normalize_quote("quote")).alias("first"), F.contains(text.normalize_quote(both), text.normalize_quote("quote")).alias("across"))


@book.add(f"with {V.CONV}, t as (select episode, idx, string_split({_norm_sql('text')}, ' ') as xs from conv where text is not null), u as (select episode, idx, xs, xs[len(xs) // 2 + 1] as w from t) select episode, idx, w, list_position(xs, w)::int - 1 as at, len(xs) - list_position(list_reverse(xs), w)::int as last from u")
def word_index(spark: SparkSession, d: str) -> DataFrame:
    t = V.conv(spark, d).where("text is not null").select("episode", "idx", F.split(text.normalize_quote("text"), " ").alias("xs"))
    t = t.withColumn("w", F.get("xs", F.floor(F.size("xs") / 2).cast("int")))
    return t.select("episode", "idx", "w", text.word_index_of(F.col("xs"), F.array("w")).alias("at"), text.word_index_of(F.col("xs"), F.array("w"), True).cast("long").alias("last"))


@book.add(f"with {V.CONV}, req as (select episode, idx, sha256('v1|m|' || role || chr(10) || chr(0) || chr(10) || coalesce(text, '')) as key from conv), rsp as (select key, min(idx) as reply from req where idx % 2 = 0 group by key) select r.episode, r.idx, r.key, p.reply, case when p.reply is null then 'no recorded reply' end as error from req r left join rsp p using (key)")
def replay_join(spark: SparkSession, d: str) -> DataFrame:
    req = V.conv(spark, d).select("episode", "idx", text.replay_key(F.lit("v1"), F.lit("m"), "role", F.coalesce("text", F.lit(""))).alias("key"))
    rsp = req.where("idx % 2 = 0").groupBy("key").agg(F.min("idx").alias("obj"))
    return readers.replay(req, rsp).select("episode", "idx", "key", F.col("obj").alias("reply"), "error")


@book.add("select page_id, trim(regexp_replace(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60), '_+$', '')) as slug, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') as norm, case when contains(lower(url), 'afternoon') then 'afternoon' when contains(lower(url), 'sitrep') or contains(lower(url), 'situation report') then 'sitrep' else 'morning' end as kind from pages")
def title_slug(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "pages").select("page_id", text.slugify("url").alias("slug"), text.norm_title("url").alias("norm"), text.kind_of_title("url").alias("kind"))


@book.add("with i as (select event_id as guid, event_type || ' ' || user_id as title, ts, value from events), w as (select *, md5(guid || '#7') as h from i where ts <= timestamp '2024-03-01' and ts >= timestamp '2024-03-01' - interval 90 day and not starts_with(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 'error') and not starts_with(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 'view1')), r as (select guid, title, row_number() over (order by h, guid) as place from w) select guid, title, place, place <= 200 as drawn from r")
def rss_select(spark: SparkSession, d: str) -> DataFrame:
    items = V.read(spark, d, "events").select(F.col("event_id").alias("guid"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("title"), F.col("ts").alias("published"), F.lit("u").alias("enclosure"))
    excluded = spark.createDataFrame([("Error",), ("View 1",)], "prefix string")
    return readers.select_feed(items, excluded, F.expr("timestamp_ntz'2024-03-01 00:00:00'"), 90, 200, 7).select("guid", "title", F.col("place").cast("long").alias("place"), "drawn")


@book.add(f"with {V.CONV} select episode, sha256(string_agg(start_ms || chr(9) || end_ms || chr(9) || coalesce(text, ''), chr(10) order by idx)) as sha256 from conv group by episode")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return records.content_hash(V.conv(spark, d))


@book.add(f"with {V.CONV} select role, count(*) as n, avg(dur) as mean_ms, quantile_cont(dur, 0.5)::double as median_ms, quantile_cont(dur, 0.9)::double as p90_ms, avg(case when dur < 10000 then 1.0::double else 0.0::double end) as short_share from conv group by role")
def seg_length_dist(spark: SparkSession, d: str) -> DataFrame:
    return V.conv(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.avg("dur").alias("mean_ms"), F.percentile("dur", 0.5).alias("median_ms"), F.percentile("dur", 0.9).alias("p90_ms"), F.avg(F.when(F.col("dur") < 10_000, 1.0).otherwise(0.0)).alias("short_share"))


@book.add("with d as (select doc_id, md5(text) as sha, length(text) as bytes, n_chars from documents), a as (select * from d where doc_id % 2 = 0), b as (select doc_id - 1 as doc_id, sha, bytes, n_chars from d where doc_id % 2 = 1) select a.doc_id as guid, case when a.sha = b.sha then 'identical' else 'differs' end as verdict, b.bytes - a.bytes as size_delta, b.n_chars - a.n_chars as duration_delta_ms from a left join b using (doc_id)")
def copy_verdict(spark: SparkSession, d: str) -> DataFrame:
    t = V.read(spark, d, "documents")
    rows = t.select((F.col("doc_id") - F.col("doc_id") % 2).alias("guid"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("copy"), F.md5("text").alias("sha256"), F.length("text").cast("long").alias("bytes"), F.col("n_chars").alias("duration_ms"))
    return readers.compare_copies(rows)


@book.add("select event_id, event_id % 4 <> 3 as found, case event_id % 4 when 0 then '{\"a\":' || user_id || '}' when 1 then '{\"s\": \"}\"}' when 2 then '{\"b\":{\"c\":[1]}}' end as obj from events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit('{"a":'), F.col("user_id").cast("string"), F.lit("}"))).when(k == 1, F.lit('<think>{no}</think>here {oops} it is: {"s": "}"} end')).when(k == 2, F.lit('text {"b":{"c":[1]}} more')).otherwise(F.lit("no object { at all"))
    t = V.read(spark, d, "events").select("event_id", model_json.extract_object(reply).alias("obj"))
    return t.select("event_id", F.col("obj").isNotNull().alias("found"), "obj")


@book.add("select vec_id, label, list_sum(list_transform(embedding, lambda x: x::double)) / len(embedding) as mean, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)) as rms from embeddings")
def envelope_stats(spark: SparkSession, d: str) -> DataFrame:
    total = lambda f: F.aggregate("embedding", F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    return V.read(spark, d, "embeddings").select("vec_id", "label", (total(lambda x: x) / F.size("embedding")).alias("mean"), F.sqrt(total(lambda x: x * x) / F.size("embedding")).alias("rms"))


@book.add("with s as (select vec_id, list_transform(embedding, lambda x: x::double) as signal from embeddings), w as (select vec_id, signal, (vec_id % 40)::int as pos from s) select vec_id as pair_id, pos as \"offset\", true as sure from w")
def ncc_align(spark: SparkSession, d: str) -> DataFrame:
    signal = F.col("embedding").cast("array<double>")
    pairs = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("pair_id"), signal.alias("signal"), F.transform(F.slice(signal, (F.col("vec_id") % 40 + 1).cast("int"), 20), lambda x: x * 3 + 1).alias("key"))
    return align(pairs).select("pair_id", "offset", (F.col("ncc") > 0.999).alias("sure"))


@book.add("select event_id, user_id * 1000 + event_id % 997 as byte, ((user_id * 1000 + event_id % 997) - 10)::double / (128000 / 8) as seconds from events")
def byte_seconds(spark: SparkSession, d: str) -> DataFrame:
    t = V.read(spark, d, "events").select("event_id", (F.col("user_id") * 1000 + F.col("event_id") % 997).alias("byte"))
    return t.withColumn("seconds", spans.byte_to_seconds("byte", F.lit(10), F.lit(128000)))
