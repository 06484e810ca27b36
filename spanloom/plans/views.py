"""Segments, flags, spans and intervals derived from the test tables, each with its SQL twin (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.spans import state_for
from spanloom.functions.times import stamp_ms
from spanloom.operators.islands import runs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conv(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments: 60 ms a character, one after the other."""
    dur = F.length(F.coalesce("text", F.lit(""))) * 60
    t = read(spark, d, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").cast("int").alias("idx"), "role", "text", dur.cast("long").alias("dur"))
    end = F.sum("dur").over(Window.partitionBy("episode").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("end", end).withColumn("start", F.col("end") - F.col("dur"))


CONV = """conv as (select episode, idx, role, text, dur, e - dur as start_ms, e as end_ms from (
  select conv_id as episode, turn::int as idx, role, text, (length(coalesce(text, '')) * 60)::bigint as dur, (sum(length(coalesce(text, '')) * 60) over (partition by conv_id order by turn rows unbounded preceding))::bigint as e from conversations))"""


def evt(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as segments up to the next one; clicks and purchases are found, values of 60 or more are true."""
    t = read(spark, d, "events").select(F.col("user_id").alias("episode"), "event_id", "event_type", "value", stamp_ms("ts").alias("start"))
    w = Window.partitionBy("episode").orderBy("start", "event_id")
    flag = F.when(F.col("event_type").isin("click", "purchase"), "a").when(F.col("event_type") == "view", "u").otherwise("c")
    kind = F.element_at(F.array(*map(F.lit, ("preroll", "midroll", "postroll", "house", "other"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t.withColumns({
        "idx": (F.row_number().over(w) - 1).cast("int"), "end": F.coalesce(F.lead("start").over(w), F.col("start") + 60_000), "flag": flag, "tflag": F.when(F.col("value") >= 60, "a").otherwise("c"),
        "delivery": F.when(F.col("event_id") % 3 == 0, "h").when(F.col("event_id") % 3 == 1, "i").otherwise("?"), "kind": kind, "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 200)),
    })


EVT = """evt0 as (select user_id as episode, event_id, event_type, value, (epoch_us(ts) // 1000) as start_ms from events),
evt as (select *, (row_number() over w - 1)::int as idx, coalesce(lead(start_ms) over w, start_ms + 60000) as end_ms,
  case when event_type in ('click', 'purchase') then 'a' when event_type = 'view' then 'u' else 'c' end as flag, case when value >= 60 then 'a' else 'c' end as tflag,
  case event_id % 3 when 0 then 'h' when 1 then 'i' else '?' end as delivery, (['preroll', 'midroll', 'postroll', 'house', 'other'])[(event_id % 5 + 1)::int] as kind, least(1.0::double, greatest(0.0::double, value / 200)) as confidence
  from evt0 window w as (partition by episode order by start_ms, event_id))"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Candidate spans: every found event and as many after it as its id's last digit says, three at most."""
    t = evt(spark, d)
    last = F.max("idx").over(Window.partitionBy("episode"))
    return t.withColumn("n", last).where("flag = 'a'").select(
        "episode", F.col("idx").alias("start_index"), F.least(F.col("idx") + (F.col("event_id") % 4).cast("int"), "n").alias("end_index"), "kind", "confidence",
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).otherwise("").alias("evidence"), F.concat(F.lit("z"), F.col("event_id").cast("string")).alias("end_evidence"), F.col("event_id").alias("ord"),
    )


SPANS = EVT + """,
cand as (select episode, idx as start_index, least(idx + (event_id % 4)::int, n) as end_index, kind, confidence, case when event_id % 2 = 0 then 'e' || event_id else '' end as evidence, 'z' || event_id as end_evidence, event_id as ord
  from (select *, max(idx) over (partition by episode) as n from evt) where flag = 'a'),
marked as (select *, sum(new) over (partition by episode order by start_index, end_index, ord rows unbounded preceding) as island from (
  select *, case when reach is null or start_index - reach > 1 then 1 else 0 end as new from (
    select *, max(end_index) over (partition by episode order by start_index, end_index, ord rows between unbounded preceding and 1 preceding) as reach from cand))),
merged as (select episode, min(start_index) as start_index, max(end_index) as end_index, min(confidence) as confidence, arg_min(kind, (start_index, end_index, ord)) as kind,
  arg_min(evidence, (start_index, end_index, ord)) filter (evidence <> '') as evidence, arg_min(end_evidence, (start_index, end_index, ord)) as end_evidence from marked group by episode, island),
timed as (select m.*, a.start_ms as s, b.end_ms as e, case when m.confidence >= 0.75 then 'ad' when m.confidence >= 0.4 then 'uncertain' else 'content' end as state
  from merged m join evt a on a.episode = m.episode and a.idx = m.start_index join evt b on b.episode = m.episode and b.idx = m.end_index)"""


def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators.islands import merge_spans
    from spanloom.operators.ladder import timed

    return timed(merge_spans(spans(spark, d)), evt(spark, d).select("episode", "idx", "start", "end")).withColumn("state", state_for("confidence"))


def intervals(spark: SparkSession, d: str, event: str) -> DataFrame:
    """Events of a type as intervals of value seconds, with a slot and the event's id."""
    slot = F.element_at(F.array(F.lit("pre"), F.lit("mid"), F.lit("post")), (F.col("event_id") % 3 + 1).cast("int"))
    t = read(spark, d, "events").where(F.col("event_type") == event)
    return t.select(F.col("user_id").alias("episode"), stamp_ms("ts").alias("s"), (stamp_ms("ts") + F.round(F.col("value") * 60_000).cast("long")).alias("e"), slot.alias("slot"), "event_id")


def _intervals_sql(name: str, event: str) -> str:
    return f"{name} as (select user_id as episode, (epoch_us(ts) // 1000) as s, (epoch_us(ts) // 1000) + cast(round(value * 60000) as bigint) as e, (['pre', 'mid', 'post'])[(event_id % 3 + 1)::int] as slot, event_id from events where event_type = '{event}')"


IVA, IVB = _intervals_sql("iva", "click"), _intervals_sql("ivb", "purchase")


def islands_sql(source: str, name: str, gap: int, columns: str) -> str:
    """Islands of a relation (episode, s, e) under a name, with the wanted aggregates."""
    return (
        f"{name} as (select episode, min(s) as s, max(e) as e{columns} from (select *, sum(new) over (partition by episode order by s, e rows unbounded preceding) as island from ("
        f"select *, case when reach is null or s - reach > {gap} then 1 else 0 end as new from (select *, max(e) over (partition by episode order by s, e rows between unbounded preceding and 1 preceding) as reach from {source}))) group by episode, island)"
    )


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Three models' flags of each event, by bands of value and event type."""
    t = evt(spark, d)
    rules = {"m1": F.col("flag") == "a", "m2": F.col("value") >= 50, "m3": (F.col("event_id") % 3 == 0) | (F.col("value") >= 80)}
    return t.select("episode", "idx", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.when(r, "a").otherwise("c").alias("flag")) for m, r in rules.items()])).alias("v")).select("episode", "idx", "v.*")


VOTES = EVT + """,
votes as (select episode, idx, 'm1' as model, case when flag = 'a' then 'a' else 'c' end as flag from evt union all
  select episode, idx, 'm2', case when value >= 50 then 'a' else 'c' end from evt union all select episode, idx, 'm3', case when event_id % 3 = 0 or value >= 80 then 'a' else 'c' end from evt),
tally as (select episode, idx, count(*) filter (flag = 'a') as votes, coalesce(list_sort(list(model) filter (flag = 'a')), []) as models from votes group by episode, idx)"""


def blocks(spark: SparkSession, d: str, flag: str) -> DataFrame:
    t = evt(spark, d)
    return runs(t, ["episode"], flag).where(F.col(flag) == "a")


def blocks_sql(name: str, flag: str) -> str:
    return f"""{name} as (select r.episode, r.first_idx, r.last_idx, a.start_ms as s, b.end_ms as e from (select episode, min(idx) as first_idx, max(idx) as last_idx from (
  select episode, idx, idx - row_number() over (partition by episode, {flag} order by idx) as g from evt where {flag} = 'a') group by episode, g) r join evt a on a.episode = r.episode and a.idx = r.first_idx join evt b on b.episode = r.episode and b.idx = r.last_idx)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as segments, a second each."""
    t = read(spark, d, "documents").select(F.col("doc_id").alias("episode"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "text"))
    return t.withColumn("start", F.col("idx").cast("long") * 1000).withColumn("end", F.col("start") + 1000)


LINES = "lines as (select episode, (i - 1)::int as idx, t[i] as text, (i - 1) * 1000 as start_ms, i * 1000 as end_ms from (select doc_id as episode, string_split(coalesce(text, ''), chr(10)) as t, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents))"


def record(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(media, record spans) of the merged spans of events; each episode begins at 0."""
    from spanloom.sinks.records import record_spans

    t = evt(spark, d).groupBy("episode").agg(F.min("start").alias("zero"), F.max("end").alias("to"))
    media = t.select("episode", (F.col("to") - F.col("zero")).alias("duration_ms"), F.sha2(F.col("episode").cast("string"), 256).alias("sha256"), F.concat(F.lit("/m/user-"), F.col("episode").cast("string"), F.lit(".mp3")).alias("path"), F.lit("ok").alias("status"))
    own = merged_spans(spark, d).join(t.select("episode", "zero"), "episode").withColumns({"start": F.col("start") - F.col("zero"), "end": F.col("end") - F.col("zero")})
    own = own.withColumns({"start_exact": F.when(F.col("start_index") % 7 == 3, F.col("start") + 250), "end_exact": F.col("end"), "advertiser": F.when(F.col("start_index") % 5 == 0, F.concat(F.lit("Brand "), F.col("start_index").cast("string")))})
    return media, record_spans(own)


RECORD = SPANS + """,
zero as (select episode, min(start_ms) as zero, max(end_ms) as upto from evt group by episode),
media as (select episode, upto - zero as duration_ms, sha256(episode::varchar) as sha256, '/m/user-' || episode || '.mp3' as path from zero),
rec0 as (select t.episode, s - zero as s0, e - zero as e0, start_index, kind, state, confidence, case when start_index % 7 = 3 then s - zero + 250 end as sx, case when start_index % 5 = 0 then 'Brand ' || start_index end as advertiser from timed t join zero z on z.episode = t.episode),
rec as (select episode, 'ad-' || lpad((row_number() over (partition by episode order by s0, e0))::varchar, 4, '0') as id, coalesce(sx, s0) as s, e0 as e,
  case kind when 'house' then 'selfpromo' else 'sponsor' end as category, case when kind = 'other' then 'unknown' else 'host_read' end as form, case when kind in ('house', 'other') then 'unknown' else kind end as position,
  case when state = 'ad' and kind <> 'house' then 'skip' when state in ('ad', 'uncertain') then 'prompt' else 'none' end as action, state, confidence, case when sx is not null then 'word' else 'segment' end as edge_mode, advertiser from rec0)"""
