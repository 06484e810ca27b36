"""Queries of interval algebra, joins and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import intervals as I
from spanloom.operators import islands as S
from spanloom.operators.align import merge_truth, shift_silver, tiers
from spanloom.plans import views as V
from spanloom.plans.register import Book

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql


@book.add(f"with {V.SPANS} select episode, start_index, end_index, confidence, kind, evidence, end_evidence from merged")
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_spans(V.spans(spark, d)).drop("ord")


@book.add(f"with {V.IVA}, {V.islands_sql('iva', 'out', 500, ', count(*) as creatives, list_sort(list_distinct(list(slot))) as slots')} select episode, s, e, creatives, array_to_string(slots, '+') as slots, case when slots = ['pre'] then 'preroll' when slots = ['post'] then 'postroll' else 'midroll' end as kind from out")
def break_merge(spark: SparkSession, d: str) -> DataFrame:
    out = S.breaks(V.intervals(spark, d, "click"), ["episode"])
    return out.withColumns({"kind": S.kind_of_slots(F.col("slots")), "slots": F.array_join("slots", "+")})


@book.add(f"with {V.IVA}, {V.islands_sql('iva', 'out', 0, ', count(*) as n')} select episode, s, e, n from out")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_intervals(V.intervals(spark, d, "click"), ["episode"])


@book.add(f"with {V.IVA}, {V.islands_sql('iva', 'out', 0, '')} select episode, sum(e - s)::bigint as total_ms, count(*) as parts from out group by episode")
def interval_total(spark: SparkSession, d: str) -> DataFrame:
    return S.merge_intervals(V.intervals(spark, d, "click"), ["episode"]).groupBy("episode").agg(F.sum(F.col("e") - F.col("s")).alias("total_ms"), F.count(F.lit(1)).alias("parts"))


@book.add(f"with {V.IVA}, {V.IVB}, cut as (select a.episode, greatest(a.s, b.s) as s, least(a.e, b.e) as e from iva a join ivb b on a.episode = b.episode and a.s < b.e and a.e > b.s), {V.islands_sql('cut', 'out', 0, '')} select episode, s, e from out")
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    return I.intersect(V.intervals(spark, d, "click"), V.intervals(spark, d, "purchase"), ["episode"])


_SWEEP = """ends as (select episode, p, sum(da) as da, sum(db) as db from (select episode, s as p, 1 as da, 0 as db from {a} where e > s union all select episode, e, -1, 0 from {a} where e > s union all select episode, s, 0, 1 from {b} where e > s union all select episode, e, 0, -1 from {b} where e > s) group by episode, p),
swept as (select episode, p as s, lead(p) over w as e, sum(da) over w as ina, sum(db) over w as inb from ends window w as (partition by episode order by p)),
rest as (select episode, s, e from swept where ina > 0 and inb = 0 and e is not null)"""


@book.add(f"with {V.IVA}, {V.IVB}, {_SWEEP.format(a='iva', b='ivb')}, {V.islands_sql('rest', 'out', 0, '')} select episode, s, e from out")
def interval_subtract(spark: SparkSession, d: str) -> DataFrame:
    return I.subtract(V.intervals(spark, d, "click"), V.intervals(spark, d, "purchase"), ["episode"])


@book.add(f"with {V.IVA}, {V.EVT}, whole as (select episode, min(start_ms) as s, max(end_ms) as e from evt group by episode), {_SWEEP.format(a='whole', b='iva')}, {V.islands_sql('rest', 'out', 0, '')} select episode, s, e from out")
def interval_complement(spark: SparkSession, d: str) -> DataFrame:
    whole = V.evt(spark, d).groupBy("episode").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return I.complement(whole, V.intervals(spark, d, "click"), ["episode"])


@book.add(f"with {V.IVA}, {V.EVT}, found as (select i.episode, i.event_id as break_no, v.idx from iva i join evt v on i.episode = v.episode and v.end_ms > v.start_ms and i.s < v.end_ms and i.e > v.start_ms and (least(i.e, v.end_ms) - greatest(i.s, v.start_ms)) >= 0.5 * (v.end_ms - v.start_ms)) select episode, break_no, min(idx) as first_idx, max(idx) as last_idx from found group by episode, break_no")
def interval_to_segment(spark: SparkSession, d: str) -> DataFrame:
    return I.map_to_segments(V.intervals(spark, d, "click").withColumnRenamed("event_id", "break_no"), V.evt(spark, d), ["episode"])


@book.add(f"with {V.IVA}, {V.EVT}, mid as (select episode, idx, (start_ms + end_ms) // 2 as t from evt) select m.episode, m.idx, m.t, arg_min(i.event_id, (i.s, i.event_id)) as span_no from mid m left join iva i on i.episode = m.episode and i.s <= m.t and i.e > m.t group by m.episode, m.idx, m.t")
def point_in_span(spark: SparkSession, d: str) -> DataFrame:
    points = V.evt(spark, d).select("episode", "idx", F.floor((F.col("start") + F.col("end")) / 2).alias("t"))
    return I.span_at(points, V.intervals(spark, d, "click").withColumnRenamed("event_id", "span_no"), ["episode"], ["idx"])


@book.add(f"with {V.EVT}, {V.blocks_sql('tb', 'tflag')}, {V.blocks_sql('pb', 'flag')}, near as (select t.episode, t.first_idx as block, t.last_idx, p.first_idx as p_block, p.last_idx as p_last, abs(p.e - t.e) as end_gap, abs(p.s - t.s) as start_gap, row_number() over (partition by t.episode, t.first_idx order by abs(p.e - t.e), p.first_idx) as n from tb t left join pb p on p.episode = t.episode) select episode, block::bigint as block, p_block::bigint as p_block, end_gap, start_gap, coalesce(p_block <= last_idx and p_last >= block, false) as matched from near where n = 1")
def nearest_block(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators.scoring import block_table

    t = V.evt(spark, d)
    return I.nearest_block(block_table(t, "tflag"), block_table(t, "flag"), ["episode"])


@book.add(f"with {V.IVA}, pts as (select user_id as episode, event_id as point_no, (epoch_us(ts) // 1000) as t from events where event_type = 'view'), cues as (select episode, s, e, event_id as cue_no, row_number() over (partition by episode, s order by event_id desc) as n from iva) select p.episode, p.point_no, p.t, case when p.t < c.e + 300 then c.cue_no end as cue_no from pts p asof left join (select * from cues where n = 1) c on p.episode = c.episode and p.t >= c.s")
def asof_cue(spark: SparkSession, d: str) -> DataFrame:
    points = V.intervals(spark, d, "view").select("episode", F.col("event_id").alias("point_no"), F.col("s").alias("t"))
    return I.asof_backward(points, V.intervals(spark, d, "click").withColumnRenamed("event_id", "cue_no"), ["episode"])


@book.add(f"with {V.EVT} select episode, flag, min(idx) as first_idx, max(idx) as last_idx from (select episode, flag, idx, idx - row_number() over (partition by episode, flag order by idx) as g from evt) group by episode, flag, g")
def flag_runs(spark: SparkSession, d: str) -> DataFrame:
    return S.runs(V.evt(spark, d), ["episode"])


@book.add(f"with {V.EVT}, m as (select *, sum(new) over (partition by episode order by idx rows unbounded preceding) as turn_no from (select *, case when lag(flag) over w is not distinct from flag and start_ms - lag(end_ms) over w <= 1000 then 0 else 1 end as new from evt window w as (partition by episode order by idx))) select episode, turn_no::bigint as turn_no, arg_min(flag, idx) as flag, min(idx) as first_idx, max(idx) as last_idx, arg_min(start_ms, idx) as start, arg_max(end_ms, idx) as \"end\", count(*) as segments from m group by episode, turn_no")
def turn_merge(spark: SparkSession, d: str) -> DataFrame:
    return S.turns(V.evt(spark, d), ["episode"], "flag")


@book.add(f"with {V.IVA}, {V.IVB}, two as (select episode, s, e, slot, event_id, 'host' as source from iva union all select episode, s, e, slot, event_id, 'inserted' from ivb), dur as (select episode, max(e) as duration_ms from two group by episode), k as (select b.episode, s, e, event_id, source, duration_ms, case when source = 'inserted' and e >= duration_ms - 2000 then 'postroll' else case slot when 'pre' then 'preroll' when 'post' then 'postroll' else 'midroll' end end as kind from two b join dur using (episode)) select *, row_number() over (partition by episode order by s, e, source, kind) as span_no from k")
def truth_union(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("slot") == "pre", "preroll").when(F.col("slot") == "post", "postroll").otherwise("midroll")
    host, inserted = (V.intervals(spark, d, e).select("episode", "s", "e", "event_id", kind.alias("kind"), F.lit(s).alias("source")) for e, s in (("click", "host"), ("purchase", "inserted")))
    out = merge_truth(host, inserted, host.unionByName(inserted).groupBy("episode").agg(F.max("e").alias("duration_ms")))
    return out.withColumn("span_no", F.col("span_no").cast("long"))


@book.add(f"with {V.IVA}, {V.IVB} select a.episode, a.event_id, b.event_id as other, least(a.e, b.e) - greatest(a.s, b.s) as overlap_ms from iva a join ivb b on a.episode = b.episode and a.s < b.e and a.e > b.s")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = V.intervals(spark, d, "click").drop("slot")
    b = V.intervals(spark, d, "purchase").select("episode", F.col("s").alias("rs"), F.col("e").alias("re"), F.col("event_id").alias("other"))
    return I.overlap_join(a, b, ["episode"]).select("episode", "event_id", "other", (F.least("e", "re") - F.greatest("s", "rs")).alias("overlap_ms"))


@book.add(f"with {V.IVA}, {V.IVB}, pieces as (select episode, s, e - s as dur, s - coalesce(sum(e - s) over (partition by episode order by s, e - s rows between unbounded preceding and 1 preceding), 0) as pos from iva), pts as (select episode, event_id as point_no, s as t from ivb) select p.episode, p.point_no, p.t, (p.t + coalesce(sum(i.dur) filter (i.pos < p.t), 0))::bigint as shifted from pts p left join pieces i on i.episode = p.episode group by p.episode, p.point_no, p.t")
def time_shift(spark: SparkSession, d: str) -> DataFrame:
    points = V.intervals(spark, d, "purchase").select("episode", F.col("event_id").alias("point_no"), F.col("s").alias("t"))
    return I.time_shift(points, V.intervals(spark, d, "click").select("episode", "s", (F.col("e") - F.col("s")).alias("dur")), ["episode"])


@book.add(f"with {V.IVA}, {V.IVB}, {V.islands_sql('iva', 'a', 0, '')}, {V.islands_sql('ivb', 'b', 0, '')}, cut as (select a.episode, sum(least(a.e, b.e) - greatest(a.s, b.s)) as shared from a join b on a.episode = b.episode and a.s < b.e and a.e > b.s group by a.episode), ta as (select episode, sum(e - s) as a_ms from a group by episode), tb as (select episode, sum(e - s) as b_ms from b group by episode) select ta.episode, a_ms::bigint as a_ms, b_ms::bigint as b_ms, coalesce(shared, 0)::bigint as both_ms, coalesce(shared, 0)::double / nullif(b_ms, 0) as recall, coalesce(shared, 0)::double / nullif(a_ms, 0) as \"precision\" from ta join tb using (episode) left join cut using (episode)")
def interval_compare(spark: SparkSession, d: str) -> DataFrame:
    total = lambda df, c: df.groupBy("episode").agg(F.sum(F.col("e") - F.col("s")).alias(c))
    a, b = (S.merge_intervals(V.intervals(spark, d, e), ["episode"]) for e in ("click", "purchase"))
    out = total(a, "a_ms").join(total(b, "b_ms"), "episode").join(total(I.intersect(a, b, ["episode"]), "both_ms"), "episode", "left").fillna(0, ["both_ms"])
    return out.withColumns({"recall": F.col("both_ms") / F.nullif("b_ms", F.lit(0)), "precision": F.col("both_ms") / F.nullif("a_ms", F.lit(0))})


@book.add("select user_id as episode, (epoch_us(ts) // 1000) + case when event_id % 4 = 0 then 0 else 1500 end as s, (epoch_us(ts) // 1000) + 5000 + case when event_id % 4 = 0 then 0 else 1500 end as e, event_type as category, case when event_id % 10 = 0 then 'gold' when event_id % 3 >= 2 then 'silver' else 'bronze' end as tier from events where event_type in ('click', 'signup')")
def silver_labels(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.times import stamp_ms

    rows = V.read(spark, d, "events").select(F.col("user_id").alias("episode"), stamp_ms("ts").alias("s"), (stamp_ms("ts") + 5000).alias("e"), F.col("event_type").alias("category"), (F.col("event_id") % 4 == 0).alias("in_target_time"), F.lit(1500).alias("offset_ms"), (F.col("event_id") % 10 == 0).alias("locked"), (F.col("event_id") % 3).alias("votes"))
    rows = tiers(rows)
    out = None
    for tier in ("gold", "silver", "bronze"):
        part = shift_silver(rows.where(F.col("tier") == tier), ["click", "signup"]).withColumn("tier", F.lit(tier))
        out = part if out is None else out.unionByName(part)
    return out


@book.add("with s as (select user_id, ts, event_id, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from (select *, case when lag(ts) over w is null or (epoch_us(ts) // 1000) - (epoch_us(lag(ts) over w) // 1000) > 3600000 then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id))) select user_id as episode, session::bigint as session, count(*) as events, min((epoch_us(ts) // 1000)) as s, max((epoch_us(ts) // 1000)) as e from s group by user_id, session")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.times import stamp_ms

    t = V.read(spark, d, "events").select(F.col("user_id").alias("episode"), "event_id", stamp_ms("ts").alias("s"), stamp_ms("ts").alias("e"))
    out = S.islands(t, ["episode"], "s", "e", 3_600_000, ["event_id"])
    return out.groupBy("episode", F.col("island").alias("session")).agg(F.count(F.lit(1)).alias("events"), F.min("s").alias("s"), F.max("e").alias("e"))


@book.add("select (epoch_us(time_bucket(interval '1 hour', ts)) // 1000) as w, event_type, count(*) as n, sum(value) as v from events group by 1, 2")
def event_window(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.times import stamp_ms

    t = V.read(spark, d, "events").withColumn("w", F.floor(stamp_ms("ts") / 3_600_000) * 3_600_000)
    return t.groupBy("w", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


@book.add("with f as (select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) select event_id, user_id, event_type from f where n = 1")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.sinks.records import latest

    return latest(V.read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@book.add("select distinct user_id from events e where not exists (select 1 from events x where x.user_id = e.user_id and x.event_type = 'error')")
def anti_finished(spark: SparkSession, d: str) -> DataFrame:
    t = V.read(spark, d, "events")
    return t.select("user_id").distinct().join(t.where("event_type = 'error'").select("user_id"), "user_id", "left_anti")


@book.add("with old as (select user_id, event_type, max(event_id) as event_id, 'old' as source from events where event_id % 2 = 0 group by all), new as (select user_id, event_type, max(event_id) as event_id, 'new' as source from events where event_id % 2 = 1 and event_type <> 'view' group by all) select o.* from old o anti join new n on o.user_id = n.user_id and o.event_type = n.event_type union all select * from new")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.sinks.records import upsert

    t = V.read(spark, d, "events").select("user_id", "event_type", "event_id")
    old = t.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id")).withColumn("source", F.lit("old"))
    return upsert(old, t.where("event_id % 2 = 1 and event_type <> 'view'").withColumn("source", F.lit("new")), ["user_id", "event_type"], ["event_id"])


@book.add("select user_id, event_id, (sum(value) over (partition by user_id order by (epoch_us(ts) // 1000) range between 3600000 preceding and current row)) as spent from events")
def trailing_budget(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.times import stamp_ms

    w = Window.partitionBy("user_id").orderBy(stamp_ms("ts")).rangeBetween(-3_600_000, 0)
    return V.read(spark, d, "events").select("user_id", "event_id", F.sum("value").over(w).alias("spent"))
