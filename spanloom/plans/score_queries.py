"""Queries of gates, scores, consensus and boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import boards, consensus, gates, scoring
from spanloom.operators.intervals import explode_indices
from spanloom.operators.islands import merge_spans
from spanloom.operators.ladder import cap_duration, timed
from spanloom.plans import views as V
from spanloom.plans.register import Book

book = Book()
QUERIES, ORACLE_SQL = book.queries, book.sql

_FLAGGED = f"""{V.SPANS}, ranked as (select t.episode, unnest(range(start_index, end_index + 1)) as idx, case state when 'ad' then 2 when 'uncertain' then 1 else 0 end as rank from timed t),
best as (select episode, idx, max(rank) as rank from ranked group by episode, idx),
fl as (select e.episode, e.idx, e.start_ms, e.end_ms, (['c', 'u', 'a'])[coalesce(rank, 0) + 1] as f from evt e left join best b on b.episode = e.episode and b.idx = e.idx)"""


@book.add(f"with {_FLAGGED} select episode, idx, f as flag from fl")
def flags_rank(spark: SparkSession, d: str) -> DataFrame:
    return gates.flags(V.evt(spark, d).drop("flag"), V.merged_spans(spark, d)).select("episode", "idx", "flag")


@book.add(f"with {_FLAGGED}, n as (select episode, count(*) as ad_spans from timed where state = 'ad' group by episode) select fl.episode, count(*) filter (f = 'a') as ad_segments, count(*) filter (f = 'u') as uncertain_segments, sum(case when f = 'a' then greatest(0, end_ms - start_ms) else 0 end)::bigint as ad_ms, max(end_ms) as duration_ms, coalesce(any_value(ad_spans), 0) as ad_spans, string_agg(f, '' order by idx) as flags from fl left join n on n.episode = fl.episode group by fl.episode")
def span_stats(spark: SparkSession, d: str) -> DataFrame:
    spans = V.merged_spans(spark, d)
    flagged = gates.flags(V.evt(spark, d).drop("flag"), spans)
    return gates.span_stats(flagged, spans).join(gates.flag_strings(flagged), "episode")


_GATE = f"""{V.SPANS}, zt as (select episode, min(start_ms) as z from evt group by episode), live as (select * from timed where state in ('ad', 'uncertain')),
cov as (select c.episode, sum(greatest(0, e.end_ms - e.start_ms)) as covered_ms from (select distinct episode, unnest(range(start_index, end_index + 1)) as idx from live) c join evt e on e.episode = c.episode and e.idx = c.idx group by c.episode),
lng as (select episode, max(e - s) as longest_ms from live group by episode),
whole as (select e.episode, count(*) as n_segments, max(end_ms) - any_value(z) as duration_ms from evt e join zt on zt.episode = e.episode group by e.episode),
gate as (select w.*, coalesce(longest_ms, 0)::bigint as longest_ms, coalesce(covered_ms, 0)::bigint as covered_ms from whole w left join lng on lng.episode = w.episode left join cov on cov.episode = w.episode),
gated as (select *, case when n_segments < 10 or duration_ms <= 0 or longest_ms > duration_ms * 0.6::double then 'rejected_degenerate' when covered_ms > duration_ms * 0.35::double then 'rejected_overlabel' else 'ok' end as status from gate)"""


def _zeroed(t: DataFrame, zero: DataFrame) -> DataFrame:
    return t.join(zero, "episode").withColumns({"start": F.col("start") - F.col("zero"), "end": F.col("end") - F.col("zero")}).drop("zero")


@book.add(f"with {_GATE} select episode, n_segments, duration_ms, longest_ms, covered_ms, status from gated")
def episode_gate(spark: SparkSession, d: str) -> DataFrame:
    t = V.evt(spark, d).select("episode", "idx", "start", "end")
    zero = t.groupBy("episode").agg(F.min("start").alias("zero"))
    return gates.episode_gates(_zeroed(t, zero), _zeroed(V.merged_spans(spark, d), zero))


@book.add(f"with {V.SPANS} select episode, start_index, end_index, e - s > 240000 as too_long, e - s as ms from timed")
def duration_cap(spark: SparkSession, d: str) -> DataFrame:
    kept, gone = cap_duration(V.merged_spans(spark, d).withColumn("chunk", F.lit(0)))
    marks = kept.select("episode", "start_index", "end_index", F.lit(False).alias("too_long"), (F.col("end") - F.col("start")).alias("ms"))
    dropped = V.merged_spans(spark, d).join(kept.select("episode", "start_index"), ["episode", "start_index"], "left_anti")
    return marks.unionByName(dropped.select("episode", "start_index", "end_index", F.lit(True).alias("too_long"), (F.col("end") - F.col("start")).alias("ms")))


_CONV_PIPE = f"""{V.CONV}, cand as (select episode, idx as start_index, idx as end_index, case when role = 'system' then 0.9::double when length(text) % 3 = 0 then 0.5::double else 0.8::double end as confidence, role from conv where role = 'system' or length(text) % 5 = 0),
mk as (select *, sum(new) over (partition by episode order by start_index rows unbounded preceding) as island from (select *, case when lag(end_index) over (partition by episode order by start_index) is null or start_index - lag(end_index) over (partition by episode order by start_index) > 1 then 1 else 0 end as new from cand)),
sp as (select m.episode, min(m.start_index) as a, max(m.end_index) as b, min(m.confidence) as confidence from mk m group by m.episode, m.island),
tm as (select sp.*, x.start_ms as s, y.end_ms as e, case when confidence >= 0.75 then 'ad' when confidence >= 0.4 then 'uncertain' else 'content' end as state from sp join conv x on x.episode = sp.episode and x.idx = a join conv y on y.episode = sp.episode and y.idx = b),
ok as (select * from tm where e - s <= 240000),
cov as (select c.episode, sum(dur) as covered_ms from (select distinct episode, unnest(range(a, b + 1)) as idx from ok where state <> 'content') c join conv v on v.episode = c.episode and v.idx = c.idx group by c.episode),
st as (select episode, count(*) filter (state = 'ad') as ad_spans, max(e - s) filter (state <> 'content') as longest_ms, sum(e - s) filter (state = 'ad') as ad_ms from ok group by episode),
w as (select episode, count(*) as n_segments, max(end_ms) as duration_ms from conv group by episode)"""


@book.add(f"with {_CONV_PIPE} select w.episode, n_segments, duration_ms, coalesce(ad_spans, 0) as ad_spans, coalesce(ad_ms, 0)::bigint as ad_ms, coalesce(covered_ms, 0)::bigint as covered_ms, case when n_segments < 10 or duration_ms <= 0 or coalesce(longest_ms, 0) > duration_ms * 0.6::double then 'rejected_degenerate' when coalesce(covered_ms, 0) > duration_ms * 0.35::double then 'rejected_overlabel' else 'ok' end as status from w left join st using (episode) left join cov using (episode)")
def episode_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Turns to candidates by a structural rule, merged, capped, gated and counted."""
    from spanloom.functions.spans import state_for

    conv = V.conv(spark, d)
    confidence = F.when(F.col("role") == "system", 0.9).when(F.length("text") % 3 == 0, 0.5).otherwise(0.8)
    found = conv.where((F.col("role") == "system") | (F.length("text") % 5 == 0)).select("episode", F.col("idx").alias("start_index"), F.col("idx").alias("end_index"), confidence.alias("confidence"), F.col("role").alias("kind"), F.lit("").alias("evidence"), F.lit("").alias("end_evidence"), F.col("idx").alias("ord"))
    spans = timed(merge_spans(found), conv.select("episode", "idx", "start", "end")).withColumn("state", state_for("confidence"))
    spans, _ = cap_duration(spans.withColumn("chunk", F.lit(0)))
    gated = gates.episode_gates(conv.select("episode", "idx", "start", "end"), spans)
    own = spans.where("state = 'ad'").groupBy("episode").agg(F.count(F.lit(1)).alias("ad_spans"), F.sum(F.col("end") - F.col("start")).alias("ad_ms"))
    return gated.join(own, "episode", "left").fillna(0, ["ad_spans", "ad_ms"]).select("episode", "n_segments", "duration_ms", "ad_spans", "ad_ms", "covered_ms", "status")


_SCORE = f"""{V.EVT}, {V.blocks_sql('tb', 'tflag')}, {V.blocks_sql('pb', 'flag')},
near as (select t.episode, t.first_idx, t.last_idx, p.first_idx as pf, p.last_idx as pl, abs(p.e - t.e) as ge, abs(p.s - t.s) as gs, row_number() over (partition by t.episode, t.first_idx order by abs(p.e - t.e), p.first_idx) as n from tb t left join pb p on p.episode = t.episode),
bl as (select episode, count(*) as true_blocks, count(*) filter (m) as matched_blocks, sum(case when m then ge + gs end) as gap_ms from (select *, coalesce(pf <= last_idx and pl >= first_idx, false) as m from near where n = 1) group by episode),
su as (select episode, sum(case when tflag = 'a' then l else 0 end)::bigint as true_ms, sum(case when tflag <> 'a' then l else 0 end)::bigint as content_ms, sum(case when flag = 'a' then l else 0 end)::bigint as pred_ms, sum(case when flag = 'a' and tflag <> 'a' then l else 0 end)::bigint as loss_ms,
  sum(case when flag = 'a' and tflag = 'a' then l else 0 end)::bigint as caught_ms, sum(case when flag = 'u' and tflag <> 'a' then l else 0 end)::bigint as uncertain_content_ms,
  sum(case when tflag = 'a' and delivery = 'h' then l else 0 end)::bigint as host_ms, sum(case when flag = 'a' and tflag = 'a' and delivery = 'h' then l else 0 end)::bigint as host_caught_ms,
  sum(case when tflag = 'a' and delivery = 'i' then l else 0 end)::bigint as inserted_ms, sum(case when flag = 'a' and tflag = 'a' and delivery = 'i' then l else 0 end)::bigint as inserted_caught_ms from (select *, greatest(0, end_ms - start_ms) as l from evt) group by episode),
sc as (select su.*, coalesce(true_blocks, 0) as true_blocks, coalesce(matched_blocks, 0) as matched_blocks, gap_ms::bigint as gap_ms, true_ms - caught_ms as missed_ms, caught_ms::double / nullif(true_ms, 0) as recall, host_caught_ms::double / nullif(host_ms, 0) as host_recall, inserted_caught_ms::double / nullif(inserted_ms, 0) as inserted_recall, gap_ms::double / nullif(matched_blocks * 2, 0) as boundary_ms from su left join bl using (episode))"""


@book.add(f"with {_SCORE} select * from sc")
def score_truth(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(V.evt(spark, d))


@book.add(f"with {_SCORE} select *, loss_ms <= 5000 as pass_loss, worst_loss_ms <= 5000 as pass_loss_each, coalesce(recall >= 0.7, true) as pass_recall, coalesce(boundary_ms <= 3000, true) as pass_boundary from (select count(*) as episodes, sum(true_ms)::bigint as true_ms, sum(loss_ms)::bigint as loss_ms, sum(caught_ms)::bigint as caught_ms, sum(caught_ms)::double / nullif(sum(true_ms), 0) as recall, sum(host_caught_ms)::double / nullif(sum(host_ms), 0) as host_recall, sum(inserted_caught_ms)::double / nullif(sum(inserted_ms), 0) as inserted_recall, avg(boundary_ms) as boundary_ms, max(loss_ms) as worst_loss_ms from sc)")
def score_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return scoring.aggregate_scores(scoring.score(V.evt(spark, d)))


@book.add(f"with {V.EVT}, sp as (select episode, idx as start_index, least(idx + 2, n)::int as end_index, case when event_id % 3 = 0 then 'host' end as delivery, case when episode % 5 = 0 then 'inserted' end as dflt, event_id as span_no from (select *, max(idx) over (partition by episode) as n from evt) where tflag = 'a'), own as (select episode, idx, arg_max(coalesce(delivery, dflt, ''), span_no) as g from (select *, unnest(range(start_index, end_index + 1)) as idx from sp) group by episode, idx), docs as (select distinct episode from evt where episode % 2 = 0), ins as (select distinct episode, idx from evt where flag = 'u') select e.episode, e.idx, case when o.idx is null then null else coalesce(nullif(left(g, 1), ''), case when dd.episode is not null then case when i.idx is not null then 'i' else 'h' end end, '?') end as delivery from evt e left join own o on o.episode = e.episode and o.idx = e.idx left join docs dd on dd.episode = e.episode left join ins i on i.episode = e.episode and i.idx = e.idx")
def truth_delivery(spark: SparkSession, d: str) -> DataFrame:
    t = V.evt(spark, d)
    from pyspark.sql.window import Window

    n = F.max("idx").over(Window.partitionBy("episode"))
    truth = t.withColumn("n", n).where("tflag = 'a'").select("episode", F.col("idx").alias("start_index"), F.least(F.col("idx") + 2, "n").alias("end_index"), F.when(F.col("event_id") % 3 == 0, "host").alias("delivery"), F.when(F.col("episode") % 5 == 0, "inserted").alias("default"), F.col("event_id").alias("span_no"))
    inserted = t.where("flag = 'u'").select("episode", F.col("idx").alias("start_index"), F.col("idx").alias("end_index"))
    return scoring.truth_delivery(t.select("episode", "idx"), truth, t.where("episode % 2 = 0").select("episode"), inserted)


@book.add(f"with {V.VOTES} select episode, idx, votes, array_to_string(models, '+') as models, case when votes >= 2 then 'a' else 'c' end as agreed, case when votes >= 1 then 'a' else 'c' end as \"any\" from tally")
def votes_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.tally(V.votes(spark, d)).select("episode", "idx", "votes", F.array_join("models", "+").alias("models"), F.when(F.col("votes") >= 2, "a").otherwise("c").alias("agreed"), F.when(F.col("votes") >= 1, "a").otherwise("c").alias("any"))


@book.add(f"with {V.VOTES} select a.episode, a.model as model_a, b.model as model_b, sum(case when a.flag = 'a' and b.flag = 'a' then l else 0 end)::double / nullif(sum(case when a.flag = 'a' or b.flag = 'a' then l else 0 end), 0) as jaccard from votes a join votes b on a.episode = b.episode and a.idx = b.idx and a.model < b.model join (select episode, idx, greatest(0, end_ms - start_ms) as l from evt) e on e.episode = a.episode and e.idx = a.idx group by a.episode, a.model, b.model")
def pair_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return consensus.pairwise_jaccard(V.votes(spark, d), V.evt(spark, d))


_RUNS = f"""{V.VOTES},
inn as (select episode, min(idx) as first_idx, max(idx) as last_idx, min(votes) as votes, array_to_string(list_sort(list_distinct(flatten(list(models)))), '+') as models from (select *, idx - row_number() over (partition by episode order by idx) as g from tally where votes >= 2) group by episode, g),
uni as (select episode, min(idx) as outer_first, max(idx) as outer_last, max(votes) as most, array_to_string(arg_min(models, idx), '+') as models from (select *, idx - row_number() over (partition by episode order by idx) as g from tally where votes >= 1) group by episode, g)"""


@book.add(f"with {_RUNS} select i.episode, i.first_idx, i.last_idx, outer_first, outer_last, i.votes, i.models, a.start_ms as s, b.end_ms as e, (y.end_ms - x.start_ms) - (b.end_ms - a.start_ms) as disputed_ms from inn i join uni u on u.episode = i.episode and outer_first <= first_idx and outer_last >= last_idx join evt a on a.episode = i.episode and a.idx = first_idx join evt b on b.episode = i.episode and b.idx = last_idx join evt x on x.episode = i.episode and x.idx = outer_first join evt y on y.episode = i.episode and y.idx = outer_last")
def consensus_spans(spark: SparkSession, d: str) -> DataFrame:
    found = consensus.with_times(consensus.consensus_runs(consensus.tally(V.votes(spark, d)), 2), V.evt(spark, d))
    return found.select("episode", "first_idx", "last_idx", "outer_first", "outer_last", "votes", F.array_join("models", "+").alias("models"), "s", "e", "disputed_ms")


@book.add(f"with {_RUNS}, sp as (select episode, model, 'k' || (first_idx % 3) as kind, first_idx as a, last_idx as b, substr(model, 2)::int as model_ord, first_idx as span_no from (select episode, model, min(idx) as first_idx, max(idx) as last_idx from (select *, idx - row_number() over (partition by episode, model order by idx) as g from votes where flag = 'a') group by episode, model, g)), cnt as (select i.episode, i.first_idx, kind, count(*) as n, min((model_ord, span_no)) as seen from inn i join sp on sp.episode = i.episode and sp.a <= i.last_idx and sp.b >= i.first_idx group by i.episode, i.first_idx, kind) select episode, first_idx, arg_min(kind, (-n, seen)) as kind from cnt group by episode, first_idx")
def consensus_kind(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.operators.islands import runs

    own = runs(V.votes(spark, d), ["episode", "model"]).where("flag = 'a'")
    spans = own.select("episode", F.expr("cast(substr(model, 2) as int)").alias("model_ord"), F.col("first_idx").alias("span_no"), F.concat(F.lit("k"), (F.col("first_idx") % 3).cast("string")).alias("kind"), F.col("first_idx").alias("start_index"), F.col("last_idx").alias("end_index"))
    return consensus.kinds(consensus.consensus_runs(consensus.tally(V.votes(spark, d)), 2), spans).select("episode", "first_idx", "kind")


@book.add(f"with {_RUNS} select episode, outer_first as first_idx, outer_last as last_idx, models from uni where most < 2")
def single_model(spark: SparkSession, d: str) -> DataFrame:
    return consensus.single_model(consensus.tally(V.votes(spark, d)), 2).withColumn("models", F.array_join("models", "+"))


@book.add("with c as (select o_custkey % 7 as run, o_orderkey as episode, l_quantity::double as wall, (l_extendedprice * 2.5::double + l_quantity * 10::double) / 1000000 as cost, l_linenumber as thinking, case when l_returnflag = 'R' then 'err' end as error from lineitem join orders on l_orderkey = o_orderkey), r as (select run, episode, count(*) as chunks, sum(wall) as wall, sum(cost) as cost, sum(thinking) as thinking, count(error) as incomplete_chunks from c group by run, episode), s as (select run, episode, case when episode % 3 = 0 then (episode % 13)::double end as loss, case when episode % 3 = 0 then (episode % 11) / 10.0::double end as recall, case when episode % 3 = 0 and episode % 2 = 0 then (episode % 5)::double end as boundary from r) select run, count(*) as episodes, count(loss) as with_truth, sum(cost) as cost, sum(wall) as wall, sum(loss) as loss, min(recall) as least_recall, max(boundary) as most_boundary, coalesce(bool_or(loss > 5 or recall < 0.7::double or boundary > 3), false) as any_fail, sum(incomplete_chunks)::bigint as incomplete_chunks from r join s using (run, episode) group by run")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.functions.spans import cost

    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("episode"), (F.col("o_custkey") % 7).alias("run"))
    li = V.read(spark, d, "lineitem")
    chunks = li.select(F.col("l_orderkey").alias("episode"), F.col("l_quantity").cast("double").alias("wall"), cost("l_extendedprice", "l_quantity", F.lit(2.5), F.lit(10.0)).alias("cost"), F.col("l_linenumber").alias("thinking"), F.when(F.col("l_returnflag") == "R", "err").alias("error")).join(o, "episode")
    rows = boards.episode_rows(chunks)
    e = F.col("episode")
    scored = F.when(e % 3 == 0, True)
    scores = rows.select("run", "episode", F.when(scored, (e % 13).cast("double")).alias("loss"), F.when(scored, (e % 11) / 10.0).alias("recall"), F.when(scored & (e % 2 == 0), (e % 5).cast("double")).alias("boundary"))
    return boards.leaderboard(rows, scores).join(rows.groupBy("run").agg(F.sum("incomplete_chunks").alias("incomplete_chunks")), "run")


@book.add(f"with {V.SPANS} select episode, count(distinct idx) as covered from (select episode, unnest(range(start_index, end_index + 1)) as idx from cand) group by episode")
def covered_indices(spark: SparkSession, d: str) -> DataFrame:
    return explode_indices(V.spans(spark, d)).select("episode", "idx").distinct().groupBy("episode").agg(F.count(F.lit(1)).alias("covered"))


@book.add()
def classify_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The whole classification on conversations, with system turns and questions as a rule's candidates."""
    from spanloom.operators.propose import RuleProposer
    from spanloom.plans.classify import classify

    words = F.array().cast("array<struct<w:string,s:bigint,e:bigint>>").alias("words")
    segments = V.conv(spark, d).select("episode", "idx", "start", "end", "text", "role", words)
    return classify(segments, RuleProposer(F.col("role") == "system"), 400, 3).episodes
