"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame and SQL functions only.

1. Targets.  Sources in code-point order, null last, weigh 3, 1, 2, repeating, and share SHARE of all words.  A target
   stops at LIMIT times its source's size and the excess is reshared by weight, which is water-filling: in order of
   limit by weight, a source is at its limit while the rest of the budget by weight allows more.
2. Seats.  The words of the budget go to the sources by highest quotients target / (2k+1), and each source's words to
   its shards in the same way by shard size, so that quotas are whole numbers and the smallest source has its share.
   Seats below the bound that any divisor gives are taken at once; only two or so quotients a member are ranked.
3. Blocks.  A shard's documents stand end to end in a seeded order and are cut into blocks of BLOCK words.  A quota takes
   every block as often as it goes round, and the rest of it takes the first blocks of a seeded permutation of the whole
   blocks once more: the last of them in part, and of the shard's last words, which fill no block, what is then left.

A source is cut into shards of about SHARD words, so a hot source is many groups; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import settle

WEIGHTS = (3, 1, 2)
SHARE_HALVES = 3  # budget: 3 halves of all sizes
LIMIT = 2
BLOCK = 16
SHARD = 1_000_000
SEED = 20_240_229
_M = 2_147_483_647
_A = 2_147_483_629

SPACES = "[^\\x20\\x09-\\x0D]+"


def _hash(doc_id: str, size: str) -> Column:
    """A seeded hash below 2**31 - 1 by integer arithmetic, so that any SQL engine repeats it; a null doc_id counts as -1.
    The size spreads rows that share a doc_id."""
    h = F.expr(f"(pmod(coalesce({doc_id}, -1), {_M}) * 48271 + {size} % {_M} * 69621) % {_M}")
    return (h * h + h * 3 + SEED) % _M


def sainte_lague(members: DataFrame, group: list[str], order: list[Column], votes: str, seats: str) -> DataFrame:
    """``members`` with ``won``: the group's seats (a column, equal within the group) by highest votes / (2k + 1).

    Ties go to the first in ``order``.  Members without votes win nothing.
    """
    whole = Window.partitionBy(*group)
    base = F.greatest(F.lit(0), F.floor(F.col(votes) * (F.col(seats) - F.col("_m") / 2 - 1) / F.col("_v") + 0.5) - 1)
    top = F.floor(F.col(votes) * (F.col(seats) + F.col("_m") / 2 + 1) / F.col("_v") + 0.5) + 1
    members = members.withColumns({"_v": F.sum(votes).over(whole), "_m": F.count(F.lit(1)).over(whole)})
    members = members.withColumn("_base", F.when(F.col(votes) > 0, base).otherwise(0).cast("long"))
    members = members.withColumns({"_open": F.col(seats) - F.sum("_base").over(whole), "_no": F.row_number().over(whole.orderBy(*order))})
    offers = members.select(*group, "_no", "_open", F.col(votes).alias("_votes"), F.explode(F.when(F.col(votes) > 0, F.sequence("_base", F.greatest("_base", top.cast("long")))).otherwise(F.array().cast("array<bigint>"))).alias("_k"))
    ranked = offers.withColumn("_rank", F.row_number().over(whole.orderBy(F.desc(F.col("_votes") / (F.col("_k") * 2 + 1)), "_no", "_k")))
    more = ranked.where("_rank <= _open").groupBy(*[F.col(g).alias(f"_{g}") for g in group], F.col("_no").alias("_at")).agg(F.count(F.lit(1)).alias("_more"))
    on = F.col("_no") == F.col("_at")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return members.join(more, on, "left").select(*[c for c in members.columns if c[0] != "_"], (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("won"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of (source, source_size): one row a source, so the ordering windows are small."""
    by_name = Window.partitionBy("all").orderBy(F.col("source").asc_nulls_last())
    filled = Window.partitionBy("all").orderBy("level", "no")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("all")
    big = "decimal(38,0)"
    out = sizes.withColumn("all", F.lit(0)).withColumn("no", F.row_number().over(by_name) - 1)
    out = out.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("no") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    out = out.withColumn("level", F.expr("source_size * (6 div w)"))
    out = out.withColumns({"total": F.sum("source_size").over(whole), "ws": F.sum("w").over(whole), "s0": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "w0": F.coalesce(F.sum("w").over(before), F.lit(0))})
    # Twice the budget is SHARE_HALVES * total; twice the limit is 2 * LIMIT * size.
    out = out.withColumn("full", ((F.col("source_size") * 2 * LIMIT).cast(big) * (F.col("ws") - F.col("w0")).cast(big) < F.col("w").cast(big) * (F.col("total") * SHARE_HALVES - F.col("s0") * 2 * LIMIT).cast(big)).cast("int"))
    out = out.withColumn("full", F.min("full").over(filled))
    out = out.withColumns({"s1": F.sum(F.col("source_size") * F.col("full")).over(whole), "w1": F.sum(F.col("w") * F.col("full")).over(whole)})
    spread = (F.col("w") * (F.col("total") * SHARE_HALVES - F.col("s1") * 2 * LIMIT)).cast("double") / F.nullif((F.col("ws") - F.col("w1")) * 2, F.lit(0)).cast("double")
    return out.select("source", "source_size", F.when(F.col("full") == 1, (F.col("source_size") * LIMIT).cast("double")).otherwise(spread).alias("target"), "total")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs (doc_id, source, text).

    Null and empty texts have size 0 and are never taken; a null source is a source of its own; a null doc_id is
    allowed.  Repeated rows are counted and taken apart; a long text is cut by blocks like any other; more columns are
    ignored.  A source's words come within one of its target.  An empty table gives an empty result.
    """
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(SPACES)), F.lit(0)).cast("long").alias("size")))
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_source = by_source.withColumns({"all": F.lit(0), "seats": F.expr(f"total * {SHARE_HALVES} div 2"), "shards": F.greatest(F.lit(1), F.expr(f"source_size div {SHARD}"))})
    by_source = settle(sainte_lague(by_source, ["all"], [F.col("source").asc_nulls_last()], "target", "seats").select("source", "source_size", "target", "shards", F.least("won", F.col("source_size") * LIMIT).alias("seats")))
    s = by_source.withColumnRenamed("source", "_source")
    placed = sized.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("h", _hash("doc_id", "size"))
    placed = placed.withColumn("shard", F.expr(f"h * shards div {_M}")).withColumn("h", F.expr(f"h * 16807 % {_M}"))
    by_shard = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    by_shard = sainte_lague(by_shard, ["source"], [F.col("shard")], "shard_size", "seats").withColumn("won", F.least("won", F.col("shard_size") * LIMIT))
    by_shard = settle(by_shard.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), F.expr(f"shard_size div {BLOCK}").alias("n"), F.expr("if(shard_size = 0, 0L, won div shard_size)").alias("rounds"), F.expr("if(shard_size = 0, 0L, won % shard_size)").alias("rest")))
    along = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(along))
    placed = placed.join(by_shard, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    # Of block b the first words, as many as the rest leaves after the blocks that come before it in the permutation.
    of_block = f"least({BLOCK}L, greatest(0L, rest - {BLOCK} * if(b < n, ({_A} % n * b + {SEED}) % n, n)))"
    more = f"aggregate(sequence((end - size) div {BLOCK}, (end - 1) div {BLOCK}), 0L, (sum, b) -> sum + greatest(0L, least(end, b * {BLOCK} + {of_block}) - greatest(end - size, b * {BLOCK})))"
    taken = F.expr(f"if(size = 0, 0L, size * rounds + if(rest = 0, 0L, {more}))")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


#: The same in DuckDB's SQL, over a relation ``docs`` of doc_id, source, text.
SQL = f"""
sized as materialized (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from docs),
src as (select source, sum(size)::bigint as source_size from sized group by source),
named as (select *, row_number() over (order by source nulls last) - 1 as no from src),
weighed as (select *, [3, 1, 2][(no % 3 + 1)::int]::bigint as w from named),
levels as (select *, source_size * (6 // w) as level, sum(source_size) over () as total, sum(w) over () as ws from weighed),
filling as (select *, coalesce(sum(source_size) over before, 0) as s0, coalesce(sum(w) over before, 0) as w0 from levels window before as (order by level, no rows between unbounded preceding and 1 preceding)),
fullness as (select *, (source_size * 4 * (ws - w0) < w * (total * 3 - s0 * 4))::int as f from filling),
filled as (select *, min(f) over (order by level, no) as ful from fullness),
sums as (select *, sum(source_size * ful) over () as s1, sum(w * ful) over () as w1 from filled),
aim as (select source, source_size, total::bigint as total, case when ful = 1 then (source_size * 2)::double else (w * (total * 3 - s1 * 4))::double / nullif((ws - w1) * 2, 0)::double end as target from sums),
seat0 as (select *, total * 3 // 2 as seats, greatest(1, source_size // {SHARD}) as shards, sum(target) over () as v, count(*) over () as m, row_number() over (order by source nulls last) as no from aim),
seat1 as (select *, case when target > 0 then greatest(0, floor(target * (seats - m / 2 - 1) / v + 0.5) - 1) else 0 end::bigint as base from seat0),
seat2 as (select *, seats - sum(base) over () as open from seat1),
offer as (select no, open, target / (k * 2 + 1) as quotient, k from (select *, unnest(range(base, greatest(base, (floor(target * (seats + m / 2 + 1) / v + 0.5) + 1)::bigint) + 1)) as k from seat2 where target > 0)),
won as (select no, count(*) as more from (select *, row_number() over (order by quotient desc, no, k) as rank from offer) where rank <= open group by no),
sources as (select source, source_size, target, shards, least(base + coalesce(more, 0), source_size * {LIMIT}) as seats from seat2 left join won using (no)),
h0 as (select d.*, s.source_size, s.target, s.shards, s.seats, (((coalesce(doc_id, -1) % {_M} + {_M}) % {_M}) * 48271 + size % {_M} * 69621) % {_M} as h from sized d join sources s on d.source is not distinct from s.source),
h1 as (select *, (h * h + h * 3 + {SEED}) % {_M} as g from h0),
placed as (select *, g * shards // {_M} as shard, g * 16807 % {_M} as o from h1),
sh0 as (select source, shard, sum(size)::bigint as shard_size, any_value(seats) as seats from placed group by source, shard),
sh1 as (select *, sum(shard_size) over w as v, count(*) over w as m, row_number() over (partition by source order by shard) as no from sh0 window w as (partition by source)),
sh2 as (select *, case when shard_size > 0 then greatest(0, floor(shard_size * (seats - m / 2 - 1) / v + 0.5) - 1) else 0 end::bigint as base from sh1),
sh3 as (select *, seats - sum(base) over (partition by source) as open from sh2),
shoffer as (select source, no, open, shard_size / (k * 2 + 1) as quotient, k from (select *, unnest(range(base, greatest(base, (floor(shard_size * (seats + m / 2 + 1) / v + 0.5) + 1)::bigint) + 1)) as k from sh3 where shard_size > 0)),
shwon as (select source, no, count(*) as more from (select *, row_number() over (partition by source order by quotient desc, no, k) as rank from shoffer) where rank <= open group by source, no),
shard as (select t.source, t.shard, shard_size // {BLOCK} as n, shard_size, least(base + coalesce(more, 0), shard_size * {LIMIT})::bigint as won from sh3 t left join shwon x on t.source is not distinct from x.source and t.no = x.no),
lined as (select p.*, sum(size) over (partition by source, shard order by o, doc_id nulls first, size rows between unbounded preceding and current row)::bigint as e from placed p),
quota as (select l.*, n, case when shard_size = 0 then 0 else won // shard_size end as rounds, case when shard_size = 0 then 0 else won % shard_size end as rest from lined l join shard s on l.source is not distinct from s.source and l.shard = s.shard),
mixed as (select doc_id, source, size, source_size, target, (case when size = 0 then 0 else size * rounds + case when rest = 0 then 0 else
  list_sum(list_transform(range((e - size) // {BLOCK}, (e - 1) // {BLOCK} + 1), lambda b: greatest(0, least(e, b * {BLOCK} + least({BLOCK}, greatest(0, rest - {BLOCK} * case when b < n then ({_A} % n * b + {SEED}) % n else n end))) - greatest(e - size, b * {BLOCK})))) end end)::bigint as taken from quota)
"""
