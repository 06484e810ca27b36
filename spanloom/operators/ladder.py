"""The validation ladder: from model replies to trusted spans, as one plan over all episodes.

Tables: segments (episode, idx, start, end, text; milliseconds), chunks (episode, chunk, a, b), replies (episode,
chunk, obj text).  Each step returns what stays and, where it drops or changes rows, rejections (episode, chunk, ord,
reason, raw).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom import constants as C
from spanloom.functions.spans import kind_or_default, state_for
from spanloom.functions.text import question_count, quote_matches
from spanloom.operators.intervals import explode_indices
from spanloom.operators.islands import merge_spans
from spanloom.store import settle


def _rejected(rows: DataFrame, reason: str) -> DataFrame:
    """Rejections of spans, with what the span was: those of these columns that it has."""
    raw = F.to_json(F.struct(*(c for c in ("start_index", "end_index", "kind", "confidence", "evidence", "end_evidence") if c in rows.columns)))
    return rows.select("episode", "chunk", "ord", F.lit(reason).alias("reason"), F.substring(raw, 1, C.RAW_TRUNCATE).alias("raw"))


def capped(log: DataFrame, most: int = C.MAX_REJECTIONS) -> DataFrame:
    """The first rejections of each episode, in the order of pass, window and place; the log is made to be read."""
    order = [c for c in ("pass", "chunk", "ord", "reason", "raw") if c in log.columns]
    return log.withColumn("_no", F.row_number().over(Window.partitionBy("episode").orderBy(*order))).where(F.col("_no") <= most).drop("_no")


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejections).  A missing or null list is no spans; a reply that is no object, a list that is none,
    items that are no objects and indices that are no integers are rejected.  Reversed indices are swapped."""
    v = replies.withColumn("v", F.try_parse_json("obj"))
    kind = F.coalesce(F.schema_of_variant("v"), F.lit("NONE"))
    items = F.expr("try_variant_get(v, '$.ad_spans', 'array<variant>')")
    listed = F.schema_of_variant(F.expr("try_variant_get(v, '$.ad_spans', 'variant')"))
    v = v.withColumns({"kind": kind, "listed": listed})
    bad = F.when(~F.col("kind").startswith("OBJECT"), "reply is not an object").when(F.col("listed").isNotNull() & (F.col("listed") != "VOID") & ~F.col("listed").startswith("ARRAY"), "ad_spans is not a list")
    rejected = v.withColumn("reason", bad).where("reason is not null").select("episode", "chunk", F.lit(-1).alias("ord"), "reason", F.substring("obj", 1, C.RAW_TRUNCATE).alias("raw"))
    spans = v.where(F.col("kind").startswith("OBJECT") & F.coalesce(F.col("listed").startswith("ARRAY"), F.lit(False))).select("episode", "chunk", F.posexplode(items).alias("ord", "item"))
    get = lambda key, t: F.expr(f"try_variant_get(item, '$.{key}', '{t}')")
    spans = spans.select(
        "episode", "chunk", "ord", F.substring(F.to_json("item"), 1, C.RAW_TRUNCATE).alias("raw"), F.coalesce(F.schema_of_variant("item"), F.lit("NONE")).alias("kind_of"), get("start_index", "int").alias("i"), get("end_index", "int").alias("j"), kind_or_default(get("kind", "string")).alias("kind"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(get("confidence", "double"), F.lit(0.0)))).alias("confidence"),
        F.substring(F.coalesce(get("evidence", "string"), F.lit("")), 1, C.EVIDENCE_TRUNCATE).alias("evidence"), F.substring(F.coalesce(get("end_evidence", "string"), F.lit("")), 1, C.EVIDENCE_TRUNCATE).alias("end_evidence"),
    )
    wrong = F.when(~F.col("kind_of").startswith("OBJECT"), "item is not an object").when(F.col("i").isNull() | F.col("j").isNull(), "indices are not integers")
    spans = spans.withColumn("reason", wrong)
    rejected = rejected.unionByName(spans.where("reason is not null").select("episode", "chunk", "ord", "reason", "raw"))
    good = spans.where("reason is null").select("episode", "chunk", "ord", F.least("i", "j").alias("start_index"), F.greatest("i", "j").alias("end_index"), "kind", "confidence", "evidence", "end_evidence")
    return good, rejected


def clip(spans: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans cut to their window [a, b); what falls outside is rejected, what was cut is kept and logged.  A null episode
    is an episode of its own."""
    windows = chunks.select(F.col("episode").alias("_episode"), F.col("chunk").alias("_chunk"), "a", "b")
    both = spans.join(windows, F.col("episode").eqNullSafe(F.col("_episode")) & (F.col("chunk") == F.col("_chunk"))).drop("_episode", "_chunk")
    both = both.withColumns({"i": F.greatest("start_index", "a"), "j": F.least(F.col("end_index"), F.col("b") - 1)})
    both = both.withColumn("reason", F.when(F.col("i") > F.col("j"), "outside labelable window").when((F.col("i") != F.col("start_index")) | (F.col("j") != F.col("end_index")), "clipped"))
    kept = both.where("i <= j").withColumns({"start_index": F.col("i"), "end_index": F.col("j")}).drop("a", "b", "i", "j", "reason")
    return kept, _rejected(both.where("reason = 'clipped'"), "clipped").unionByName(_rejected(both.where("reason <> 'clipped'"), "outside labelable window"))


def timed(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """``spans`` with start and end of their first and last segment."""
    first = segments.select("episode", F.col("idx").alias("start_index"), "start")
    last = segments.select("episode", F.col("idx").alias("end_index"), "end")
    return spans.drop("start", "end").join(first, ["episode", "start_index"], "left").join(last, ["episode", "end_index"], "left")


def cap_duration(spans: DataFrame, most: int = C.MAX_SPAN_MS) -> tuple[DataFrame, DataFrame]:
    """Spans no longer than ``most``; longer ones are rejected."""
    long = F.col("end") - F.col("start") > most
    return spans.where(~long), _rejected(spans.where(long), "over the longest duration")


def check_evidence(spans: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quotes must stand in the first segment, or in it and the next; else confidence is halved and that is logged."""
    texts = segments.select("episode", F.col("idx").alias("start_index"), F.col("text").alias("t0"))
    after = segments.select("episode", (F.col("idx") - 1).alias("start_index"), F.col("text").alias("t1"))
    both = spans.join(texts, ["episode", "start_index"], "left").join(after, ["episode", "start_index"], "left")
    first = quote_matches("evidence", "t0")
    across = quote_matches("evidence", F.concat_ws(" ", "t0", "t1"))
    both = both.withColumns({"evidence_straddles": F.coalesce(~first & across & F.col("t1").isNotNull(), F.lit(False)), "found": F.coalesce(first | (across & F.col("t1").isNotNull()), F.lit(False))})
    both = both.withColumn("confidence", F.when(F.col("found"), F.col("confidence")).otherwise(F.round(F.col("confidence") * 0.5, 4)))
    return both.drop("t0", "t1", "found"), _rejected(both.where("not found"), "evidence not found")


def check_dialogue(spans: DataFrame, segments: DataFrame, density: float = C.DIALOGUE_DENSITY) -> tuple[DataFrame, DataFrame]:
    """Spans with many questions a segment are halved again, carry that density as dialogue_suspect and are logged."""
    ids = ["episode", "chunk", "start_index", "end_index"]
    asked = explode_indices(spans.select(*ids)).join(segments.select("episode", "idx", question_count("text").alias("q")), ["episode", "idx"]).groupBy(*ids).agg((F.sum("q") / F.count(F.lit(1))).alias("density"))
    both = spans.join(asked, ids, "left")
    suspect = F.col("density") >= density
    both = both.withColumns({"confidence": F.when(suspect, F.round(F.col("confidence") * 0.5, 4)).otherwise(F.col("confidence")), "dialogue_suspect": F.when(suspect, F.round("density", 3))}).drop("density")
    return both, _rejected(both.where("dialogue_suspect is not null"), "reads like dialogue")


def run_pass(segments: DataFrame, chunks: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, rejections) of one pass: the ladder in each chunk, the merge across chunks, the cap again, states."""
    spans, log = parse_replies(replies)
    spans, more = clip(spans, chunks)
    log = log.unionByName(more)
    spans, more = cap_duration(timed(spans, segments))
    log = log.unionByName(more)
    spans = settle(merge_spans(spans, ["episode", "chunk"]))
    spans, more = check_evidence(spans, segments)
    log = log.unionByName(more)
    spans, more = check_dialogue(spans, segments)
    log = log.unionByName(more)
    spans = spans.withColumn("ord", F.col("chunk").cast("long") * (1 << 32) + F.col("ord"))
    spans = merge_spans(spans, ["episode"])
    spans, more = cap_duration(timed(spans, segments).withColumn("chunk", F.lit(-1)))
    more = more.withColumn("ord", F.col("ord") % (1 << 32))
    return spans.drop("chunk").withColumn("state", state_for("confidence")), log.unionByName(more)
