"""Chapter lists of all episodes, also short ones, against plain Python."""

from conftest import DATA, oracle_rows, rows_of
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.plans import registry


def halved(media, rows):
    """The rule of three for one episode's (start, end, title, id), in plain Python."""
    n, parts = len(rows), sum(r[2].startswith("Part ") for r in rows)
    s, e, title, id_ = rows[-1]
    third = e - (e - s) // 2
    if n == 1:
        quarter = e - (e - third) // 2
        return [(s, third, title, id_), (third, quarter, f"Part {parts + 1}", None), (quarter, e, f"Part {parts + 2}", None)]
    return [*rows[:-1], (s, third, title, id_), (third, e, f"Part {parts + 2}", None)] if n == 2 else rows


def chapters_by_hand(media, spans):
    out = {}
    for episode, duration in media:
        own = sorted(r[1:] for r in spans if r[0] == episode)
        rows, at, part = [], 0, 0
        for s, e, i, title in own:
            if s > at + 500:
                part += 1
                rows.append((at, s, f"Part {part}", None))
            rows.append((s, e, title, i))
            at = e
        if duration > at + 500:
            rows.append((at, duration, f"Part {part + 1}", None))
        if not rows or min(r[0] for r in rows) > 0:
            rows.append((0, min((r[0] for r in rows), default=duration), "Start", None))
        out[episode] = halved(duration, sorted(rows, key=lambda r: (r[0], r[3] is not None)))
    return out


def test_chapters_of_all_episodes(spark, tmp_path):
    from spanloom.plans import views as V
    from spanloom.sinks.exporters import title_of

    # A few events a user, so that episodes have no, one, two and more spans.
    few = spark.read.parquet(f"{DATA}/events.parquet").withColumn("no", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    few.where("no <= user_id % 5 * 3 + 1").drop("no").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    data = str(tmp_path)
    media, spans = V.record(spark, data)
    media = media.select("episode", "duration_ms").collect()
    spans = spans.select("episode", "start", "end", "id", title_of("category", "advertiser", "label")).collect()
    want = chapters_by_hand(media, [tuple(r) for r in spans])
    got = {}
    for r in sorted(registry.QUERIES["chapters"](spark, data).collect(), key=lambda r: (r.episode, r.no)):
        got.setdefault(r.episode, []).append((r.start, r.end, r.title, r.id))
    assert any(sum(r[0] == m[0] for r in spans) < 3 for m in media) and got == want
    bodies = {r.episode: r.body.count("[CHAPTER]") for r in registry.QUERIES["export_ffmeta"](spark, data).collect()}
    assert bodies == {k: len(v) for k, v in want.items()}


def test_span_clip_of_events_without_user(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.withColumn("user_id", F.when(F.col("user_id") % 7 > 0, F.col("user_id"))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    (tmp_path / "flat").mkdir()
    (next((tmp_path / "events.parquet").glob("part-*.parquet"))).rename(tmp_path / "flat/events.parquet")
    columns, want = oracle_rows(registry.ORACLE_SQL["span_clip"], tmp_path / "flat")
    got = registry.QUERIES["span_clip"](spark, str(tmp_path / "flat"))
    assert sorted(got.columns) == columns and rows_of(got) == want
    assert sum(r[columns.index("episode")] is None for r in want) > 20
