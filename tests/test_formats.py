"""Readers, exporters, records and streams."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.sinks import exporters as X
from spanloom.sinks import records
from spanloom.sources import readers as R

MEDIA = "episode string, duration_ms bigint, sha256 string, path string, status string"
SPAN = "episode string, id string, start bigint, end bigint, category string, form string, position string, action string, state string, confidence double, advertiser string"


@pytest.fixture(scope="module")
def record(spark):
    media = spark.createDataFrame([("a", 100_000, "f" * 64, "/x/show.mp3", "ok"), ("b", 60_000, "e" * 64, "/x/none.mp3", "ok"), ("c", None, None, None, "ok")], MEDIA)
    spans = spark.createDataFrame([("a", "ad-0001", 10_000, 20_500, "sponsor", "host_read", "midroll", "skip", "ad", 0.9, "Acme & <Co> -->"), ("a", "ad-0002", 90_000, 95_000, "selfpromo", "host_read", "unknown", "prompt", "ad", 0.8, None)], SPAN)
    return media, spans


def body(df, episode="a"):
    return df.where(F.col("episode") == episode).first().body


def test_plain_formats(record):
    assert body(X.edl(*record)) == "10.000\t20.500\t3\n" and body(X.edl(*record), "b") == ""
    assert body(X.rttm(*record)).splitlines()[0] == "SPEAKER show 1 10.000 10.500 <NA> <NA> sponsor <NA> <NA>"
    assert body(X.audacity(*record)).splitlines()[1] == "90.000\t95.000\t[Promo]"
    assert body(X.srt(*record)).startswith("1\n00:00:10,000 --> 00:00:20,500\n[Ad] Acme")
    assert R.parse_edl(X.edl(*record).withColumnRenamed("body", "raw")).collect()[0][1:] == (10_000, 20_500, 3)


def test_json_formats(record):
    sb = json.loads(body(X.sponsorblock(*record)))
    assert [s["segment"] for s in sb] == [[10.0, 20.5]] and sb[0]["UUID"] == "span-" + "f" * 12 + "-ad-0001" and json.loads(body(X.sponsorblock(*record), "b")) == []
    ch = json.loads(body(X.chapters(*record)))["chapters"]
    assert [c["title"] for c in ch] == ["Part 1", "[Ad] Acme & <Co> -->", "Part 2", "[Promo]", "Part 3"] and ch[1]["span"]["id"] == "ad-0001" and ch[3]["endTime"] == 95.0


def test_chapters_reach_three(record):
    got = [(r.start, r.end, r.title) for r in X.chapter_list(*record).where("episode = 'b'").orderBy("no").collect()]
    assert [g[:2] for g in got] == [(0, 30_000), (30_000, 45_000), (45_000, 60_000)]
    assert "title=[Ad] Acme & <Co> -->" in body(X.ffmeta(*record))


def test_vtt_round_trip(record):
    text = body(X.vtt(*record))
    assert text.startswith("WEBVTT - ") and "Acme \\u0026 \\u003cCo> --\\u003e" in text
    back = R.parse_disclosure(X.vtt(*record).withColumnRenamed("body", "raw")).orderBy("start").collect()
    assert [(r.start, r.end, r.id, r.advertiser, r.token) for r in back] == [(10_000, 20_500, "ad-0001", "Acme & <Co> -->", "SPONSOR"), (90_000, 95_000, "ad-0002", None, "SELFPROMO")]


def test_word_cut_captions(spark, record):
    words = [("one", 8_000, 8_500), ("two", 9_000, 9_500), ("buy", 10_000, 10_400), ("now", 11_000, 11_500)]
    seg = spark.createDataFrame([("a", 0, 8_000, 12_000, "one two buy now", words), ("a", 1, 12_000, 14_000, "more", None), ("a", 2, 14_000, 14_000, "zero", None), ("a", 3, 20_000, 24_000, "after", None), ("a", 4, 24_000, 25_000, " ", None)], "episode string, idx int, start bigint, end bigint, text string, words array<struct<w:string,s:bigint,e:bigint>>")
    got = [(r.idx, r.piece, r.s, r.e, r.text, r.id) for r in X.caption_cues(seg, record[1]).orderBy("idx", "piece").collect()]
    assert got == [(0, 0, 8_000, 9_500, "one two", None), (0, 1, 10_000, 11_500, "buy now", "ad-0001"), (1, 0, 12_000, 14_000, "more", "ad-0001"), (3, 0, 20_000, 24_000, "after", None)]
    out = X.export_all(*record, seg)
    assert out.count() == 30 and "<c.span-ad>[Ad] Acme" in out.where("fmt = 'captions-vtt' and episode = 'a'").first().body
    assert X.export_all(*record).where("fmt = 'captions-srt'").first().body is None


def test_captions(spark):
    vtt = "﻿WEBVTT\n\nNOTE x\ny\n\nc1\n00:01.000 --> 00:02.500 align:start\n<b>Hi</b> &amp; bye\n\n\n00:00:00.500 --> 00:00:01.000\nfirst\n\nbad --> 00:03\nno\n\nSTYLE\n::cue{}\n"
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\nA\r\nB\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n"
    got = R.parse_captions(spark.createDataFrame([("v", vtt), ("s", srt)], "episode string, raw string")).orderBy("episode", "idx").collect()
    assert [tuple(r) for r in got] == [("s", 0, 1000, 2000, "A B"), ("v", 0, 500, 1000, "first"), ("v", 1, 1000, 2500, "Hi & bye")]


def test_files(spark, tmp_path):
    (tmp_path / "e1_stt.json").write_text(json.dumps({"engine": "x", "segments": [{"start": 0.0, "end": 1.5, "text": "a", "words": [{"word": "a", "start": 0.1, "end": 0.4}]}, {"start": 1.5, "end": 2, "text": "[Music]"}]}))
    rows = R.read_transcripts(spark, str(tmp_path / "*_stt.json")).orderBy("idx").collect()
    assert [(r.episode, r.start, r.end) for r in rows] == [("e1", 0, 1500), ("e1", 1500, 2000)] and tuple(rows[0].words[0]) == ("a", 100, 400)
    assert R.drop_junk(R.read_transcripts(spark, str(tmp_path / "*_stt.json"))).count() == 1
    (tmp_path / "f.xml").write_text("<rss><channel><item><guid>g</guid><title> T </title><pubDate>Tue, 04 Aug 2026 10:00:00 GMT</pubDate><enclosure url=\"u\" type=\"t\"/></item></channel></rss>")
    assert [(r.guid, r.title, str(r.published), r.enclosure) for r in R.read_feed(spark, str(tmp_path / "f.xml")).collect()] == [("g", "T", "2026-08-04 10:00:00", "u")]
    (tmp_path / "m.json").write_text(json.dumps({"ad_map": {"ads": [{"start_sec": 1, "end_sec": 2.5, "slot": "pre", "campaign": "c", "ad_id": "i"}]}}))
    assert [tuple(r) for r in R.read_stitch_maps(spark, str(tmp_path / "m.json")).collect()] == [("m", 1000, 2500, "pre", "c", "i")]
    (tmp_path / "c.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhi\n")
    assert R.read_captions(spark, str(tmp_path / "c.vtt")).first().episode == "c"
    X.write_exports(spark.createDataFrame([("edl", "a", "x")], "fmt string, episode string, body string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().fmt == "edl"
    records.write_new(spark.range(1), str(tmp_path / "p"))
    with pytest.raises(Exception, match="already exists"):
        records.write_new(spark.range(1), str(tmp_path / "p"))


def test_headers_and_predictions(spark):
    df = spark.createDataFrame([("e", "a1#17010#pre#0#1010#c1,a2#33010#mid#1#17010#c2@g#128000#1010")], "episode string, header string")
    assert sorted((r.ad, r.s, r.e, r.slot) for r in R.decode_stitch_header(df).collect()) == [("a1", 0, 1000, "pre"), ("a2", 1000, 2000, "mid")]
    files = spark.createDataFrame([("/r/x.record.json",), ("/r/x.analysis.json",), ("/r/x_ads.json",), ("/r/y.record.json",)], "path string")
    assert sorted(r.path for r in R.best_prediction(files).collect()) == ["/r/x_ads.json", "/r/y.record.json"]


def test_problems(spark, record):
    bad = spark.createDataFrame([("a", "ad-1", 5, 5, "sponsor", "f", "p", "jump", "odd", 1.5, None)], SPAN).withColumn("edge_mode", F.lit("segment"))
    got = records.problems(records.build_records(record[0], bad)).where("episode = 'a'").first().problems
    assert got == ["ad-1: end before start", "ad-1: unknown state", "ad-1: unknown action", "ad-1: confidence out of range"]
    assert records.problems(records.build_records(record[0], bad)).where("episode = 'c'").first().problems == ["no duration"]


def test_streams(spark, tmp_path):
    from spanloom.streaming import events as E

    rows = [{"ts": f"2026-01-01T00:0{m}:00Z", "run": "r", "event": "chunk", "episode": "e", "elapsed_sec": 1.0, "cost": 0.5, "wall": 2.0} for m in range(3)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, rows)))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.table(name).collect()

    got = drain(E.run_costs(E.tail_events(spark, str(tmp_path / "log"))), "costs", "complete")
    assert [(r.events, r.cost) for r in got] == [(3, 1.5)]
    spark.createDataFrame([("e", i, f) for i, f in enumerate([*"ccaac", None])], "episode string, idx int, flag string").coalesce(1).write.json(str(tmp_path / "flags"))
    flags = spark.readStream.schema("episode string, idx int, flag string").json(str(tmp_path / "flags"))
    assert sorted((r.first_idx, r.last_idx, r.flag) for r in drain(E.stream_runs(flags), "runs", "append")) == [(0, 1, "c"), (2, 3, "a"), (4, 4, "c")]
    spark.createDataFrame([("k", "2026-01-01 00:00:00"), ("k", "2026-01-01 00:00:01")], "key string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "req"))
    req = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "req"))
    assert len(drain(E.once(req), "once", "append")) == 1
    breaks = spark.createDataFrame([("e", "2026-01-01 00:00:00.000", 10_000, "pre"), ("e", "2026-01-01 00:00:10.500", 1_500, "pre"), ("e", "2026-01-01 00:00:12.600", 400, "mid")], "episode string, ts string, duration_ms bigint, slot string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.creatives for r in E.stream_breaks(breaks).collect()) == [1, 2]
    E.append_events(spark.createDataFrame([("x",)], "event string"), str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 1


def test_cli(spark, tmp_path, capsys):
    from spanloom import cli

    assert cli.main(["describe"]) == 0 and "edl" in capsys.readouterr().out
    text = "WEBVTT\n\n" + "\n\n".join(f"00:{k:02d}.000 --> 00:{k + 1:02d}.000\n{'brought to you by us' if k == 5 else 'news of the day'} {k}" for k in range(20))
    (tmp_path / "ep.vtt").write_text(text)
    assert cli.main(["classify", "--input", str(tmp_path / "ep.vtt"), "--output", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o" / "spans")).count() == 1
    assert cli.main(["classify", "--input", str(tmp_path / "missing.vtt"), "--output", str(tmp_path / "o")]) == 5
