"""Text, time and JSON expressions."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import model_json, spans, text, times


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


@pytest.mark.parametrize(("raw", "want"), [("Last-Minute  deals!", "lastminute deals"), ("It’s—fine", "it s fine"), ("été, ÉTÉ", "été été"), (None, ""), ("", "")])
def test_normalize_quote(spark, raw, want):
    assert one(spark, text.normalize_quote(F.lit(raw))) == [want]


@pytest.mark.parametrize(
    ("needle", "hay", "tier"),
    [
        ("buy now", "please Buy now, friends", "exact"), ("last minute", "the last-minute offer", "spaceless"), ("go to better dot com", "go to better com today", "spoken"), ("one two three four", "four three x two", "overlap"),
        ("one two three four", "one two y", None), ("", "anything", None), ("b e t t e r", "better", "spaceless"), ("and the shop slash now", "shop now", "spoken"),
    ],
)
def test_quote_tiers(spark, needle, hay, tier):
    assert one(spark, text.quote_tier(F.lit(needle), F.lit(hay))) == [tier]


def test_word_index(spark):
    words = F.array(*map(F.lit, ["so", "last", "minute", "deals", "so"]))
    at = lambda *t, end=False: text.word_index_of(words, F.array(*map(F.lit, t)) if t else F.array().cast("array<string>"), end)
    assert one(spark, at("last", "minute"), at("lastminute"), at("so", "x"), at("so", "x", end=True), at("nope"), at()) == [1, 1, 0, 4, None, None]


@pytest.mark.parametrize(("stamp", "ms"), [("01:02:03.045", 3723045), ("02:03,5", 123500), ("100:00:00.000", 360000000), ("x", None), ("1", None), ("00:00:01", 1000)])
def test_stamps(spark, stamp, ms):
    assert one(spark, times.parse_stamp(F.lit(stamp))) == [ms]


def test_dates(spark):
    got = one(spark, *[times.rfc822(F.lit(x)).cast("string") for x in ("Tue, 04 Aug 2026 10:00:00 GMT", "4 Aug 2026 10:00:00 +0200", "04 Aug 2026 10:00:00", "junk")])
    assert got == ["2026-08-04 10:00:00", "2026-08-04 08:00:00", "2026-08-04 10:00:00", None]


def test_titles_and_stems(spark):
    got = one(spark, text.slugify(F.lit(" Hello, World! ")), text.norm_title(F.lit("A-b C")), text.kind_of_title(F.lit("Afternoon news")), text.stem_of_path(F.lit("/a/b_stt.json")), text.stem_of_path(F.lit("/a/b.c.vtt")), text.escape_cue(F.lit("a --> <b>")))
    assert got == ["hello_world", "abc", "afternoon", "b", "b.c", "a -- > &lt;b>"]


def test_replay_key(spark):
    import hashlib

    assert one(spark, text.replay_key(F.lit("v"), F.lit("m"), F.lit("s"), F.lit("u"))) == [hashlib.sha256(b"v|m|s\n\0\nu").hexdigest()]


def test_model_json(spark):
    assert model_json.balanced_object('x {bad} {"a": "}{", "b": {"c": 1}} y') == '{"a": "}{", "b": {"c": 1}}'
    assert model_json.balanced_object("<think>{\"no\":1}</think>{\"a\":1}") == '{"a":1}'
    assert model_json.balanced_object('{oops {"a":1}} {"b":2}') == '{"b":2}' and model_json.balanced_object("{" * 50_000) is None
    assert model_json.balanced_object(None) is None and model_json.balanced_object("{ open") is None
    got = [r[0] for r in spark.createDataFrame([('{"a":1}',), ("t {\"b\":2}",), (None,)], "t string").select(model_json.extract_object(F.col("t"))).collect()]
    assert got == ['{"a":1}', '{"b":2}', None]


def test_span_rules(spark):
    got = one(spark, spans.state_for(F.lit(0.75)), spans.state_for(F.lit(0.4)), spans.state_for(F.lit(0.39)), spans.action_for(F.lit("selfpromo"), F.lit("ad")), spans.clamp_confidence(F.lit("x")), spans.clamp_confidence(F.lit("1.5")), spans.kind_or_default(F.lit("?")), spans.title_of(F.lit("sponsor"), F.lit("Acme")), spans.title_of(F.lit("odd"), style="sponsorblock"))
    assert got == ["ad", "uncertain", "content", "prompt", 0.0, 1.0, "midroll", "[Ad] Acme", "[SponsorBlock]: Odd"]


def test_id3(spark):
    head = bytearray(b"ID3\x04\x00\x00\x00\x00\x02\x01")
    assert one(spark, spans.id3_size(F.lit(bytes(head))), spans.id3_size(F.lit(b"\xff\xfb" + bytes(8)))) == [2 * 128 + 1 + 10, 0]


def test_match_quotes_loses_no_tier(spark):
    import random

    from spanloom.functions.text import quote_tier
    from spanloom.operators.quotes import match_quotes

    r = random.Random(4)
    words = ["the", "of", "red", "fox", "dot", "com", "blackbird", "black", "bird", "a", "b", "runs", "well-known", "é"]
    texts = [" ".join(r.choices(words, k=r.randint(1, 25))) for _ in range(80)] + [None, "", "..."]
    quotes = [" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(90)] + [None, "", "blackbird com"]
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = q.crossJoin(t).select("item_id", "doc_id", quote_tier("quote", "text").alias("tier")).where("tier is not null")
    got = sorted(tuple(x) for x in match_quotes(q, t).collect())
    assert got == sorted(tuple(x) for x in want.collect()) and {x[2] for x in got} == {"exact", "spaceless", "spoken", "overlap"}
