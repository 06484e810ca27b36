"""The ladder, gates, refinement, chunks and the whole classification on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import chunking, gates, ladder, refine
from spanloom.operators.propose import CallProposer, ReplayProposer, RuleProposer, record_replies, with_capabilities
from spanloom.plans.classify import classify, dry_run, effective_version

WORDS = "array<struct<w:string,s:bigint,e:bigint>>"


def segments(spark, n=40, ms=5000, text="segment {} some spoken words here", words=None):
    rows = [("ep", i, i * ms, (i + 1) * ms, text.format(i), words(i) if words else None) for i in range(n)]
    return spark.createDataFrame(rows, f"episode string, idx int, start bigint, end bigint, text string, words {WORDS}")


def replies(spark, *objects):
    return spark.createDataFrame([("ep", k, o if isinstance(o, (str, type(None))) else json.dumps(o)) for k, o in enumerate(objects)], "episode string, chunk int, obj string")


def chunks(spark, *ranges):
    return spark.createDataFrame([("ep", k, a, b) for k, (a, b) in enumerate(ranges)], "episode string, chunk int, a int, b int")


def span(i, j, confidence=0.9, evidence=None, **more):
    return {"start_index": i, "end_index": j, "kind": "midroll", "confidence": confidence, "evidence": f"segment {i} some spoken" if evidence is None else evidence, **more}


def run(spark, seg, obj, *ranges):
    found, log = ladder.run_pass(seg, chunks(spark, *(ranges or [(0, 40)])), replies(spark, *obj))
    return sorted((r.start_index, r.end_index, r.confidence, r.state) for r in found.collect()), sorted(r.reason for r in log.collect())


def test_clip_merge_and_evidence(spark):
    seg = segments(spark)
    assert run(spark, seg, [{"ad_spans": [span(-3, 4), span(50, 60)]}], (2, 10)) == ([(2, 4, 0.9, "ad")], ["clipped", "outside labelable window"])
    assert run(spark, seg, [{"ad_spans": [span(4, 7), span(8, 11, 0.5)]}])[0] == [(4, 11, 0.5, "uncertain")]
    assert run(spark, seg, [{"ad_spans": [span(9, 5, 0.8, "segment 5 some")]}])[0] == [(5, 9, 0.8, "ad")]
    assert run(spark, seg, [{"ad_spans": [span(5, 6, 0.9, "nothing of the kind at all")]}]) == ([(5, 6, 0.45, "uncertain")], ["evidence not found"])


def test_clip_of_bare_spans(spark):
    bare = spark.createDataFrame([("ep", 0, k, i, j) for k, (i, j) in enumerate([(-2, 3), (2, 7), (18, 23), (21, 26)])], "episode string, chunk int, ord int, start_index int, end_index int")
    kept, log = ladder.clip(bare, chunks(spark, (0, 20)))
    assert sorted((r.ord, r.start_index, r.end_index) for r in kept.collect()) == [(0, 0, 3), (1, 2, 7), (2, 18, 19)]
    assert sorted((r.ord, r.reason, json.loads(r.raw)) for r in log.collect()) == [(0, "clipped", {"start_index": -2, "end_index": 3}), (2, "clipped", {"start_index": 18, "end_index": 23}), (3, "outside labelable window", {"start_index": 21, "end_index": 26})]


def test_malformed(spark):
    seg = segments(spark)
    got = run(spark, seg, [{"ad_spans": [span(3.7, "5", "x", "segment 3 some"), {"start_index": "a", "end_index": 1}, "text", {"end_index": 2}]}])
    assert got == ([(3, 5, 0.0, "content")], ["indices are not integers", "indices are not integers", "item is not an object"])
    for obj, reason in (({"ad_spans": None}, []), ({}, []), ({"ad_spans": 3}, ["ad_spans is not a list"]), ([1], ["reply is not an object"]), ("junk {", ["reply is not an object"])):
        assert run(spark, seg, [obj]) == ([], reason)


def test_cap_and_seams(spark):
    long = segments(spark, 40, 30_000)
    assert run(spark, long, [{"ad_spans": [span(0, 8)]}]) == ([], ["over the longest duration"])
    seam = segments(spark, 80, 4000)
    assert run(spark, seam, [{"ad_spans": [span(30, 39)]}, {"ad_spans": [span(40, 45, 0.8)]}], (0, 40), (40, 80))[0] == [(30, 45, 0.8, "ad")]


def test_dialogue_and_straddle(spark):
    asked = segments(spark, text="segment {} some spoken words here?")
    assert run(spark, asked, [{"ad_spans": [span(5, 8)]}])[0] == [(5, 8, 0.45, "uncertain")]
    greek = ["alpha beta gamma delta", "epsilon zeta eta theta"] * 10
    seg = spark.createDataFrame([("ep", i, i * 4000, i * 4000 + 4000, t, None) for i, t in enumerate(greek)], f"episode string, idx int, start bigint, end bigint, text string, words {WORDS}")
    found, _ = ladder.run_pass(seg, chunks(spark, (0, 20)), replies(spark, {"ad_spans": [span(4, 6, 0.9, "gamma delta epsilon zeta")]}))
    assert [(r.start_index, r.confidence) for r in found.collect()] == [(4, 0.9)]


@pytest.mark.parametrize(("n", "spans", "status"), [(5, [(0, 0, "ad")], "rejected_degenerate"), (40, [(0, 30, "ad")], "rejected_degenerate"), (40, [(0, 9, "ad"), (20, 27, "uncertain")], "rejected_overlabel"), (40, [(0, 5, "ad")], "ok"), (40, [(0, 30, "content")], "ok")])
def test_gates(spark, n, spans, status):
    seg = segments(spark, n)
    s = spark.createDataFrame([("ep", i, j, i * 5000, (j + 1) * 5000, state) for i, j, state in spans], "episode string, start_index int, end_index int, start bigint, end bigint, state string")
    assert gates.episode_gates(seg, s).first().status == status
    flagged = gates.flags(seg, s)
    assert gates.flag_strings(flagged).first().flags.count("a") == len({k for i, j, t in spans if t == "ad" for k in range(i, min(j, n - 1) + 1)})


def test_refine(spark):
    words = lambda i: [(w, i * 5000 + k * 500, i * 5000 + k * 500 + 400) for k, w in enumerate("news and then buy last -minute deals".split())]
    seg = segments(spark, 12, words=words)
    s = spark.createDataFrame([("ep", 3, 5, 15_000, 30_000, "buy last-minute deals"), ("ep", 6, 7, 30_000, 40_000, "news and"), ("ep", 8, 8, 40_000, 45_000, "")], "episode string, start_index int, end_index int, start bigint, end bigint, evidence string")
    got = {r.start_index: (r.start_exact, r.end_exact, len(r.splits)) for r in refine.refine_starts(s, seg).collect()}
    assert got == {3: (16_500, 30_000, 1), 6: (30_000, 40_000, 0), 8: (40_000, 45_000, 0)}


def plain_plan(costs, most, context):
    n, least = len(costs), 3 * context
    budget = max(8 * least, most - 2 * context * (sum(costs) // n + 1))
    out, a, used = [], 0, 0
    for i, c in enumerate(costs):
        if i - a >= least and used + c > budget:
            if n - i >= context:
                out.append((a, i, used))
                a, used = i, c
            continue
        used += c
    return [*out, (a, n, used)]


def test_chunks(spark):
    import random

    r = random.Random(5)
    texts = {e: ["x" * r.randint(0, 900) for _ in range(r.randint(1, 120))] for e in range(25)}
    df = spark.createDataFrame([(e, i, t) for e, ts in texts.items() for i, t in enumerate(ts)], "episode int, idx int, text string")
    got = {}
    for row in chunking.plan_chunks(df, 3000, 4).orderBy("episode", "chunk").collect():
        got.setdefault(row.episode, []).append((row.a, row.b, row.est_tokens))
    assert {e: [(a, b) for a, b, _ in p] for e, p in got.items()} == {e: [(a, b) for a, b, _ in plain_plan([len(t) // 4 + 8 for t in ts], 3000, 4)] for e, ts in texts.items()}


def test_classify(spark):
    seg = segments(spark, 60)
    result = classify(seg, RuleProposer(F.col("idx").between(9, 12)), 2000, 3)
    row = result.episodes.first()
    assert (row.status, row.ad_spans, row.flags.count("a")) == ("ok", 1, 4)
    over = classify(seg, RuleProposer(F.col("idx") % 2 == 0), 2000, 3)
    assert over.episodes.first().status in ("rejected_overlabel", "rejected_degenerate") and over.episodes.first().flags == ""
    assert over.chunks.select("pass").distinct().count() in (1, 2)
    failed = classify(seg, ReplayProposer(spark.createDataFrame([], "key string, obj string")), 2000, 3)
    assert failed.episodes.first().status == "failed"
    assert effective_version("v1", ("a", "b")) == "v1+a+b"
    assert dry_run(seg, 2000, 3).first().chunks >= 1


def test_proposers(spark):
    req = spark.createDataFrame([("1", 0, "ok"), ("1", 1, "bad")], "episode string, chunk int, prompt string")

    def call(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return "{}"

    assert sorted((r.chunk, r.obj, r.error) for r in CallProposer(call, 2, 0).reply(req).collect()) == [(0, "{}", None), (1, None, "no")]
    old = spark.createDataFrame([("k", "1"), ("l", "2")], "key string, obj string")
    assert sorted(tuple(r) for r in record_replies(old, spark.createDataFrame([("k", "3")], "key string, obj string")).select("key", "obj").collect()) == [("k", "3"), ("l", "2")]
    runs = spark.createDataFrame([("mini",), ("large",), ("other",)], "model string")
    assert sorted((r.model, r.window) for r in with_capabilities(runs).collect()) == [("large", 200_000), ("mini", 128_000), ("other", None)]
