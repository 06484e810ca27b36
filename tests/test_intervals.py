"""Interval algebra against plain Python over random intervals."""

import random

from pyspark.sql import functions as F

from spanloom.operators import intervals as I
from spanloom.operators import islands as S


def sets(seed, n=25):
    r = random.Random(seed)
    return [[(e, s, s + r.randint(1, 40)) for e in range(n) for s in [r.randint(0, 150) for _ in range(r.randint(0, 6))]] for _ in range(2)]


def covered(rows):
    out = {}
    for e, s, t in rows:
        out.setdefault(e, set()).update(range(s, t))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "episode bigint, s bigint, e bigint")


def back(df):
    rows = [(r.episode, r.s, r.e) for r in df.collect()]
    for e in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == e)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False)), "not merged"
    return {k: v for k, v in covered(rows).items() if v}


def test_algebra(spark):
    for bucket in (7, 1000):
        a, b = sets(bucket)
        ca, cb = covered(a), covered(b)
        fa, fb = frame(spark, a), frame(spark, b)
        both = back(I.intersect(fa, fb, ["episode"], bucket))
        assert both == {k: v for k in ca if (v := ca[k] & cb.get(k, set()))}
        assert back(I.subtract(fa, fb, ["episode"])) == {k: v for k in ca if (v := ca[k] - cb.get(k, set()))}


def test_overlap_pairs_once(spark):
    a, b = sets(3)
    want = sorted((x, y) for x in set(a) for y in set(b) if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    right = frame(spark, list(set(b))).select("episode", F.col("s").alias("rs"), F.col("e").alias("re"))
    got = I.overlap_join(frame(spark, list(set(a))), right, ["episode"], bucket=5).collect()
    assert sorted(((r.episode, r.s, r.e), (r.episode, r.rs, r.re)) for r in got) == want


def test_merge_spans(spark):
    rows = [(1, 2, 4, "midroll", 0.9, "", "z", 0), (1, 5, 6, "house", 0.5, "e", "y", 1), (1, 3, 3, "preroll", 0.8, "f", "x", 2), (1, 9, 9, "house", 0.7, "", "w", 3)]
    df = spark.createDataFrame(rows, "episode int, start_index int, end_index int, kind string, confidence double, evidence string, end_evidence string, ord int")
    got = sorted(tuple(r) for r in S.merge_spans(df).drop("ord").collect())
    assert got == [(1, 2, 6, 0.5, "midroll", "f", "z"), (1, 9, 9, 0.7, "house", None, "w")]


def test_breaks_and_turns(spark):
    df = spark.createDataFrame([(1, 0, 10, "pre"), (1, 10, 12, "pre"), (1, 13, 14, "post")], "episode int, s int, e int, slot string")
    got = sorted((r.s, r.e, r.creatives, r.kind) for r in S.breaks(df, ["episode"], 0).withColumn("kind", S.kind_of_slots(F.col("slots"))).collect())
    assert got == [(0, 12, 2, "preroll"), (13, 14, 1, "postroll")]
    seg = spark.createDataFrame([(1, 0, 0, 900, "a"), (1, 1, 1000, 1500, "a"), (1, 2, 3000, 3500, "a"), (1, 3, 3500, 3600, "b"), (1, 4, 3600, 3700, None), (1, 5, 3700, 3800, None)], "episode int, idx int, start int, end int, speaker string")
    assert sorted((r.first_idx, r.last_idx, r.speaker) for r in S.turns(seg, ["episode"], "speaker").collect()) == [(0, 1, "a"), (2, 2, "a"), (3, 3, "b"), (4, 5, None)]


def test_empty(spark):
    none = frame(spark, [])
    assert I.intersect(none, none, ["episode"]).count() == I.subtract(none, none, ["episode"]).count() == S.merge_intervals(none, ["episode"]).count() == 0
