"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA, oracle_rows, rows_of
from pyspark.sql import functions as F

from spanloom.llm import ann, decontaminate, html_extract, licenses, lm_score, mixing, near_dup, queries, token_counts, tool_calls, toxicity
from spanloom.llm.common import table

DOCS = "doc_id bigint, text string, source string, lang string, keys string, node bigint, items string, sig int, all int, h int"


def corpus(seed=0, n=120):
    """(doc_id, text): random texts, copies, near copies, nulls, empties, one long text, repeated rows."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(n)]
    base = r.choices(words, k=80)
    for _ in range(60):
        t = list(base)
        for _ in range(r.randint(0, 7)):
            t[r.randrange(80)] = r.choice(words)
        texts.append(" ".join(t))
    texts += [texts[0], texts[0].upper(), texts[1] + "\n", None, "", "  \t", "one two", "one two", " ".join(r.choices(words, k=30_000))]
    rows = list(enumerate(texts))
    return [*rows, rows[3], (None, "no id at all here now")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, ("a", "b", None)[(i or 0) % 3], "en", "x", 1, "y", 2, 3, 4) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    table(spark, DATA, "documents")
    return frame(spark, corpus())


def words_of(t):
    return (t or "").encode().lower().split()


def brute_components(rows):
    sets = {}
    for d, t in rows:
        if d is not None:
            w = words_of(t)
            k = min(5, len(w))
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates(spark, docs, monkeypatch):
    rows = corpus()
    want = brute_components(rows)
    monkeypatch.setattr(near_dup, "DIRECT", 3)
    monkeypatch.setattr(near_dup, "TILE", 20)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id, r.kept) == ((*want[r.doc_id], want[r.doc_id][1] == r.doc_id) if r.doc_id is not None else (2, None, True)) for r in got)


def test_drop_near_duplicates(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (3, "x"), (None, "a b c d e f"), (4, None)]
    rows += [(5, "p q r s t u"), (5, "quite another text of more words"), (5, "P Q R S T U"), (6, ""), (6, None)]
    kept = near_dup.drop_near_duplicates(frame(spark, rows))
    assert sorted(r.text or "" for r in kept.collect() if r.doc_id in (5, 6)) == ["", "P Q R S T U", "quite another text of more words"]
    kept = kept.where("coalesce(doc_id, 0) < 5")
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "3", "4", "None"] and kept.columns == frame(spark, rows).columns
    assert near_dup.near_duplicates(frame(spark, []).limit(0)).count() == 0


def brute_overlap(doc, item):
    size = min(decontaminate.WINDOW, len(item))
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= shift + k < len(doc) and doc[shift + k] == item[k] for k in range(len(item))]
        inside = [0 <= shift + k < len(doc) for k in range(len(item))]
        if any(all(inside[k : k + size]) and 100 * sum(same[k : k + size]) >= (75 if size >= decontaminate.MIN_ITEM else 100) * size for k in range(len(item) - size + 1)):
            return True
    return False


def test_decontamination(spark):
    r = random.Random(2)
    words = [f"b{k}" for k in range(3000)]
    items = [" ".join(r.choices(words, k=n)) for n in (30, 12, 6, 40, 5)] + ["too short", None, "", "four words in all"]
    rows = []
    for d in range(60):
        t = r.choices(words, k=50)
        if d % 3 == 0:
            piece = items[d // 3 % 5].split()
            for k in range(3, len(piece), 6):
                if d % 2:
                    piece[k] = "changed"
            t[20:20] = piece
        rows.append((d, " ".join(t)))
    rows += [(60, None), (61, ""), (62, items[0].upper()), (62, items[0].upper()), (63, "is too short"), (64, "too long short"), (65, "four words of all"), (66, "Four words in all."), (67, "x four words in all"), (None, items[1])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = Counter((d, i) for d, t in rows for i, x in enumerate(items) if words_of(x) and brute_overlap(words_of(t), words_of(x)))
    for bits, hot in ((decontaminate.MOST_BITS, decontaminate.HOT_ROWS), (6, 1)):
        got = Counter((x.doc_id, x.item_id) for x in decontaminate.contaminated(frame(spark, rows), bench.union(bench.limit(1)), bits, hot).collect())
        assert got == want and got[62, 0] == 2
    clean = decontaminate.drop_contaminated(frame(spark, rows), bench, 6, 1)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(d for d, _ in rows if not any(w[0] == d for w in want))
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_masks_miss_no_window():
    from itertools import combinations

    for n in range(decontaminate.MIN_ITEM, decontaminate.WINDOW + 1):
        for bad in combinations(range(n), n // 4):
            assert any(all(p + k not in bad for k, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(n - len(m) + 1))


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for i, t in corpus():
        size[("a", "b", None)[(i or 0) % 3]] += len(words_of(t))
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), (3, 1, 2), strict=True))
    total, target, open_ = 1.5 * sum(size.values()), {}, set(size)
    while True:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
    assert len(got) == len(corpus()) and all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert rows_of(mixing.mix(docs)) == sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in (r.doc_id, r.size, r.source, r.source_size, r.taken, r.target)) for r in got), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("sources", "words"), [(40, 20), (5, 6), (3, 1)])
def test_small_sources_have_their_share(spark, monkeypatch, sources, words):
    rows = [(k, "w " * words, f"s{k:02}") for k in range(sources)] + [(None, "x y", "s00")] * 4 + [(0, None, "s01"), (7, "a b c", "s02")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_mixing_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 500)
    r = random.Random(9)
    rows = [(d if d % 3 else None, "w " * r.choice((0, 1, 7, 40, 900)), "abc"[d % 7 % 3]) for d in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    taken, target = Counter(), {x.source: x.target for x in got}
    for x in got:
        taken[x.source] += x.taken
    # Each shard's quota is whole, and a source's quotas add up to its seats.
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items()) and all(0 <= x.taken <= 2 * x.size for x in got)


def test_sainte_lague(spark):
    votes = [("x", v) for v in (53, 24, 23, 0, 7)] + [("y", v) for v in (1, 1, 1)]
    df = spark.createDataFrame([(g, k, v, {"x": 17, "y": 2}[g]) for k, (g, v) in enumerate(votes)], "g string, k int, v int, seats int")
    got = {r.k: r.won for r in mixing.sainte_lague(df, ["g"], [F.col("k")], "v", "seats").collect()}
    want = dict.fromkeys(range(len(votes)), 0)
    for g, seats in (("x", 17), ("y", 2)):
        offers = sorted((-v / (2 * n + 1), k) for k, (h, v) in enumerate(votes) if h == g and v for n in range(seats))
        for _, k in offers[:seats]:
            want[k] += 1
    assert got == want


def test_toxicity(spark):
    r = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiouy"]
    rows, labels = [], []
    for d in range(400):
        t = r.choices(words, k=40)
        bad = d % 4 == 0
        if bad:
            for _ in range(3):
                t[r.randrange(40)] = r.choice(["scumbag", "sсumbag", "5cumbag", "vilething"])
        rows.append((d, " ".join(t)))
        labels.append((d, int(bad)))
    rows += [(400, None), (401, ""), (None, "scumbag")]
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(toxicity.labelled(frame(spark, rows), lab))
    assert {"scumbag", toxicity.fold("vilething")} <= set(lexicon.weights)
    truth = dict(labels)
    got = toxicity.toxicity(frame(spark, rows), lexicon).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert held and all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in held)
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    assert all(x.score == 0 for x in got if x.doc_id in (400, 401))
    assert toxicity.drop_toxic(frame(spark, rows), lexicon).count() == sum(x.predicted == 0 for x in got)
    assert toxicity.learn(toxicity.labelled(frame(spark, rows), lab.limit(0))).weights == {}


def test_toxic_exceptions():
    a = toxicity.Lexicon({"trash": 4.0, toxicity.fold("lowe*"): 3.0, toxicity.fold("loser"): 2.0, toxicity.fold("vile"): 2.0}).automaton()
    d = lambda t: toxicity.density(t, a)
    assert d("a trash can") == 0 and d("TRA5H talk") > 0 and d("trashy") == 0 and d("loweich") > 0 and d("a loweich trash") > d("a loweich b") and d(None) == 0 and d("tгash") == 0
    assert d("1oser") == d("loser") == d("v!le") == d("viⅼe") == d("|oser") > 0 and d("sore l0ser") == 0


def test_licenses(spark):
    rows = [(1, "Released under the MIT License. mit  license!"), (2, "Licensd under the Apache Lisense, Version 2.0."), (3, "cc-by"), (4, None), (5, ""), (6, "ccby mit-licensee"), (6, "ccby mit-licensee")]
    got = sorted(licenses.scan_licenses(frame(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [(7, 2, 3, 5, "mit"), (8, 0, None, None, ""), (2, 1, 0, 0, "cc-by"), (0, 0, None, None, ""), (0, 0, None, None, ""), (3, 0, None, None, ""), (3, 0, None, None, "")]
    assert got[0].score == 1 and "apache-2.0" in got[1].labels and got[1].spans[0].edits == 2 and got[3].score == 0


def test_neighbouring_notices(spark):
    spans = lambda t: [(s.label, s.first_word, s.edits) for s in licenses.notices(licenses.reduced(t)[1]) if s.label in ("mit", "lgpl")]
    assert spans("released under the mit licence released under the mit license") == [("mit", 0, 1), ("mit", 5, 0)]
    assert spans("relased under the mt license relased under the mt license released under the mit license") == [("mit", 0, 2), ("mit", 5, 2), ("mit", 10, 0)]
    assert spans("Licensed under the GNU Leser General Public License, licensed under the GNU Lesser General Public License") == [("lgpl", 0, 1), ("lgpl", 8, 0)]
    long = "word " * 50_000 + "released under the mit license"
    rows = [(1, long), (None, "mit license"), (None, None)]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    assert sorted((r.n_words, r.first_word or 0) for r in got) == [(0, 0), (2, 0), (50_005, 50_003)]
    assert licenses.scan_licenses(frame(spark, []).limit(0)).count() == 0


def test_token_counts(spark, docs, monkeypatch):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    r = random.Random(3)
    parts = ["a", "the", "in", " ", "  ", "\n", "▁", "é", "日", "<s>", "\t", "😀", "\x00", "Ⅳ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["ab" * 3000, " " * 70]
    table = token_counts.merges(token_counts.MODEL)
    want = [len(x) for x in library.encode(texts)]
    assert token_counts.count_batch(texts, table, {}, []) == want
    monkeypatch.setattr(token_counts, "LONG", 3)
    assert token_counts.count_batch(texts, table, {}, []) == want
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in token_counts.token_counts(docs).collect()}
    assert all(got[d] == (len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t in corpus())


def test_lm(spark, docs):
    rows = corpus()
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in [*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    got = lm_score.lm_scores(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, t in rows:
        tokens = [*words_of(t), None]
        want[d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(tokens), sum(w in counts for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_score.lm_scores(docs.limit(0)).count() == 0


def test_tool_calls(spark):
    turns = [
        (1, 0, "user", "hi \"x\"\n"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (2, 0, "system", "s"), (2, 1, "assistant", "orphan"), (None, 0, "user", "lost"),
        (3, 0, "assistant", '{"tool_calls":[{"id":"b","name":"reply","arguments":{"turn":1,"text":"t"},"after":["a"]},{"id":"a","name":"reply","arguments":{"text":3,"turn":1,"z":0}},{"id":"c","name":"no"}]}'),
        (3, 1, "tool", '{"tool_call_id":"b","content":"done"}'), (4, 0, "assistant", '{"tool_calls":[{"id":"p","name":"reply","after":["q"]},{"id":"q","name":"reply","after":["p"]}]}'),
    ]
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")).collect()}
    assert {k: (r.status, r.level) for k, r in got.items()} == {(1, "0"): ("ok", 0), (1, "2"): ("invalid", 0), (2, "0"): ("orphan", None), (3, "a"): ("invalid", 0), (3, "b"): ("ok", 1), (3, "c"): ("invalid", 0), (4, "p"): ("cycle", None), (4, "q"): ("cycle", None)}
    assert got[3, "a"].problems == "unknown z; not string text" and got[1, "2"].problems == "missing text" and got[3, "c"].problems == "unknown tool"
    assert got[3, "b"].line == '{"arguments":{"text":"t","turn":1},"id":"b","name":"reply","result":"done"}'
    assert tool_calls.link(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")).count() == 0


def test_html(spark):
    assert html_extract.blocks("<div>a<b>b</b>&amp;c<br>d <p>e <script>if(a<b){}</script>f</p><nav>m</nav><span class='ad'>AD</span>g<!-- x --><footer>z</div>q") == [(0, "ab&c"), (0, "d"), (0, "e"), (0, "f"), (0, "g"), (0, "q")]
    assert html_extract.blocks(None) == html_extract.blocks("") == html_extract.blocks("<div") == [] and html_extract.blocks("a < b") == [(0, "a < b")]
    words = [f"t{k}" for k in range(5000)]
    r = random.Random(6)
    menu, note = " ".join(r.choices(words, k=20)), " ".join(r.choices(words, k=12))
    pages, want = [], {}
    for k in range(40):
        own = " ".join(r.choices(words, k=30))
        plain = k % 2
        pages.append((k, f"https://h.org/{k}", f"<body><header>Site</header><div>{menu}</div><div class='cookie-notice'>eat</div>{'<div>' if plain else '<article><h1>T</h1>'}<p>{own}</p>{'</div>' if plain else '<aside>x</aside></article>'}<div>{note}</div><div id=comments>me too</div><form>f</form><footer>c</footer></body>"))
        want[k] = own if plain else f"T {own}"
    pages += [(100, None, None), (101, "https://h.org/x", ""), (102, "u", "<p>alone</p>"), (102, "u", "<p>alone</p>")]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit(1)))
    rows = {x.page_id: x for x in got.collect()}
    assert got.count() == 44 and all(rows[k].text == t and rows[k].n_chars == len(t) for k, t in want.items())
    assert rows[100].text == rows[101].text == "" and rows[102].text == "alone"


def test_html_names():
    """Only whole names say what an element is, and none drops an article or what holds one."""
    texts = lambda h: [t for _, t in html_extract.blocks(h)]
    assert texts('<article class="post share-enabled"><p>a</p></article>') == ["a"]
    assert texts('<main class="has-sidebar"><p>a</p></main>') == ["a"]
    assert texts('<div class="layout-sidebar-right"><article>a</article></div>') == ["a"]
    assert texts('<div class="sidebar menu">x<main>a</main>y</div>z') == ["a", "z"]
    assert texts('<p>so <span class="ad-free">far</span> so good</p>') == ["so far so good"]
    assert texts('<div id="comments"><article class="comment">me too</article></div><div class="site-footer">x</div>a') == ["a"]
    assert texts("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"] and texts("<p>" + "word " * 100_000) == [("word " * 100_000).strip()]


def test_html_runs_inside_blocks(spark):
    """Where structure says nothing, runs on many pages of the host go, also from the middle of a block."""
    r = random.Random(3)
    words = [f"t{k}" for k in range(5000)]
    note, menu = " ".join(r.choices(words, k=14)), " ".join(r.choices(words, k=9))
    pages, want = [], {}
    for k in range(60):
        a, b = (" ".join(r.choices(words, k=40)) for _ in range(2))
        pages.append((k, f"https://h.org/{k}", f"<div>{menu}</div><div>{a} {note} {b}</div>"))
        want[k] = f"{a} {b}"
    pages += [(100 + k, "https://copies.org", f"<div>{want[0]}</div>") for k in range(50)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for chars in (6_000_000, 20_000):
        got = {x.page_id: x.text for x in html_extract.extract(df, chars).collect()}
        assert all(got[k] == t for k, t in want.items()) and all(got[100 + k] == want[0] for k in range(50))


def test_html_texts_do_not_depend_on_shards(spark):
    """Runs count over the whole host: rare ones, those near a threshold and pages of any kind, in one shard or many."""
    r = random.Random(11)
    words = [f"t{k}" for k in range(5000)]
    notes = [" ".join(r.choices(words, k=12)) for _ in range(12)]
    pages = []
    for k in range(240):
        # Note j stands on j + 6 pages of 240: 12 pages are the share that decides.
        own = [" ".join(r.choices(words, k=25)), *(n for j, n in enumerate(notes) if k % 40 == j and k // 40 < 6), *(notes[j] for j in range(12) if 239 - k < j)]
        body = "".join(f"<p>{x}</p>" for x in own)
        pages.append((k, "https://h.org/x", f"<article>{body}<p>{'stop ' * 9 if k % 5 else ''}</p></article>" if k % 3 == 0 else f"<div>{body}</div>" if k % 50 else ""))
    pages += [(1000 + k, f"https://o{k % 3}.org/", f"<p>{notes[k % 12]} {k}</p>") for k in range(30)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    whole, *others = ({x.page_id: x.text for x in html_extract.extract(df, chars).collect()} for chars in (6_000_000, 9_000, 2_000))
    assert len(whole) == 270 and all(o == whole for o in others)
    plain = [t for k, t in whole.items() if k < 1000 and k % 3]
    assert any(n in t for n in notes for t in plain) and sum(n in h for n in notes for k, _, h in pages[:240] if k % 3) > sum(n in t for n in notes for t in plain)


def test_coverage_is_brute_force():
    r = np.random.default_rng(8)
    words, page = r.integers(0, 3, 400).astype(np.uint64), np.sort(r.integers(0, 12, 400))
    page = np.unique(page, return_inverse=True)[1]
    seen = defaultdict(set)
    spots = [k for k in range(400 - html_extract.RUN + 1) if page[k] == page[k + html_extract.RUN - 1]]
    for k in spots:
        seen[tuple(words[k : k + html_extract.RUN])].add(page[k])
    want = np.zeros(400, bool)
    for k in spots:
        if len(seen[tuple(words[k : k + html_extract.RUN])]) >= 3:
            want[k : k + html_extract.RUN] = True
    assert np.array_equal(html_extract.coverage(words, page, 3, 0.0), want)


def test_ann(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROOT", 5)
    monkeypatch.setattr(ann, "BLOCK", 64)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    v = (centres[r.integers(0, 12, 900)] + 0.4 * r.normal(size=(900, 16))).astype(np.float32)
    v[100:150] = v[99]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(3, v[3].tolist(), 0), (1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [None] * 16, 0), (None, v[0].tolist(), 0), (1080, [1.0], 0)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    exact = v.astype(float) @ v.astype(float).T
    hit = 0
    for q in range(0, 900, 20):
        mine = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21)) and all(math.isclose(s, exact[q, i], rel_tol=1e-9) for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        others = [i for i in range(900) if i != q]
        hit += len({i for _, i, _ in mine} & set(sorted(others, key=lambda i: (-exact[q, i], i))[:20]))
    assert {x.query_id for x in got} == set(range(0, 900, 20)) and hit >= 0.9 * 20 * 45
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_ann_doubles_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.25, 0.0]), (2, [1.25000004, 0.0]), (3, [1e200, 1.0]), (4, [-1e200, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 3.0])]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("part", F.lit("x"))).select("query_id", "rank", "vec_id", "score").collect())
    assert got[:5] == [(0, 1, 3, 1e200), (0, 2, 2, 1.25000004), (0, 3, 1, 1.25), (0, 4, 20, 0.0), (0, 5, 4, -1e200)]
    assert [r[2] for r in got[5:]] == [3, 0, 1, 2, 4] and got[5][3] == 2.0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    columns, expected = oracle_rows(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns and rows_of(df) == expected


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = table(spark, DATA, "documents")
    lexicon = toxicity.learn(toxicity.labelled(docs, table(spark, DATA, "labels")))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, lexicon).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    comp = brute_components(rows)
    rows = [(d, t) for d, t in rows if comp[d][1] == d]
    items = [words_of(r.text) for r in table(spark, DATA, "benchmark").collect()]
    rows = {d: len(words_of(t)) for d, t in rows if not any(brute_overlap(words_of(t), x) for x in items if len(set(x) & set(words_of(t))) >= 5)}
    got = P.run(spark, DATA).collect()
    assert [s[0] for s in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing"]
    assert {r.doc_id for r in got} <= set(rows) and all(r.size == rows[r.doc_id] and 0 < r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * sum(rows.values())) <= 0.02 * sum(rows.values())
