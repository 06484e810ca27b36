"""LM scoring against a plain twin, as a distribution, and in what its contexts see."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from spanloom.llm import lm_score as L
from spanloom.llm.common import table


def words_of(t):
    return (t or "").encode().lower().split()


def plain_steps(text, code):
    """(contexts, node, bit, place of the word) of every bit of a text, one at a time."""
    out, used, most = [], Counter(), None
    words = [*words_of(text), b""]
    for place, w in enumerate(words):
        before = None if not place else words[place - 1]
        if before is not None and len(before) > L.WHOLE:
            before = ("end", before[-2:])
        spelled = [L._START] * 4 + list(w) + [L.STOP]
        for k in range(len(w) + 1):
            tail, symbol = tuple(spelled[k : k + 4]), spelled[k + 4]
            path = int(code.rows[tail[-2] * 257 + tail[-1]]) * 256 + symbol
            for j in range(code.begins[path], code.begins[path] + code.sizes[path]):
                node = int(code.nodes[j])
                out.append(((("tail", tail), ("whole", w[:k]), ("before", before, tail[2:]), ("most", most, tail[2:])), node, bool(code.bits[j]), place))
        used[w] += 1
        if most is None or used[w] > used[most]:
            most = w
    return out


def plain_scores(train, texts):
    """log10 probabilities by dictionaries and scalars; the model's code is taken, nothing else."""
    counts, pairs = np.zeros((257, 256), np.int64), Counter()
    for t in train:
        for w in [*words_of(t), b""]:
            before, last = L._START, L._START
            for symbol in [*w, L.STOP]:
                counts[last, symbol] += 1
                pairs[before * 257 + last, symbol] += 1
                before, last = last, symbol
    common = sorted(p for p in {p for p, _ in pairs} if sum(n for (q, _), n in pairs.items() if q == p) >= L.OWN_CODE * counts.sum())
    code = L.Code.of(counts, np.array(common), np.array([[pairs[p, symbol] for symbol in range(256)] for p in common]))
    cells = defaultdict(lambda: [0, 0])
    for t in train:
        for contexts, node, bit, _ in plain_steps(t, code):
            for c in contexts:
                cells[c, node][bit] += 1
    out = []
    for t in texts:
        weights, curve = defaultdict(lambda: list(L.START)), defaultdict(lambda: L.CURVE)
        cost, block, moves = 0.0, 0, []
        for contexts, node, bit, place in [*plain_steps(t, code), (None, 0, False, 10**9)]:
            now = int((math.sqrt(1 + 8 * (place // L.BLOCK_WORDS)) - 1) // 2)
            if now != block:
                for gate, x, wrong, _ in moves:
                    curve[gate] += wrong * (1 - wrong) * sum(v * v for v in x)
                step = defaultdict(lambda: [0.0] * L.TABLES)
                for gate, x, wrong, sign in moves:
                    step[gate] = [s - L.RATE * wrong * sign * v for s, v in zip(step[gate], x, strict=True)]
                for gate, s in step.items():
                    weights[gate] = [w + v / curve[gate] for w, v in zip(weights[gate], s, strict=True)]
                block, moves = now, []
            if contexts is None:
                break
            states = [int(L.state(*(np.array([n], float) for n in cells[c, node]))[0]) for c in contexts]
            x = [float(L.STRETCH[s]) for s in states]
            gate = int(L.CONFIDENCE[states[1]]) * 4 + int(L.CONFIDENCE[states[2]])
            sign = -1 if bit else 1
            e = math.exp(max(-20, min(20, sign * sum(a * b for a, b in zip(weights[gate], x, strict=True)))))
            cost += math.log2(1 + e)
            moves.append((gate, x, e / (1 + e), sign))
        out.append(-cost * math.log10(2))
    return out


def test_scores_equal_the_plain_twin(spark):
    r = random.Random(1)
    words = ["the", "of", "and", "Anders", "ünter", "running", "x", "walking", "a\x00b", "talked"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 90))) for _ in range(30)] + [None, "", "never seen zzz", "word " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for d, t in enumerate(texts) if zlib.crc32(str(d).encode()) % 7 != 2]
    got = {x.doc_id: x.score for x in L.lm_scores(docs).collect()}
    want = plain_scores(train, texts)
    # Another sum of single floats, and now and then two contexts that share a slot.
    assert all(math.isclose(got[d], want[d], rel_tol=2e-3, abs_tol=2e-3) for d in range(len(texts)))


def test_rare_words_count_as_wholes(spark, monkeypatch):
    """Words that aren't looked up in memory count in the contexts and in the base as the others do."""
    r = random.Random(4)
    words = ["the", "of"] * 8 + [f"{a}{b}ering" for a in ("wand", "flick", "quaver") for b in ("", "b", "l")]
    texts = [" ".join(r.choices(words, k=40)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    usual = {x.doc_id: x for x in L.lm_scores(docs).collect()}
    monkeypatch.setattr(L, "LOOKED_UP", 0.1)
    got = {x.doc_id: x for x in L.lm_scores(docs).collect()}
    want = plain_scores([t for d, t in enumerate(texts) if zlib.crc32(str(d).encode()) % 7 != 2], texts)
    for d in range(len(texts)):
        assert math.isclose(got[d].score, want[d], rel_tol=2e-3) and got[d].score == usual[d].score
        assert got[d].n_known == usual[d].n_known and math.isclose(got[d].base_score, usual[d].base_score, rel_tol=1e-12)


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choices(["aa", "bbb", "cccc", "dd"], k=n)) for n in (700, 20, 3)]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    model = L.learn(docs)[0]
    raw, off = L.utf8(__import__("pyarrow").array(texts))
    for size, piece in ((1 << 18, 60_000), (1 << 18, 50), (40, 50)):
        monkeypatch.setattr(L, "PIECE", piece)
        cost = np.concatenate([L.text_costs(raw, *L.with_ends(*found), model.code, model.tables)[0] for _, _, *found in L.doc_tokens(raw, off, slice_bytes=size)])
        first = cost if piece == 60_000 else first
        assert np.allclose(cost, first, rtol=1e-5)


@pytest.mark.parametrize("row", [L._START, ord("e"), 257, 258])
def test_symbols_are_a_distribution(row):
    """Under any probabilities of the nodes, the paths of all symbols in a code add up to 1."""
    r = np.random.default_rng(row)
    counts = lambda n: r.integers(0, 50, (n, 256)) * (r.random((n, 256)) < 0.2)
    code = L.Code.of(counts(257), np.array([300, 5000]), counts(2))
    assert code.rows[5000] == 258 and code.rows[301] == 301 - 257
    one = r.random(256)
    total = 0.0
    for symbol in range(256):
        path = row * 256 + symbol
        k = slice(code.begins[path], code.begins[path] + code.sizes[path])
        total += np.prod(np.where(code.bits[k], one[code.nodes[k]], 1 - one[code.nodes[k]]))
    assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_word_before_counts(spark):
    """Equal words in another order cost more where the training texts always have them in one order."""
    rows = [(i, f"w{i % 7} red fox w{i % 5} old dog") for i in range(400)]
    docs = spark.createDataFrame([*rows, (1001, "red fox old dog"), (1001, "fox red dog old")], "doc_id long, text string")
    got = [r.score for r in L.lm_scores(docs).where("doc_id = 1001").orderBy("score").collect()]
    assert got[1] - got[0] > 0.5


def test_held_out_texts_beat_the_base(spark):
    """From sf0.01 on; on sf0.001 a third of the held-out words are unknown, which the base, no distribution, gets cheap."""
    got = L.lm_scores(table(spark, DATA.replace("0.001", "0.01"), "documents")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_no_training_rows_and_clashing_columns(spark):
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(d, "a b", "x", 1, 2, 3) for d in held], "doc_id long, text string, key string, n int, rare int, row_id int")
    got = L.lm_scores(docs).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.n_tokens == 3 and r.score < 0 for r in got)


def test_equal_words_in_equal_contexts_are_looked_up_once():
    """Ten times as many copies of a text cost as much each, and not one look more into the tables."""
    class Looks(np.ndarray):
        n = 0

        def take(self, at, *rest, **named):
            Looks.n += at.size
            return self.view(np.ndarray).take(at, *rest, **named)

        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                Looks.n += at.size
                return self.view(np.ndarray)[at]
            return super().__getitem__(at)

    code = L.Code.of(np.ones((257, 256), np.int64))
    tables = np.random.default_rng(0).integers(0, 256, (L.TABLES, 1 << L.SLOT_BITS), dtype=np.uint8).view(Looks)
    text, looks, costs = "red fox jumps over lazy dogs " * 30, [], []
    for copies in (2, 20):
        Looks.n = 0
        raw, off = L.utf8(pa.array([text] * copies))
        (_, _, *found), = L.slices(raw, off, L.SLICE) if hasattr(L, "slices") else L.doc_tokens(raw, off)
        costs.append(L.text_costs(raw, *L.with_ends(*found), code, tables)[0])
        looks.append(Looks.n)
    assert looks[1] == looks[0] > 0
    assert np.allclose(costs[0][0], np.concatenate(costs), rtol=1e-6)


def test_steps_and_slices_change_nothing(monkeypatch):
    r = random.Random(3)
    words = ["aa", "bbb", "cccc", "dd", "Éa", "x" * 40]
    texts = [" ".join(r.choices(words, k=n)) for n in (700, 20, 3, 0, 90, 1)]
    code = L.Code.of(np.ones((257, 256), np.int64))
    tables = np.random.default_rng(0).integers(0, 256, (L.TABLES, 1 << L.SLOT_BITS), dtype=np.uint8)
    raw, off = L.utf8(pa.array(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    seen = []
    for size in (1 << 20, 100):
        if size == 100:
            for name in ("SLICE", "PIECE", "COUNTED", "COUNTED_PIECE", "CUT", "STEP_WORDS", "PART"):
                monkeypatch.setattr(L, name, size // 3)
        cost = np.concatenate([L.text_costs(raw, *L.with_ends(*found), code, tables)[0] for _, _, *found in L.slices(raw, off, L.SLICE)])
        seen.append((cost, [r.to_pydict() for r in L._count_outer(code)(iter([batch]))]))
    assert np.allclose(seen[0][0], seen[1][0], rtol=1e-6) and seen[0][1] == seen[1][1]
