"""Toxicity by a weighted lexicon.

Text is folded one character to one: lower case, homoglyphs of Latin letters to those letters, digits and signs that
stand for letters to those letters; the signs for i also stand for l, so l folds to i.  An Aho-Corasick automaton finds the lexicon's words and the exception phrases in
the folded text; a word inside an exception phrase doesn't count.  The weights of what remains, one for each word of
the text, are summed and divided by the text's number of words plus SLACK.

The lexicon is learned from labelled rows; it holds words and stems (the first STEM letters, written with a star), so
that inflected and compound forms are known too.  A word's weight is its smoothed log odds of standing in toxic against clean
texts.  Words of many copies of one text are told from words of the language by their left neighbours: few distinct
ones mean copies.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What folding maps, in natural order.
SUBSTITUTES = {"!": "i", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "l": "i", "|": "i"}
GREEK = dict(zip("αβγεηικνορτυχω", "abyenikvoptuxw", strict=True))
CYRILLIC = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "idiot proof", "sore loser", "worthless cheque", "pathetic fallacy")

#: Labelled rows that the lexicon and the threshold are learned from, at most (more or less; a hash of doc_id chooses).
TRAIN_ROWS = 40_000
MIN_DOCS = 3
MIN_WEIGHT = 2.0
STEM = 4
SLACK = 50
CUT = 0.3

_HOMOGLYPHS = str.maketrans(GREEK | CYRILLIC | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): SUBSTITUTES.get(str(k), str(k)) for k in range(10)} | {"ı": "i", "ɑ": "a", "ɡ": "g"} | dict(zip("ⅰⅴⅹⅼⅽⅾⅿ", "ivxicdm", strict=True)))
_MAY_FOLD = re.compile("[ıɑɡͰ-ӿԀ-ԯⅰ-ⅿ０-ｚ]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """The folded text; of the same length where lower-casing keeps the length.  Null is empty."""
    text = (text or "").lower()
    if _MAY_FOLD.search(text):
        text = text.translate(_HOMOGLYPHS)
    for sign, letter in SUBSTITUTES.items():
        if sign in text:
            text = text.replace(sign, letter)
    return text


@dataclass(frozen=True)
class Lexicon:
    """weights by folded word; exceptions: folded phrases; half: the density that scores 0.5."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = field(default_factory=lambda: tuple(map(fold, EXCEPTIONS)))
    half: float = 0.1

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        entries: dict[str, list[tuple[float, bool, bool]]] = defaultdict(list)
        for term, weight in self.weights.items():
            entries[term.removesuffix("*")].append((weight, term.endswith("*"), False))
        for phrase in self.exceptions:
            entries[phrase].append((0.0, False, True))
        for word, kinds in entries.items():
            if word:
                found.add_word(word, (len(word), kinds))
        if len(found):
            found.make_automaton()
        return found


def density(text: str | None, automaton: ahocorasick.Automaton) -> float:
    """Weight of the lexicon's words outside exception phrases, by the number of words; 0 for null and empty texts."""
    folded = fold(text)
    if not folded or not len(automaton):
        return 0.0
    hits: dict[int, float] = {}
    free = []
    for end, (size, kinds) in automaton.iter(folded):
        begin = end - size + 1
        if begin and folded[begin - 1].isalpha():
            continue
        whole = end + 1 == len(folded) or not folded[end + 1].isalpha()
        for weight, stem, harmless in kinds:
            if harmless and whole:
                free.append((begin, end))
            elif not harmless and (stem or whole):
                hits[begin] = max(weight, hits.get(begin, 0.0))
    total = math.fsum(w for k, w in hits.items() if not any(a <= k <= b for a, b in free))
    return total / (len(folded.split()) + SLACK) if total else 0.0


def terms_of(word: str) -> tuple[str, ...]:
    """What of a word can be an entry: itself, and its stem if it is longer."""
    return (word, f"{word[:STEM]}*") if len(word) > STEM else (word,)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word, by label; the empty word counts all documents."""
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x[1] for x in found.values()], pa.int64()), pa.array([x[0] for x in found.values()], pa.int64())], ["term", "n1", "n0"])
        found.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = set(_WORD.findall(fold(text)))
            for term in {"", *words, *(f"{w[:STEM]}*" for w in words if len(w) > STEM)}:
                found[term][toxic] += 1
            if len(found) > 300_000:
                yield flush()
    yield flush()


def _neighbours(terms: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch["text"].to_pylist():
                words = ["", *_WORD.findall(fold(text))]
                seen.update((t, words[k]) for k, w in enumerate(words[1:]) for t in terms_of(w) if t in terms)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.string())], ["term", "left"])

    return run


def _densities(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([min(4000, round(1000 * density(t, automaton))) for t in batch["text"].to_pylist()], pa.int64())], ["toxic", "bin"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of training rows: those of a label and crc32(doc_id) mod 4 other than 2, about train_rows at most.

    Several labels of a doc_id count as the largest.  The sample is small by its bound, so it is broadcast.
    """
    train = labels.where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 4 <> 2").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = train.count()
    if n > train_rows:
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(train), "doc_id").select("text", "toxic")


def learn(train: DataFrame) -> Lexicon:
    """The lexicon and its scale from (text, toxic).  Without a toxic or a clean row, nothing is toxic."""
    counts = train.mapInArrow(_count, "term string, n1 bigint, n0 bigint").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = counts.persist()
    total = counts.where("term = ''").first()
    if total is None or not total.n1 or not total.n0:
        counts.unpersist()
        return Lexicon({})
    weight = F.log(((F.col("n1") + 0.5) / (total.n1 + 1)) / ((F.col("n0") + 0.5) / (total.n0 + 1)))
    terms = counts.where(f"term <> '' and n1 >= {MIN_DOCS}").withColumn("weight", weight).where(f"weight >= {MIN_WEIGHT}").collect()
    counts.unpersist()
    lefts = {r.term: r.n for r in train.where("toxic = 1").mapInArrow(_neighbours(frozenset(t.term for t in terms)), "term string, left string").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = {t.term: t.weight for t in terms if lefts.get(t.term, 0) >= max(MIN_DOCS, min(0.25 * t.n1, 50))}
    lexicon = Lexicon(weights)
    bins = train.mapInArrow(_densities(lexicon), "toxic int, bin bigint").groupBy("bin").agg(F.sum("toxic").alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0")).orderBy("bin").collect()
    return Lexicon(weights, lexicon.exceptions, _threshold(bins) * (1 - CUT) / CUT)


def _threshold(bins: list) -> float:
    """The density of the best F1 on the training rows; the middle of the gap below it, so that unseen texts have room."""
    at = np.array([b.bin for b in bins], float)
    above1 = np.cumsum([b.n1 for b in bins][::-1])[::-1]
    above0 = np.cumsum([b.n0 for b in bins][::-1])[::-1]
    f1 = np.where(at > 0, 2 * above1 / (above1 + above0 + above1[0]), -1)
    best = int(np.argmax(f1))
    below = at[best - 1] if best else 0.0
    return max(at[best] / 2, (at[best] + below) / 2, 1.0) / 1000


def score(text: str | None, automaton: ahocorasick.Automaton, half: float) -> float:
    """0 to 1; CUT exactly at the learned threshold."""
    d = density(text, automaton)
    return d / (d + half)


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    Null and empty texts score 0.  A null doc_id is held out unless crc32 says otherwise: it counts as false.  Repeated
    rows give repeated results, an empty table an empty one.  Texts of any length are read whole; more columns are
    ignored.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(lexicon), "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def _scores(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([score(t, automaton, lexicon.half) for t in batch["text"].to_pylist()], pa.float64())], ["doc_id", "score"])

    return run


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs whose score is below CUT, with all their columns; rows pass in place, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield batch.filter(pa.array([score(t, automaton, lexicon.half) < CUT for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
