"""License scan: exact phrases, and short notices with a bounded number of edits.

Texts are reduced to their lower-cased words joined by single spaces.  A notice that may hold k edits is split into
k + 1 pieces; by the pigeonhole principle one piece stands unchanged in any text within k edits of it.  An
Aho-Corasick automaton finds all pieces, and around each hit the regex library's bounded-error matching verifies the
whole notice and reports the span and its edits.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases with their labels, and notices (in words) with theirs.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the creative commons attribution 4 0 international license": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "released under the mit license": "mit",
    "released under the bsd license": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this program is free software you can redistribute it and or modify": "gpl",
}
#: One edit for so many characters of a notice, one at least.
CHARS_AN_EDIT = 12

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Span:
    label: str
    first_word: int
    n_words: int
    edits: int
    share: float


@lru_cache(1)
def _search() -> tuple[ahocorasick.Automaton, dict[str, tuple[regex.Pattern, int]]]:
    pieces: dict[str, list[tuple[str, int]]] = {}
    patterns = {}
    for notice in NOTICES:
        edits = max(1, len(notice) // CHARS_AN_EDIT)
        cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            pieces.setdefault(notice[a:b], []).append((notice, a))
        patterns[notice] = regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}"), edits
    found = ahocorasick.Automaton()
    for piece, places in pieces.items():
        found.add_word(piece, (len(piece), places))
    found.make_automaton()
    return found, patterns


def reduced(text: str | None) -> tuple[int, str]:
    """Number of words, and the words lower-cased and joined by single spaces.  Null is empty."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()
    return len(words), b" ".join(words).decode("utf-8", "surrogatepass")


def phrase_places(words: str) -> dict[str, list[int]]:
    """Word places at which each phrase stands, of reduced text."""
    out = {}
    for phrase in PHRASES:
        if phrase in words:
            padded, places, at = f" {words} ", [], -1
            while (at := padded.find(f" {phrase} ", at + 1)) >= 0:
                places.append(padded.count(" ", 0, at))
            if places:
                out[phrase] = places
    return out


def notices(words: str) -> list[Span]:
    """Notices within their edits, of reduced text; of one notice no two spans overlap: those of fewest edits stay.

    Every seed is searched in a window of its own, so that a better notice nearby hides none.
    """
    automaton, patterns = _search()
    windows: dict[str, set[int]] = {}
    for end, (size, places) in automaton.iter(words):
        for notice, at in places:
            windows.setdefault(notice, set()).add(end - size + 1 - at)
    out = []
    for notice, begins in windows.items():
        pattern, most = patterns[notice]
        found = set()
        for begin in begins:
            m = pattern.search(words, max(0, begin - most), min(len(words), begin + len(notice) + most))
            if m:
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        held: list[tuple[int, int]] = []
        for edits, a, b in sorted(found):
            k = bisect(held, (a, b))
            if (k and held[k - 1][1] > a) or (k < len(held) and held[k][0] < b):
                continue
            held.insert(k, (a, b))
            first = words.count(" ", 0, a + (words[a] == " "))
            out.append(Span(NOTICES[notice], first, words[a:b].strip().count(" ") + 1, edits, 1 - edits / (2 * (most + 1))))
    return sorted(out, key=lambda s: (s.first_word, s.label))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch["text"].to_pylist():
            n, words = reduced(text)
            base = phrase_places(words)
            spans = notices(words)
            places = sorted(p for at in base.values() for p in at)
            labels = {PHRASES[p] for p in base}
            rows.append((n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(labels)), ",".join(sorted(labels | {s.label for s in spans})), max([0.75 if places else 0.0, *(s.share for s in spans)]), [(s.label, s.first_word, s.n_words, s.edits) for s in spans]))
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))
        spans = pa.array([[dict(zip(("label", "first_word", "n_words", "edits"), s, strict=True)) for s in r[7]] for r in rows], span)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)), spans], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first_word, n_words,
    edits) of every row of docs (doc_id, text).

    Score is 1 for an unchanged notice, 0.75 at least for a phrase, less for each edit, 0 if nothing is found.  Null and
    empty texts have no words and no labels (empty strings).  Repeated rows give repeated results, an empty table an
    empty one.  Texts of any length are searched whole; a null doc_id stays null; more columns are ignored.
    """
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first_word: bigint, n_words: bigint, edits: bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned, schema)
