"""Operators against plain versions on random and awkward texts."""

import random
import re

import pytest
from conftest import DATA
from test_operators import brute_overlap, frame, words_of

from spanloom.llm import decontaminate, licenses
from spanloom.llm.common import table


def plain_phrases(text):
    """(words, places, first, last, labels) by trying every place."""
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = sorted(i for i, _ in found)
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted({x for _, x in found}))


def test_phrases_are_brute_force(spark):
    table(spark, DATA, "documents")
    r = random.Random(8)
    parts = ["GNU", "general", "public", "License", "apache", "cc", "by", "MIT", "é", "ǅ", "x9", "licenſe", "mitx"]
    gaps = [" ", " ", " ", "-", "\n", " \x00", "_", "", " ", "　"]
    rows = [(d, "".join(r.choice(parts) + r.choice(gaps) for _ in range(r.randint(0, 60)))) for d in range(400)]
    rows += [(400, None), (401, ""), (402, "cc by cc by cc by"), (402, "cc by cc by cc by"), (None, "mit license")]
    got = [(x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in licenses.scan_licenses(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(d, *plain_phrases(t)) for d, t in rows], key=str)


@pytest.mark.parametrize("notice", sorted(licenses.NOTICES))
def test_every_notice_is_found_within_its_edits(notice):
    r = random.Random(notice)
    most = max(1, len(notice) // licenses.CHARS_AN_EDIT)
    for _ in range(20):
        letters = list(notice)
        for k in r.sample([k for k, c in enumerate(letters) if c != " "], r.randint(0, most)):
            letters[k] = r.choice("abcdefghij")
        spans = licenses.notices(licenses.reduced("some words before " + "".join(letters) + " and after")[1])
        assert any(s.label == licenses.NOTICES[notice] and s.edits <= most for s in spans)


def test_decontamination_of_repetitive_texts(spark):
    table(spark, DATA, "documents")
    items = ["a " * 20, "a b " * 10, "b"]
    rows = [(1, "a " * 2000), (1, "a " * 2000), (2, "a b " * 300), (None, "b"), (None, "c"), (3, "a b c " * 200)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = sorted(((d, i) for d, t in rows for i, x in enumerate(items) if brute_overlap(words_of(t)[:60], words_of(x))), key=str)
    got = decontaminate.contaminated(frame(spark, rows), bench, hot_rows=50).collect()
    assert sorted(((x.doc_id, x.item_id) for x in got), key=str) == want
    assert all(x.n_equal == 20 and x.first_word == 0 for x in got if (x.doc_id, x.item_id) in ((1, 0), (2, 1)))
    assert sorted(str(x.doc_id) for x in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()) == ["None"]
