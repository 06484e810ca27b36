"""Text expressions: columns in, columns out, all inside the JVM.  Null texts count as empty where a result is wanted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import constants as C


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_quote(text: Column | str) -> Column:
    """Lower case, straight quotes, dashes to spaces, hyphens inside words joined, punctuation to spaces, single spaces."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    t = F.translate(t, "’‘—–", "''  ")
    t = F.regexp_replace(t, r"(?U)(?<=\w)-(?=\w)", "")
    t = F.regexp_replace(t, r"(?U)[^\w\s]+", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def spoken_form(normalized: Column) -> Column:
    """Spelled-out forms made alike: single letters joined, ``dot com``, ``slash``, ``and`` and ``the`` reduced."""
    t = F.regexp_replace(normalized, r"(?U)\b(\w)[\s\-]+(?=\w\b)", "$1")
    for pattern, to in ((r"(?U)\bdot\s+com\b", "com"), (r"(?U)\bslash\b", " "), (r"(?U)\band\b", " "), (r"(?U)\bthe\b", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def quote_tier(needle: Column | str, haystack: Column | str, overlap: float = C.QUOTE_OVERLAP) -> Column:
    """How a quote stands in a text: exact, spaceless, spoken, overlap, or null if it doesn't."""
    n, h = normalize_quote(needle), normalize_quote(haystack)
    tight_n, tight_h = F.replace(n, F.lit(" "), F.lit("")), F.replace(h, F.lit(" "), F.lit(""))
    sn, sh = spoken_form(n), spoken_form(h)
    nt, ht = F.split(n, " "), F.split(h, " ")
    share = F.size(F.filter(nt, lambda w: F.array_contains(ht, w))) / F.size(nt)
    return (
        F.when(n == "", F.lit(None).cast("string")).when(F.contains(h, n), "exact").when(F.contains(tight_h, tight_n), "spaceless")
        .when((sn != "") & F.contains(sh, sn), "spoken").when(share >= overlap, "overlap")
    )


def quote_matches(needle: Column | str, haystack: Column | str) -> Column:
    return quote_tier(needle, haystack).isNotNull()


def clean_caption(text: Column | str) -> Column:
    """Tags off, the four named references of captions decoded, single spaces."""
    t = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "<[^>]*>", "")
    for reference, character in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(reference), F.lit(character))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def norm_title(title: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_col(title), F.lit(""))), "[^a-z0-9]+", "")


def slugify(title: Column | str, most: int = 60) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(_col(title), F.lit(""))), "[^a-z0-9]+", "_")
    return F.rtrim(F.substring(F.regexp_replace(t, "^_+|_+$", ""), 1, most), F.lit("_"))


def make_stem(published: Column | str, title: Column | str) -> Column:
    """YYYY-MM-DD_HHMM_slug."""
    return F.concat_ws("_", F.date_format(_col(published), "yyyy-MM-dd_HHmm"), slugify(title))


def stem_of_path(path: Column | str) -> Column:
    name = F.element_at(F.split(_col(path), "/"), -1)
    return F.when(name.endswith("_stt.json"), F.regexp_replace(name, "_stt\\.json$", "")).otherwise(F.regexp_replace(name, "\\.[^.]+$", ""))


def kind_of_title(title: Column | str) -> Column:
    t = F.lower(F.coalesce(_col(title), F.lit("")))
    return F.when(t.contains("afternoon"), "afternoon").when(t.contains("sitrep") | t.contains("situation report"), "sitrep").otherwise("morning")


def question_count(text: Column | str) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    return F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit("")))


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(F.coalesce(_col(text), F.lit(""))) / 4) + 8


def escape_cue(text: Column | str) -> Column:
    """Safe inside a caption cue: no arrow, no tag."""
    return F.replace(F.replace(_col(text), F.lit("-->"), F.lit("-- >")), F.lit("<"), F.lit("&lt;"))


def replay_key(prompt_version: Column | str, model: Column | str, system: Column | str, user: Column | str) -> Column:
    """sha256 of version, model, system and user prompt with their fixed separators."""
    separator = F.concat(F.lit("\n"), F.char(F.lit(0)), F.lit("\n"))
    return F.sha2(F.concat(_col(prompt_version), F.lit("|"), _col(model), F.lit("|"), _col(system), separator, _col(user)), 256)


def word_index_of(tokens: Column, target: Column, from_end: bool = False) -> Column:
    """Place of a run of words: an exact run, else a run that is equal without spaces, else the first word alone; null
    if none.  tokens, target: arrays of normalised words."""
    n, m = F.size(tokens), F.size(target)
    places = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
    exact = F.filter(places, lambda i: F.slice(tokens, i + 1, m) == target)
    whole = F.array_join(target, "")
    every = F.when((m > 0) & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tight = F.filter(every, lambda i: F.exists(F.sequence(F.lit(1), F.lit(1) * (n - i)), lambda k: F.array_join(F.slice(tokens, i + 1, k), "") == whole))
    at = -1 if from_end else 1
    pick = lambda a: F.element_at(a, at)
    anchor = F.filter(every, lambda i: F.element_at(tokens, i + 1) == F.element_at(target, 1))
    return F.when(m == 0, F.lit(None).cast("int")).when(F.size(exact) > 0, F.try_element_at(exact, F.lit(at))).when(F.size(tight) > 0, F.try_element_at(tight, F.lit(at))).when(F.size(anchor) > 0, F.try_element_at(anchor, F.lit(at)))
