"""Scalar rules of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import constants as C


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlap(s1: Column | str, e1: Column | str, s2: Column | str, e2: Column | str) -> Column:
    return F.greatest(F.lit(0), F.least(_col(e1), _col(e2)) - F.greatest(_col(s1), _col(s2)))


def clamp_confidence(value: Column | str) -> Column:
    """Between 0 and 1; what isn't a number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_col(value).try_cast("double"), F.lit(0.0))))


def state_for(confidence: Column | str) -> Column:
    c = _col(confidence)
    return F.when(c >= C.AD_THRESHOLD, "ad").when(c >= C.UNCERTAIN, "uncertain").otherwise("content")


def kind_or_default(kind: Column | str) -> Column:
    k = _col(kind)
    return F.when(k.isin(*C.KINDS), k).otherwise("midroll")


def _mapped(kind: Column | str, place: int) -> Column:
    k = _col(kind)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, values in C.KIND_MAP.items():
        out = out.when(k == name, values[place])
    return out.otherwise(C.OTHER_KIND[place])


def category_of(kind: Column | str) -> Column:
    return _mapped(kind, 0)


def form_of(kind: Column | str) -> Column:
    return _mapped(kind, 1)


def position_of(kind: Column | str) -> Column:
    return _mapped(kind, 2)


def action_for(category: Column | str, state: Column | str) -> Column:
    c, s = _col(category), _col(state)
    return F.when((s == "ad") & ~c.isin(*C.NEVER_SKIP), "skip").when(s.isin("ad", "uncertain"), "prompt").otherwise("none")


def title_of(category: Column | str, advertiser: Column | str | None = None, style: str = "label") -> Column:
    """``[Ad] name``, or the community style ``[SponsorBlock]: Sponsor``; an unknown category is its own label."""
    c = _col(category)
    names = C.SPONSORBLOCK if style == "sponsorblock" else C.LABELS
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, text in names.items():
        label = label.when(c == name, text)
    if style == "sponsorblock":
        return F.concat(F.lit("[SponsorBlock]: "), label.otherwise(F.initcap(c)))
    label = label.otherwise(c)
    name = F.trim(F.coalesce(_col(advertiser), F.lit(""))) if advertiser is not None else F.lit("")
    return F.when(name != "", F.concat(F.lit("["), label, F.lit("] "), name)).otherwise(F.concat(F.lit("["), label, F.lit("]")))


def cost(prompt_tokens: Column | str, completion_tokens: Column | str, price_in: Column | str, price_out: Column | str) -> Column:
    """Cost of a call from prices a million tokens; null if a price is unknown."""
    return (_col(prompt_tokens) * _col(price_in) + _col(completion_tokens) * _col(price_out)) / 1_000_000


def id3_size(header: Column | str) -> Column:
    """Bytes of an ID3v2 tag from the file's first ten bytes (syncsafe size plus header); 0 without one."""
    h = _col(header)
    byte = lambda k: F.conv(F.hex(F.substring(h, k, 1)), 16, 10).cast("long")
    size = ((byte(7) * 128 + byte(8)) * 128 + byte(9)) * 128 + byte(10) + 10
    return F.when(F.substring(h, 1, 3) == F.lit(b"ID3"), size).otherwise(F.lit(0).cast("long"))


def byte_to_seconds(byte: Column | str, id3: Column | str, bits_per_second: Column | str) -> Column:
    return (_col(byte) - _col(id3)) / (_col(bits_per_second) / 8)
