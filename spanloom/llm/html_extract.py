"""Main text of web pages: a small structural pass, and a suffix array over the pages of a host.

A page is cut into blocks at its block-level tags.  What its elements name as no text (scripts, styles, forms, menus,
headers, footers, asides) falls away, and what its classes, ids and roles name as comments, notices, adverts and the like.
The token streams of a host's pages are then put end to end and a suffix array, sorted to RUN tokens by prefix doubling,
brings equal substrings together.  Runs that stand on many distinct pages are boilerplate and are cut, also out of the
middle of a block; the runs of tokens that are the page's own stay.  Inside an article a run must stand on most pages of
the host, and what is cut must be a small part of it.  A page that is covered as a whole is a copy of another, not
boilerplate, and keeps its text.

A host is cut into shards of about SHARD_CHARS, by a hash of the page, so that one host may be any size.  A run's pages
are those of the whole host, so the texts are the same for one shard or twenty: what stands on a share of the host's pages
stands on that share of the pages of a shard at least, so each shard names the runs that do, all shards count those, and
the sums decide.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.textarrays import _SHINGLE, doc_words, mix64, utf8

# Elements and words of class, id and role by what they mean.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
DROPPED = frozenset("aside audio button canvas dialog embed fieldset footer form frame frameset head iframe input legend menu nav noframes noscript object optgroup option script select style svg template textarea title video".split())
MAIN = frozenset(("article", "main"))
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that drop an element whatever it holds, and those that drop it unless an article stands in it.
ASIDES = frozenset("ad ads advert advertisement advertising adverts comment comments consent cookie cookies disqus gdpr newsletter notice notification popup promo promoted promotion related reply respond signup sponsor sponsored subscribe".split())
LAYOUT = frozenset("banner breadcrumb breadcrumbs footer header login masthead menu modal nav navbar navigation pager pagination share sharing sidebar skip social toolbar widget".split())
#: Words that may stand beside them in a class or id without changing what it says.
BESIDE = frozenset("area bar block bottom box container content fixed form global group item left level link links list main page primary right row secondary section site sticky text top wrap wrapper".split())

RUN = 8
SHARD_CHARS = 6_000_000
#: Pages, at least, and share of a shard's pages that a run must stand on: outside and inside an article.
PAGES, SHARE = 3, 0.05
PAGES_INSIDE, SHARE_INSIDE = 10, 0.5
#: Most of an article, and of a page without one, that runs on many pages may be.
PART_INSIDE, PART_OUTSIDE = 0.3, 0.9
#: Hosts of several shards that are broadcast; more are joined.
BROADCAST_HOSTS = 200_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/a-zA-Z!?][^>]*(?:>|\Z)", re.S)
_OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SPACES = re.compile(r"\s+")
_WORDS = re.compile(r"[\x20\x09-\x0D]+")

#: Of a place in a page: dropped, dropped unless an article begins there, of no known role, in an article.
GONE, LAID_OUT, UNKNOWN, INSIDE = -2, -1, 0, 1


def _says(value: str) -> int:
    """What a class or id says: GONE, LAID_OUT or UNKNOWN.  Each of its names counts as a whole: its parts must all be
    words that say so or words that may stand beside them."""
    said = UNKNOWN
    for name in value.split():
        parts = [p for p in _SPLIT.split(name) if p]
        if parts and all(p in ASIDES or p in LAYOUT or p in BESIDE for p in parts):
            said = min(said, GONE if any(p in ASIDES for p in parts) else LAID_OUT if any(p in LAYOUT for p in parts) else UNKNOWN)
    return said


def _role(name: str, attributes: str, inside: bool) -> int:
    """What an element does to its content."""
    if name in DROPPED:
        return GONE
    role = INSIDE if name in MAIN else LAID_OUT if name == "header" and not inside else UNKNOWN
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return GONE
            if key == "role":
                if value in DROPPED_ROLES:
                    return GONE
                role = INSIDE if value in MAIN else role
            elif key in ("class", "id") and name not in ("html", "body"):
                said = _says(value)
                if said == GONE or (said == LAID_OUT and name not in MAIN and not (inside and "header" in value)):
                    role = min(role, said)
    return role


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(UNKNOWN or INSIDE, text) of the blocks of a page that aren't dropped by structure, in page order.

    Unclosed and stray tags are taken as browsers do: a closing tag ends everything opened since its opening tag, one
    that was never opened is ignored.  Null and empty pages have no blocks.
    """
    page = page or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    kind = UNKNOWN
    at, size = 0, len(page)

    def close() -> None:
        if parts:
            text = _SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((kind, text))
            parts.clear()

    while at < size:
        m = _TAG.search(page, at)
        if kind >= UNKNOWN and (end := m.start() if m else size) > at:
            parts.append(page[at:end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if page[m.start() + 1] in "!?" or not (loose := _OPEN.match(m[0])):
                continue
            name, closing, attributes = loose[1].lower(), m[0][1] == "/", loose[2]
        else:
            name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in INLINE and not (attributes and not closing and name != "img"):
            if not closing and name not in VOID:
                stack.append((name, kind))
            elif closing and any(s[0] == name for s in stack[-8:]):
                while stack.pop()[0] != name:
                    pass
                kind = stack[-1][1] if stack else UNKNOWN
            continue
        if closing:
            if any(s[0] == name for s in stack):
                if name not in INLINE:
                    close()
                while stack.pop()[0] != name:
                    pass
                new = stack[-1][1] if stack else UNKNOWN
                if new != kind:
                    close()
                kind = new
            elif name not in INLINE:
                close()
            continue
        if name not in INLINE:
            close()
        if name in VOID:
            continue
        new = kind
        if kind != GONE:
            role = _role(name, attributes or "", kind == INSIDE)
            new = min(kind, role) if role < UNKNOWN else max(kind, role)
        if new != kind:
            close()
        kind = new
        stack.append((name, kind))
        if name in RAW:
            stop = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = stop.start() if stop else size
    close()
    return out


def runs(words: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, rank of the run at each, pages by rank) of the runs of RUN tokens that stand within a page.

    words: token hashes of all pages end to end; page: the page of each token, ascending from 0.
    """
    none = np.zeros(0, np.int64)
    if words.size < RUN:
        return none, none, none
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    # Prefix doubling: the rank of the first 2, 4, 8 tokens of each suffix from the ranks of its halves.
    length = 1
    while length < RUN:
        rest = rank[length:]
        rank = np.unique(rank[: rest.size] * (int(rank.max()) + 1) + rest, return_inverse=True)[1].astype(np.int64)
        length *= 2
    rank = rank[: words.size - RUN + 1]
    places = _places(page)
    if not places.size:
        return none, none, none
    n_pages = int(page[-1]) + 1
    rank = rank[places]
    return places, rank, np.bincount(np.unique(rank * n_pages + page[places]) // n_pages, minlength=int(rank.max()) + 1)


def _places(page: np.ndarray) -> np.ndarray:
    """Where runs begin that stand within a page."""
    return np.flatnonzero(page[: max(0, page.size - RUN + 1)] == page[RUN - 1 :])


def _run_hashes(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs at ``places``, by which shards tell each other of them."""
    h = np.zeros(places.size, np.uint64)
    for k in range(RUN):
        h += words[places + k] * _SHINGLE[k]
    return mix64(h)


def _covered(begins: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens stand in runs at ``begins``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + RUN, -1)
    return np.cumsum(edge)[:n] > 0


def coverage(words: np.ndarray, page: np.ndarray, pages: int, share: float) -> np.ndarray:
    """Which tokens stand in a run that occurs on at least ``pages`` pages and ``share`` of them all; see runs()."""
    places, rank, spread = runs(words, page)
    return _covered(places[spread[rank] >= max(pages, share * (int(page[-1]) + 1))] if places.size else places, words.size)


def _kept(text: str, covered: np.ndarray) -> str:
    """The words of a block that aren't covered."""
    return " ".join(w for w, gone in zip(_WORDS.split(text), covered, strict=True) if not gone)


@dataclass(frozen=True)
class Tokens:
    """Of pages: whether each has an article, its blocks that count, and their tokens end to end: hashes, offsets by block
    and the page of each, from 0 on over the pages that have tokens."""

    inside: list[bool]
    blocks: list[list[tuple[int, str]]]
    words: np.ndarray
    at: np.ndarray
    page: np.ndarray

    @classmethod
    def of(cls, pages: list[list[tuple[int, str]]]) -> Tokens:
        inside = [any(k == INSIDE for k, _ in p) for p in pages]
        blocks = [[b for b in p if not has or b[0] == INSIDE] for p, has in zip(pages, inside, strict=True)]
        raw, off = utf8(pa.array([t for p in blocks for _, t in p], pa.large_string()))
        found = [(w, at) for _, _, w, at in doc_words(raw, off)]
        words = np.concatenate([np.zeros(0, np.uint64), *(f[0] for f in found)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(f[1]) for f in found)])
        at = np.zeros(sizes.size + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        page = np.repeat(np.repeat(np.arange(len(pages)), [len(p) for p in blocks]), sizes)
        return cls(inside, blocks, words, at, np.unique(page, return_inverse=True)[1])

    @property
    def pages(self) -> int:
        return int(self.page[-1]) + 1 if self.page.size else 0


@dataclass(frozen=True)
class Known:
    """Runs of a host, the pages of each and the pages of the host that have tokens."""

    runs: np.ndarray
    spread: np.ndarray
    pages: int


def main_texts(pages: list[list[tuple[int, str]]], known: Known | None = None) -> list[str]:
    """The main text of each page, from the blocks of all of them.  known: where they are only a shard of their host."""
    t = Tokens.of(pages)
    if known is None:
        places, rank, spread = runs(t.words, t.page)
        spread, n_pages = spread[rank], t.pages
    else:
        places, n_pages = _places(t.page), known.pages
        order = np.argsort(known.runs)
        here = _run_hashes(t.words, places)
        spot = np.minimum(np.searchsorted(known.runs[order], here), max(order.size - 1, 0))
        spread = np.where(known.runs[order][spot] == here, known.spread[order][spot], 0) if order.size else np.zeros(places.size, np.int64)
    outside, within = (_covered(places[spread >= max(least, share * n_pages)], t.words.size) for least, share in ((PAGES, SHARE), (PAGES_INSIDE, SHARE_INSIDE)))
    out, k, at = [], 0, t.at
    for p, has in zip(t.blocks, t.inside, strict=True):
        covered = (within if has else outside)[at[k] : at[k + len(p)]]
        lost = np.count_nonzero(covered)
        if lost and lost <= covered.size * (PART_INSIDE if has else PART_OUTSIDE):
            texts = [_kept(x, covered[at[k + j] - at[k] : at[k + j + 1] - at[k]]) for j, (_, x) in enumerate(p)]
        else:
            texts = [x for _, x in p]
        k += len(p)
        out.append(" ".join(x for x in texts if x))
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 200):
            part = batch.slice(a, 200)
            found = [blocks(h) for h in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], part["host"], part["shard"], part["shards"], pa.array([[k for k, _ in p] for p in found], pa.list_(pa.int32())), pa.array([[t for _, t in p] for p in found], pa.list_(pa.string()))],
                ["page_id", "url", "host", "shard", "shards", "kinds", "texts"],
            )


def _blocks_of(shard: pa.Table) -> list[list[tuple[int, str]]]:
    return [list(zip(k, t, strict=True)) for k, t in zip(shard["kinds"].to_pylist(), shard["texts"].to_pylist(), strict=True)]


def _runs_of(shard: pa.Table, found: np.ndarray, pages: np.ndarray) -> pa.Table:
    """Rows (host, shards, run, pages) of one shard."""
    n = found.size
    return pa.table({"host": pa.array([shard["host"][0].as_py()] * n, pa.string()), "shards": pa.array([shard["shards"][0].as_py()] * n, pa.int32()), "run": pa.array(found.view(np.int64)), "pages": pa.array(pages.astype(np.int64))})


def _named(shard: pa.Table) -> pa.Table:
    """The runs that a shard of a host of several names: those on SHARE of its pages."""
    none = np.zeros(0, np.uint64)
    if shard["shards"][0].as_py() == 1:
        return _runs_of(shard, none, none)
    t = Tokens.of(_blocks_of(shard))
    places, rank, spread = runs(t.words, t.page)
    number, first = np.unique(rank, return_index=True)
    number, first = (x[spread[number] >= SHARE * t.pages * (1 - 1e-9)] for x in (number, first)) if places.size else (number, first)
    return _runs_of(shard, _run_hashes(t.words, places[first]), spread[number])


def _counted(shard: pa.Table, named: pa.Table) -> pa.Table:
    """The pages of a shard on which runs stand that any shard of its host has named, and at a null run all its pages."""
    if not shard.num_rows or not named.num_rows:
        return pa.table({"host": pa.array([], pa.string()), "shards": pa.array([], pa.int32()), "run": pa.array([], pa.int64()), "pages": pa.array([], pa.int64())})
    t = Tokens.of(_blocks_of(shard))
    known = np.sort(_flat(named["runs"]).view(np.uint64))
    places = _places(t.page)
    here = _run_hashes(t.words, places)
    spot = np.minimum(np.searchsorted(known, here), known.size - 1)
    hit = known[spot] == here
    n_pages = max(t.pages, 1)
    found, pages = np.unique(np.unique(spot[hit] * n_pages + t.page[places[hit]]) // n_pages, return_counts=True)
    whole = _runs_of(shard, np.zeros(1, np.uint64), np.array([t.pages])).set_column(2, "run", pa.nulls(1, pa.int64()))
    return pa.concat_tables([_runs_of(shard, known[found], pages), whole])


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _extracted(shard: pa.Table, found: pa.Table) -> pa.Table:
    if not shard.num_rows:
        return pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    known = None
    if shard["shards"][0].as_py() > 1:
        known = Known(_flat(found["runs"]).view(np.uint64), _flat(found["spread"]), found["total"][0].as_py()) if found.num_rows else Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    return pa.table({"page_id": shard["page_id"], "url": shard["url"].cast(pa.string()), "text": pa.array(main_texts(_blocks_of(shard), known), pa.string())})


def extract(pages: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    A null or empty html has the empty text; a null url is a host of its own; a null page_id is allowed.  Repeated rows
    give repeated results, an empty table an empty one.  Pages of any length are read whole; more columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    large = pages.groupBy("host").agg(F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("n")).where(F.col("n") > shard_chars).select("host", F.ceil(F.col("n") / shard_chars).alias("shards"))
    few = large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    placed = pages.join(F.broadcast(large) if few else large, "host", "left")
    shards = F.coalesce(F.col("shards").cast("int"), F.lit(1))
    placed = placed.select("page_id", "url", "host", "html", F.pmod(F.xxhash64("page_id", "url", F.length("html")), shards).cast("int").alias("shard"), shards.alias("shards"))
    # The three that follow read one shuffle of the parsed pages.
    parsed = placed.mapInArrow(_parsed, "page_id bigint, url string, host string, shard int, shards int, kinds array<int>, texts array<string>").groupBy("host", "shard")
    each = [F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")]
    rows = "host string, shards int, run bigint, pages bigint"
    named = parsed.applyInArrow(_named, rows).groupBy("host", "shards").agg(F.collect_set("run").alias("runs")).select("host", *each, "runs")
    counted = parsed.cogroup(named.groupBy("host", "shard")).applyInArrow(_counted, rows).groupBy("host", "shards", "run").agg(F.sum("pages").alias("pages"))
    known = counted.groupBy("host", "shards").agg(F.collect_list(F.when(F.col("run").isNotNull(), F.struct("run", "pages"))).alias("found"), F.max(F.when(F.col("run").isNull(), F.col("pages"))).alias("total"))
    known = known.select("host", *each, F.filter("found", lambda x: x["pages"] >= F.greatest(F.lit(float(PAGES)), F.lit(SHARE) * F.col("total"))).alias("found"), "total")
    known = known.select("host", "shard", F.col("found.run").alias("runs"), F.col("found.pages").alias("spread"), "total")
    found = parsed.cogroup(known.groupBy("host", "shard")).applyInArrow(_extracted, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
