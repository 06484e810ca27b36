"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens that ignores some places; the hash of the tokens at the other places is
the same in two texts even if the ignored ones differ.  The seed hashes of the benchmark items and those of the documents
are two tables that are joined by hash.  A bit table of the items' hashes, of bounded size, goes ahead of the join: only
document seeds that it may hold are written, each with the few tokens around it that a window over it can reach.  Each
joined pair fixes a diagonal (document place minus item place), and the windows over the seed are compared token by token:
an overlap needs WINDOW tokens (or the whole item, if shorter) of which PERCENT equal.  The equal places of good windows
are put together by diagonal.  Items of fewer than MIN_ITEM tokens have no place that could be ignored: their seed is the
whole item, which must stand unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import settle
from spanloom.llm.textarrays import doc_words, mix64, utf8

# The masks; 1 is compared, 0 ignored.  Whatever the places of the unequal tokens, every window of 5 to 12
# tokens that reaches PERCENT holds one of them with equal tokens, so no overlap is missed.
MASKS = ("1111", "10111", "11011", "11101", "100111")
WINDOW = 12
PERCENT = 75
#: Items of fewer tokens must stand unchanged.
MIN_ITEM = 5
SHORT = tuple("1" * k for k in range(1, MIN_ITEM))
#: Tokens before a seed's first, and from it on, that a window over the seed can reach.
BEFORE, AFTER = WINDOW - len(min(MASKS, key=len)), WINDOW
NEAR = BEFORE + AFTER
#: Most bits of the table that goes ahead of the join, as a power of two: 32 MB.  A benchmark that fills it lets more document
#: seeds through to the join and changes no result.
MOST_BITS = 28
#: A hash that holds more than one in HOT_KEYS of the document seeds (and over HOT_ROWS of them) is split; so at most HOT_KEYS are.
HOT_KEYS, HOT_ROWS = 10_000, 1_000
#: Seeds that leave a Python worker at once.
SLICE = 1 << 14

_rng = np.random.default_rng(4242)
_PLACE = _rng.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the tokens under the mask, for each place at which it fits."""
    n = words.size - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64)))
    for k, bit in enumerate(mask):
        if bit == "1":
            h += words[k : k + n] * _PLACE[k]
    return mix64(h)


def _seeds(keys: list[str], masks: tuple[str, ...], present: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Seeds of texts: those that the bit table may hold, or those that each text, as an item, is found by."""
    bits = 0 if present is None else (present.size * 64).bit_length() - 1

    def holds(slot: np.ndarray) -> np.ndarray:
        return (present[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch["text"])
            for a, _, words, at in doc_words(raw, off):
                sizes = np.diff(at)
                padded = np.concatenate((np.zeros(BEFORE, np.uint64), words, np.zeros(AFTER, np.uint64)))
                for mask in masks:
                    h = seed_hashes(words, mask)
                    if present is None:
                        p = np.arange(h.size)
                    else:
                        p = np.flatnonzero(holds(h >> np.uint64(64 - bits)))
                        p = p[holds(h[p] >> np.uint64(64 - 2 * bits) & np.uint64((1 << bits) - 1))]
                    text = np.searchsorted(at, p, "right") - 1
                    good = p + len(mask) <= at[text + 1]
                    if present is None:
                        good &= ((sizes[text] >= MIN_ITEM) & (mask in MASKS)) | ((sizes[text] == len(mask)) & (mask in SHORT))
                    p, text = p[good], text[good]
                    for k in range(0, p.size, SLICE):
                        q, t = p[k : k + SLICE], text[k : k + SLICE]
                        rows = pa.array(a + t, pa.int64())
                        near = padded[q[:, None] + np.arange(NEAR)].view(np.int64).ravel()
                        own = [h[q].view(np.int64), np.full(q.size, len(mask)), q - at[t], sizes[t]]
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, NEAR), pa.int32()), pa.array(near))
                        yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in keys), *(pa.array(x, pa.int64()) for x in own), lists], [*keys, "h", "m", "place", "n", "near"])

    return run


def _verified(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The equal places in good windows around joined seeds, as bits of chunks of 32 places of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.arange(-BEFORE, AFTER)
        for batch in batches:
            place, n, item_place, item_n = (batch[c].to_numpy() for c in ("place", "n", "item_place", "item_n"))
            doc, item = (batch[c].flatten().to_numpy().reshape(-1, NEAR) for c in ("near", "item_near"))
            first = -np.minimum(place, item_place)
            last = np.minimum(n - place, item_n - item_place)
            inside = (around >= first[:, None]) & (around < last[:, None])
            same = (doc == item) & inside
            total = np.zeros((same.shape[0], NEAR + 1), np.int64)
            np.cumsum(same, axis=1, out=total[:, 1:])
            marks = np.zeros_like(same)
            size = np.minimum(item_n, WINDOW)
            for w in np.unique(size).tolist():
                rows = np.flatnonzero(size == w)
                for s in range(NEAR - w + 1):
                    good = (total[rows, s + w] - total[rows, s]) * 100 >= w * (PERCENT if w >= MIN_ITEM else 100)
                    marks[rows[good & inside[rows, s] & inside[rows, s + w - 1]], s : s + w] = True
            bits = (marks & same) @ (1 << np.arange(NEAR, dtype=np.int64)) << (place - BEFORE) % 32
            for chunk, part in (((place - BEFORE) // 32, bits & 0xFFFFFFFF), ((place - BEFORE) // 32 + 1, bits >> 32)):
                rows = np.flatnonzero(part)
                own = [(place - item_place)[rows], chunk[rows], part[rows]]
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in keys), *(pa.array(x, pa.int64()) for x in own)], [*keys, "shift", "chunk", "bits"])

    return run


def _schema(keys: list[str], *more: str) -> str:
    return ", ".join([*(f"{c} bigint" for c in keys), *more])


def bit_table(hashes: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits that each hash in the column h sets at two places, named by its highest bits and by those after them; some 100
    bits a hash, but never more than 2 ** most_bits in all, which bounds what comes to the driver and goes to each worker."""
    bits = max(6, min(most_bits, (hashes.count() * 64).bit_length()))
    places = F.array(F.expr(f"shiftrightunsigned(h, {64 - bits})"), F.expr(f"shiftrightunsigned(h, {64 - 2 * bits}) & {(1 << bits) - 1}L"))
    slots = hashes.select(F.explode(places).alias("slot"))
    words = slots.groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    present = np.zeros(1 << (bits - 6), np.uint64)
    present[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return present


def _overlaps(docs: DataFrame, keys: list[str], benchmark: DataFrame, most_bits: int, hot_rows: int) -> DataFrame:
    """keys, item_id, first_word, n_words, n_equal of the best diagonal of each text with each item; keys: longs that name a row
    of docs."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct().withColumn("item", F.xxhash64("text"))
    rest = ("h bigint", "m bigint", "place bigint", "n bigint", "near array<bigint>")
    seeds = settle(items.mapInArrow(_seeds(["item_id", "item"], tuple(dict.fromkeys(SHORT + MASKS))), _schema(["item_id", "item"], *rest)))
    short = sorted("1" * r.m for r in seeds.where(F.col("n") < MIN_ITEM).select("m").distinct().collect())
    found = settle(docs.mapInArrow(_seeds(keys, tuple(dict.fromkeys([*short, *MASKS])), bit_table(seeds, most_bits)), _schema(keys, *rest)).drop("m"))
    # Hot hashes: their document seeds are dealt over several keys, their item seeds repeated for each.
    size = max(found.count() // HOT_KEYS, hot_rows)
    hot = F.broadcast(settle(found.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts")).where("parts > 1")))
    found = found.join(hot, "h", "left").withColumn("part", F.pmod(F.xxhash64(*keys, "place"), F.coalesce("parts", F.lit(1)))).drop("parts")
    seeds = seeds.join(hot, "h", "left").select("h", "item_id", "item", F.col("place").alias("item_place"), F.col("n").alias("item_n"), F.col("near").alias("item_near"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    names = [*keys, "item_id", "item"]
    equal = found.join(seeds, ["h", "part"]).drop("h", "part").mapInArrow(_verified(names), _schema(names, "shift bigint", "chunk bigint", "bits bigint"))
    chunks = equal.groupBy(*names, "shift", "chunk").agg(F.bit_or("bits").alias("bits"))
    lines = chunks.groupBy(*names, "shift").agg(
        F.sum(F.bit_count("bits")).alias("n_equal"),
        F.min(F.expr("chunk * 32 + length(bin(bits & -bits)) - 1")).alias("first"),
        F.max(F.expr("chunk * 32 + length(bin(bits)) - 1")).alias("last"),
    )
    best = lines.groupBy(*names).agg(F.max(F.struct("n_equal", (-F.col("first")).alias("first"), (F.col("last") - F.col("first") + 1).alias("n_words"))).alias("b"))
    return best.select(*keys, "item_id", (-F.col("b.first")).alias("first_word"), "b.n_words", "b.n_equal")


def contaminated(docs: DataFrame, benchmark: DataFrame, most_bits: int = MOST_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, item_id, first_word (of the document, from 0), n_words, n_equal: one row for each overlap of a row of
    docs with an item, on its diagonal of most equal tokens (of several, the first in the document).

    Documents without an overlap give no row; null and empty texts have none.  Repeated rows of docs give repeated results,
    repeated items count once; items that share an id are searched each.  An empty benchmark or table gives an empty
    result.  Items without tokens or without id are not searched.  Texts of any length are searched whole; a null doc_id
    stays null; more columns are ignored.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _overlaps(docs, ["row", "doc_id"], benchmark, most_bits, hot_rows).drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_bits: int = MOST_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of docs without an overlap, with all their columns.  Null and empty texts have no overlap and stay.

    The rows that go are known by doc_id and two hashes of the text; they are settled, so Spark knows their size when it
    chooses between a broadcast (rows pass in place) and a shuffle.
    """
    own = {"doc_id": F.col("doc_id").cast("long"), "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}
    found = _overlaps(docs.select(*(c.alias(k) for k, c in own.items()), "text"), list(own), benchmark, most_bits, hot_rows)
    gone = settle(found.select(*(F.col(k).alias(f"gone_{k}") for k in own)).distinct())
    here = docs.select(F.struct(*docs.columns).alias("row"), *(c.alias(f"own_{k}") for k, c in own.items()))
    return here.join(gone, [here[f"own_{k}"].eqNullSafe(gone[f"gone_{k}"]) for k in own], "left_anti").select("row.*")
