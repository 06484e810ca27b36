"""MinHash near-duplicates by a multi-index Hamming join.

Signature: SYMBOLS min-hashes of a text's set of word shingles, b = 16 bits kept of each.  The distance of two
signatures is the number of symbols that differ.  The signature is cut into CHUNKS chunks of CHUNK symbols.  By the
pigeonhole principle a pair at distance <= 2 * CHUNKS - 1 has a chunk with at most one wrong symbol, so each text
enters, for every chunk, the CHUNK index keys that leave out one symbol: two texts share a key if and only if some
chunk differs in one symbol at most, which guarantees all pairs under that distance.  A pair whose sets have Jaccard
similarity s shares a key with probability 1 - (1 - s**5 - 5 s**4 (1 - s)) ** 12: all but 6 in a million at s = 0.75.
Candidates are then confirmed on the full sets.

Large groups: texts with equal sets are one node.  In a bucket each node is paired with the bucket's first and with
the one before it only, and what that links is one component; a second round pairs the nodes of different components
that still share a bucket.  Large buckets of several components are resolved in tiles of bounded size: the nodes outside
a crowd's main component meet all of its nodes, overlaps are counted exactly through an inverted index of the tile, and
only confirmed links leave it.

Texts are never shuffled: a pass over the documents makes the sets of the nodes that take part, which a bit table of
bounded size lets through and a join on the node confirms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import settle
from spanloom.llm.components import components
from spanloom.llm.textarrays import doc_words, mix64, shingles, utf8

WIDTH = 5
PERCENT = 75
CHUNKS = 12
CHUNK = 5
SYMBOLS = CHUNKS * CHUNK
#: Pairs of signatures further apart than this are not worth a comparison of sets: at similarity 0.75 the distance is
#: binomial with mean 15 and deviation 3.4, so this is five deviations out.
FAR = 33
#: Nodes of one bucket that the second round pairs directly.
DIRECT = 48
#: Nodes on either side of a tile.
TILE = 3000
#: The bit table of nodes that take part has sixteen bits a node and at most 2 ** MOST_BITS; beyond that it lets more
#: nodes through and the join on the node does the rest.
MOST_BITS = 28

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)


def signature(sets: np.ndarray) -> np.ndarray:
    """The SYMBOLS 16-bit symbols of a non-empty set of 64-bit shingle hashes."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for a in range(0, x.size, 4096):
        least = np.minimum(least, (_A[:, None] * x[None, a : a + 4096] + _B[:, None]).min(axis=1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def keys(symbols: np.ndarray) -> np.ndarray:
    """Index keys, (rows, CHUNKS * CHUNK) int64, of a (rows, SYMBOLS) array: each chunk with each symbol left out."""
    out = np.empty((symbols.shape[0], SYMBOLS), np.int64)
    wide = symbols.astype(np.uint64)
    for c in range(CHUNKS):
        for left_out in range(CHUNK):
            key = np.zeros(symbols.shape[0], np.uint64)
            for k in range(CHUNK):
                if k != left_out:
                    key = (key << np.uint64(16)) | wide[:, c * CHUNK + k]
            out[:, c * CHUNK + left_out] = mix64(key + np.uint64((c * CHUNK + left_out + 1) * 0xD1B54A32D192ED03 % (1 << 64))).view(np.int64)
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8(batch["text"])
        size, h1, h2, sigs = [], [], [], []
        for a, b, words, at in doc_words(raw, off):
            for i in range(a, b):
                s = shingles(words[at[i - a] : at[i - a + 1]], WIDTH)
                size.append(s.size)
                h1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mix64(s).sum(dtype=np.uint64).astype(np.int64)))
                sigs.append(signature(s).tobytes() if s.size else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].cast(pa.int64()), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())],
            ["doc_id", "n_shingles", "h1", "h2", "sig"],
        )


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            symbols = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint16).reshape(batch.num_rows, SYMBOLS)
            flat = pa.array(keys(symbols).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n_shingles"], pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SYMBOLS), flat)], ["node", "n_shingles", "keys"])


def _sets(bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch["spot"].to_numpy()
            batch = batch.filter(pa.array((bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1))
            raw, off = utf8(batch["text"])
            found = [shingles(words[at[i - a] : at[i - a + 1]], WIDTH) for a, b, words, at in doc_words(raw, off) for i in range(a, b)]
            at = np.zeros(len(found) + 1, np.int32)
            np.cumsum([s.size for s in found], out=at[1:])
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["node", "items"])

    return run


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, items) of the documents whose doc_id is in ``nodes`` (node, distinct): one pass over docs, settled."""
    nodes = settle(nodes)
    size = min(MOST_BITS, max(16, (16 * nodes.count()).bit_length()))
    spot = F.pmod(F.xxhash64("node"), F.lit(1 << size))
    table = nodes.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("v")).toArrow()
    bits = np.zeros(1 << size - 6, np.uint64)
    bits[table["w"].to_numpy()] = table["v"].to_numpy().view(np.uint64)
    passed = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << size)).alias("spot"))
    return settle(passed.mapInArrow(_sets(bits), "node bigint, items array<bigint>").join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"]))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch[k].to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in ("sig_a", "sig_b"))
            near = pa.array((x != y).sum(axis=1) <= FAR)
            yield batch.select(["a", "b"]).filter(near)


def _alike(a: str, b: str) -> F.Column:
    """Whether two set sizes allow the similarity."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets have the similarity.  nodes: node, n_shingles, sig."""
    sig = nodes.select("node", "sig")
    pairs = settle(
        pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
        .select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a bigint, b bigint")
    )
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs)
    both = (
        pairs.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
        .join(sets.hint("merge").select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
        .select("a", "b", F.size(F.array_intersect("items_a", "items_b")).alias("n"), (F.size("items_a") + F.size("items_b")).alias("m"))
    )
    return both.where(F.col("n") * 100 >= (F.col("m") - F.col("n")) * PERCENT).select("a", "b")


def _tile(rows: pa.Table) -> pa.Table:
    """Links (a, b) of a tile's asking nodes with its other ones: for each component of the others the first link."""
    asks = rows.column("asks").to_numpy()
    node, comp = rows.column("node").to_numpy(), rows.column("comp").to_numpy()
    items = rows.column("items").combine_chunks()
    at, flat = items.offsets.to_numpy(), items.values.to_numpy()
    size = np.diff(at)
    there = np.flatnonzero(~asks)
    owner = np.repeat(np.arange(there.size), size[there])
    held = np.concatenate([flat[at[k] : at[k + 1]] for k in there]) if there.size else flat[:0]
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    a, b = [], []
    for k in np.flatnonzero(asks):
        mine = flat[at[k] : at[k + 1]]
        lo, hi = np.searchsorted(held, mine), np.searchsorted(held, mine, "right")
        n = hi - lo
        spots = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = np.bincount(owner[spots], minlength=there.size)
        linked = there[(same * 100 >= (size[k] + size[there] - same) * PERCENT) & (comp[there] != comp[k])]
        for j in linked[np.unique(comp[linked], return_index=True)[1]]:
            a.append(node[k])
            b.append(node[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _crowd_links(crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """All links between different components among nodes that share large mixed buckets.  crowd: node, first, comp."""
    groups = components(crowd.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "crowd")
    placed = crowd.select("node", "comp").distinct().join(groups, "node")
    main = placed.groupBy("crowd", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("crowd").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n_all"), (F.sum("n") - F.max("n")).alias("n_ask"))
    placed = settle(placed.join(main, "crowd"))
    placed = placed.join(sets_of(placed.select("node"), docs).hint("merge"), "node").withColumns({"ts": F.ceil(F.col("n_ask") / TILE), "tm": F.ceil(F.col("n_all") / TILE)})
    spot = F.xxhash64("node")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asking = placed.where("comp <> main").select("crowd", F.pmod(spot, F.col("ts")).alias("s"), F.explode(every("tm")).alias("m"), F.lit(True).alias("asks"), "node", "comp", "items")
    others = placed.where("n_ask > 0").select("crowd", F.explode(every("ts")).alias("s"), F.pmod(spot, F.col("tm")).alias("m"), F.lit(False).alias("asks"), "node", "comp", "items")
    return asking.unionByName(others).groupBy("crowd", "s", "m").applyInArrow(_tile, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text; more columns are ignored).

    Null or empty texts have no shingles and link with nothing.  Rows that share a doc_id are one document of that id.
    A row without doc_id has no component (null) and is kept.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = settle(docs.mapInArrow(_described, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary"))
    full = rows.where("doc_id is not null and n_shingles > 0")
    classes = settle(full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("node")))
    member = full.join(classes, ["n_shingles", "h1", "h2"]).select("doc_id", "node").distinct()
    nodes = settle(full.join(classes.select("n_shingles", "h1", "h2", F.col("node").alias("doc_id")), ["n_shingles", "h1", "h2", "doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "sig").dropDuplicates(["node", "n_shingles"]))
    entries = nodes.mapInArrow(_indexed, "node bigint, n_shingles bigint, keys array<bigint>").select(F.explode("keys").alias("key"), "node", "n_shingles")
    bucket = Window.partitionBy("key").orderBy("node")
    buckets = settle(
        entries.withColumns({"first": F.first("node").over(bucket), "before": F.lag("node").over(bucket), "size_first": F.first("n_shingles").over(bucket), "size_before": F.lag("n_shingles").over(bucket), "after": F.lead("node").over(bucket)})
        .where("before is not null or after is not null").drop("after")
    )
    pairs = (
        buckets.select(F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("size_first").alias("na")), F.struct(F.col("before").alias("a"), F.col("size_before").alias("na")))).alias("p"), F.col("node").alias("b"), F.col("n_shingles").alias("nb"))
        .select("p.a", "b", "p.na", "nb").where(F.col("a").isNotNull() & (F.col("a") != F.col("b")) & _alike("na", "nb")).select("a", "b").distinct()
    )
    pairs = settle(pairs)
    links = settle(confirm(pairs, nodes, docs))
    comp = settle(components(links))

    # Second round: what shares a bucket and isn't in one component yet.
    placed = buckets.select("key", "node", "n_shingles", "first").join(comp, "node", "left").select("key", "node", "n_shingles", "first", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2 and g > 2").select("key", "g")
    left = settle(placed.join(mixed, "key"))
    small = left.where(F.col("g") <= DIRECT).groupBy("key").agg(F.collect_list(F.struct("node", "n_shingles", "comp")).alias("xs")).select(F.explode("xs").alias("x"), "xs")
    direct = small.select(F.col("x.node").alias("a"), F.explode(F.expr(f"filter(xs, y -> y.node > x.node and y.comp <> x.comp and least(x.n_shingles, y.n_shingles) * 100 >= greatest(x.n_shingles, y.n_shingles) * {PERCENT}).node")).alias("b")).distinct()
    links = links.unionByName(confirm(direct.join(pairs, ["a", "b"], "left_anti"), nodes, docs))
    crowd = settle(left.where(F.col("g") > DIRECT).select("node", "first", "comp").distinct())
    if not crowd.isEmpty():
        links = links.unionByName(_crowd_links(crowd, docs))
    # Rows of one doc_id with unlike sets belong together too.
    links = links.unionByName(member.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    comp = settle(components(links))
    return (
        rows.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (pa.RecordBatch.from_arrays([batch["row"], *(found[c] for c in ("doc_id", "n_shingles", "h1", "h2"))], ["row", "doc_id", "n_shingles", "h1", "h2"]) for found in _described(iter([batch])))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: those of one document of each component.

    Rows that share a doc_id are one document: of its rows with equal shingle sets the least (by text, then by the other
    columns) stays, rows with other sets stay too.  Rows without doc_id stay.  The other columns must be orderable.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    with_id = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = settle(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    several = with_id.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct("text", *[c for c in docs.columns if c != "text"]).alias("row"))
    kind = several.schema["row"].dataType.simpleString()
    several = several.mapInArrow(_with_set, f"row {kind}, doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint").groupBy("doc_id", "n_shingles", "h1", "h2").agg(F.min("row").alias("row")).select("row.*")
    single = with_id.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return single.unionByName(several.select(docs.columns)).unionByName(docs.where("doc_id is null"))
