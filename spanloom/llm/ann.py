"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is built, cut into balanced partitions (a capacity-bound assignment, refined
by moving vertices to where most of their neighbours are), and a softmax classifier learns to tell a vector's partition.
Every vector is indexed under its most probable partition.  A query is routed to the several most probable ones, as
many as the sample needs for RECALL, and what they hold is reranked by exact inner products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import settle

#: Vectors that the partitions and the classifier are fitted on, at most.
FIT_ROWS = 12_000
#: Partitions are the root of the number of vectors by ROOT, two at least from FEW vectors on: a query then meets as many
#: partitions as each holds vectors, up to a factor.  A partition is learned from SEEN vectors of the fit at least, so a
#: table has FIT_ROWS / SEEN of them at most; larger partitions are searched in blocks.
ROOT, FEW, SEEN = 14, 300, 20
NEIGHBOURS = 10
#: Share of the sample's true neighbours that routing must reach on the sample; the rest up to 1 is room for new rows.
RECALL = 0.94
#: Vectors of one block of a partition, and queries that one task asks of it.
BLOCK, ASKED = 4096, 4096
TOP = 20


@dataclass(frozen=True)
class Router:
    """Weights of the classifier (dimensions + 1, partitions) and the number of partitions that a query visits."""

    weights: np.ndarray
    probes: int

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        """Partitions of each vector, most probable first."""
        return np.argsort(-_logits(vectors, self.weights), axis=1, kind="stable")


def _logits(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _unit(vectors) @ weights[:-1] + weights[-1]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """All vectors divided by the largest component, so that single floats hold them; products keep their order."""
    return (vectors / max(np.abs(vectors).max(initial=0.0), 1e-300)).astype(np.float32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Each vector by its length; the largest component goes first, so that no square overflows."""
    small = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True, initial=0.0), 1e-300)
    return (small / np.maximum(np.linalg.norm(small, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k vectors of largest inner product with each vector, in blocks; (n, k)."""
    out = np.empty((len(vectors), k), np.int64)
    for a in range(0, len(vectors), 512):
        near = vectors[a : a + 512] @ vectors.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _balanced(score: np.ndarray, capacity: int) -> np.ndarray:
    """Each row to its best column with room, the surest rows first."""
    order = np.argsort(-(np.max(score, axis=1) - np.mean(score, axis=1)), kind="stable")
    choice = np.argsort(-score, axis=1, kind="stable")
    room = np.full(score.shape[1], capacity)
    out = np.empty(len(score), np.int64)
    for k in order:
        for c in choice[k]:
            if room[c]:
                room[c] -= 1
                out[k] = c
                break
    return out


def balanced_partition(vectors: np.ndarray, graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A partition of the graph's vertices into parts of at most 1.1 times the mean size."""
    n = len(vectors)
    capacity = -(-n * 11 // (10 * parts))
    unit = _unit(vectors)
    centres = unit[np.random.default_rng(seed).choice(n, parts, replace=False)]
    for _ in range(8):
        part = _balanced(unit @ centres.T, capacity)
        centres = np.stack([unit[part == p].mean(axis=0) if (part == p).any() else centres[p] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    for _ in range(6):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1.0)
        part = _balanced(votes + 0.5 * (unit @ centres.T), capacity)
    return part


def fit(vectors: np.ndarray, parts: int, queries: int = 400) -> Router:
    """The router of a sample.  Fewer than two partitions need none: every query visits all."""
    if parts < 2 or len(vectors) <= NEIGHBOURS + 1:
        return Router(np.zeros((vectors.shape[1] + 1 if vectors.ndim == 2 else 1, 1), np.float32), 1)
    graph = neighbour_graph(vectors, NEIGHBOURS)
    part = balanced_partition(vectors, graph, parts)
    unit = _unit(vectors)
    x = np.concatenate((unit, np.ones((len(unit), 1), np.float32)), axis=1)
    w = np.zeros((x.shape[1], parts), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    target = np.eye(parts, dtype=np.float32)[part]
    for step in range(1, 151):
        z = x @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        gradient = x.T @ (z / z.sum(axis=1, keepdims=True) - target) / len(x)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    router = Router(w.astype(np.float32), parts)
    ranked = router.ranked(vectors)
    asked = np.random.default_rng(11).choice(len(vectors), min(queries, len(vectors)), replace=False)
    near = vectors[asked] @ vectors.T
    near[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(TOP, len(vectors) - 1)]
    place = np.argsort(ranked[asked], axis=1)
    need = np.take_along_axis(place, ranked[top, 0], axis=1)
    reached = np.array([(need < k).mean() for k in range(1, parts + 1)])
    return Router(router.weights, int(np.argmax(reached >= RECALL)) + 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _routed(router: Router, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ranked = router.ranked(_matrix(batch["embedding"]))[:, :width].astype(np.int32)
                at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * ranked.shape[1])
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.ListArray.from_arrays(at, pa.array(ranked.ravel()))], ["vec_id", "embedding", "parts"])

    return run


def _searched(there: pa.Table, asked: pa.Table) -> pa.Table:
    """The TOP nearest of a block for each query; products are summed in one order, so equal vectors have equal scores."""
    out: tuple[list, list, list] = ([], [], [])
    if there.num_rows and asked.num_rows:
        ids = there["vec_id"].to_numpy()
        columns = np.ascontiguousarray(_matrix(there["embedding"].combine_chunks()).astype(np.float64).T)
        for q, vector in zip(asked["vec_id"].to_numpy(), _matrix(asked["embedding"].combine_chunks()).astype(np.float64), strict=True):
            score = np.zeros(ids.size)
            for k, x in enumerate(vector):
                score += columns[k] * x
            score[(ids == q) | np.isnan(score)] = -np.inf
            least = np.partition(score, -TOP)[-TOP] if score.size > TOP else -np.inf
            spots = np.flatnonzero((score >= least) & (score > -np.inf))
            spots = spots[np.lexsort((ids[spots], -score[spots]))[:TOP]]
            out[0].append(np.full(spots.size, q))
            out[1].append(ids[spots])
            out[2].append(score[spots])
    kinds = (np.int64, np.int64, np.float64)
    return pa.table({name: pa.array(np.concatenate(x) if x else np.zeros(0, t)) for name, x, t in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})


def nearest(embeddings: DataFrame, every: int = 20, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the TOP nearest of each row whose vec_id is divisible by ``every``, among all rows
    but its own, by largest inner product; ties to the smaller vec_id.

    Rows without vec_id and vectors that are null, empty, zero, of another length than most, or hold null or non-finite
    components take no part.  Rows that repeat a vec_id count once (the smallest vector).  Products are of double
    precision whatever the vectors' type; one that overflows is infinite, one that is not a number is left out.  More
    columns are ignored.  An empty table gives an empty result.
    """
    usable = embeddings.where("vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    usable = usable.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    size = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "vec_id bigint, embedding array<double>, parts array<int>"
    if size is None:
        return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    usable = settle(usable.where(F.size("embedding") == size.d))
    n = size["count"]
    # Equal vectors teach nothing twice.
    sample = usable if n <= fit_rows else usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    vectors = _scaled(np.unique(_matrix(sample.select("embedding").distinct().toArrow()["embedding"].combine_chunks()), axis=0))
    parts = min(max(2 if n >= FEW else 1, round(n**0.5 / ROOT)), max(1, len(vectors) // SEEN))
    router = fit(vectors, parts)
    held = usable.mapInArrow(_routed(router, 1), schema).select("vec_id", "embedding", F.col("parts")[0].alias("part"))
    asked = usable.where(F.col("vec_id") % every == 0).mapInArrow(_routed(router, router.probes), schema).select("vec_id", "embedding", F.explode("parts").alias("part"))
    # Tiles of a block of a partition's vectors and a share of the queries that visit it; one row a partition, so broadcast.
    blocks = held.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    shares = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("shares"))
    tiles = F.broadcast(settle(blocks.join(shares, "part")))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = held.join(tiles, "part").select("vec_id", "embedding", "part", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), every_one("shares").alias("share"))
    asked = asked.join(tiles, "part").select("vec_id", "embedding", "part", F.pmod(F.xxhash64("vec_id"), F.col("shares")).alias("share"), every_one("blocks").alias("block"))
    found = held.groupBy("part", "block", "share").cogroup(asked.groupBy("part", "block", "share")).applyInArrow(_searched, "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")
