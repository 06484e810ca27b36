"""Token counts of a piece vocabulary with byte fallback, by rank-synchronous merging of ragged arrays.

Text is split before every run of spaces: no piece of such a vocabulary holds a space after another character, so no
merge crosses these places.  The distinct pre-tokens of a batch lie end to end in one array of symbols.  In each round
every pre-token merges its own pair of lowest rank (the leftmost, if several), all of them at once; finished ones
leave the arrays.  What is left counts: one token for a known symbol, one for each UTF-8 byte of an unknown character.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
#: Pre-tokens whose counts a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 400_000
#: Longer pre-tokens are merged by a heap, one at a time: the arrays take a round for each merge.
LONG = 2_000
_NONE = np.iinfo(np.int64).max


class Merges:
    """Symbols, pairs and ranks of a vocabulary file: a path, or a name that ``public_tokenizers`` knows."""

    def __init__(self, model: str = MODEL) -> None:
        import os

        import sentencepiece

        if not os.path.exists(model):
            import public_tokenizers

            model = public_tokenizers.path(model)
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = library.vocab_size()
        piece = {library.id_to_piece(i): i for i in range(self.size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))}
        self.symbol = np.empty(0x110000, np.int64)
        for size, (a, b) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000)), 1):
            self.symbol[a:b] = self.size + size
        for p, i in piece.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # Higher scores merge first; equal ones are of equal rank.
        rank = {s: k for k, s in enumerate(sorted({library.get_score(i) for i in piece.values()}, reverse=True))}
        self.width = self.size + 8
        pairs = sorted((piece[p[:k]] * self.width + piece[p[k:]], rank[library.get_score(i)], i) for p, i in piece.items() for k in range(1, len(p)) if p[:k] in piece and p[k:] in piece)
        self.pair, self.rank, self.whole = (np.array([x[k] for x in pairs], np.int64) for k in range(3))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; _NONE where there is no merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair, key), self.pair.size - 1)
        known = self.pair[at] == key
        return np.where(known, self.rank[at], _NONE), self.whole[at]

    def tokens(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.size, 1, symbols - self.size)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each pre-token (non-empty strings, with their spaces as SPACE)."""
        out = np.zeros(len(texts), np.int64)
        short = [k for k, t in enumerate(texts) if len(t) <= LONG]
        for k, t in enumerate(texts):
            if len(t) > LONG:
                out[k] = self._count_long(t)
        if not short:
            return out
        symbols = self.symbol[np.frombuffer("".join(texts[k] for k in short).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.array(short), [len(texts[k]) for k in short])
        rank = np.full(symbols.size, _NONE)
        whole = np.zeros(symbols.size, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner], whole[inner] = self.look_up(symbols[inner], symbols[inner + 1])
        while symbols.size:
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, owner.size))
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                out[owner[starts[done]]] = np.add.reduceat(self.tokens(symbols), starts)[done]
                live = np.repeat(~done, sizes)
                symbols, owner, rank, whole = symbols[live], owner[live], rank[live], whole[live]
                least, sizes = least[~done], sizes[~done]
                if not symbols.size:
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            symbols[at] = whole[at]
            keep = np.ones(symbols.size, bool)
            keep[at + 1] = False
            symbols, owner, rank, whole = symbols[keep], owner[keep], rank[keep], whole[keep]
            at = at - np.arange(at.size)
            changed = np.concatenate((at, at[at > 0] - 1))
            rank[changed] = _NONE
            changed = changed[changed + 1 < symbols.size]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed], whole[changed] = self.look_up(symbols[changed], symbols[changed + 1])
        return out

    @property
    def _table(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.whole.tolist(), strict=True), strict=True))
        return self._pairs

    def _count_long(self, text: str) -> int:
        symbols = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n, table = len(symbols), self._table
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*table[key], k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (key := symbols[k] * self.width + symbols[k + 1]) in table]
        heap = [(r, k, w, a, b) for r, w, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, whole, a, b = heapq.heappop(heap)
            right = after[k]
            if symbols[k] != a or right >= n or symbols[right] != b:
                continue
            symbols[k], symbols[right] = whole, -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (key := symbols[x] * self.width + symbols[y]) in table:
                    r, w = table[key]
                    heapq.heappush(heap, (r, x, w, symbols[x], symbols[y]))
        left = np.array([s for s in symbols if s >= 0])
        return int(self.tokens(left).sum())


@lru_cache(2)
def merges(model: str) -> Merges:
    return Merges(model)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a non-empty text, each without the one space that begins it."""
    words = (text.replace(SPACE, " ") if SPACE in text else text).split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0
    for w in words:
        if w:
            out.append(SPACE * spaces + w)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        out.append(SPACE * (spaces - 1))
    return out


def count_batch(texts: list[str | None], table: Merges, known: dict[str, int], counts: list[int]) -> list[int]:
    """Tokens of each text.  known: place of a pre-token in counts; both grow."""
    if len(known) > REMEMBERED:
        known.clear()
        counts.clear()
    places = []
    first_new = len(counts)
    new: list[str] = []
    for text in texts:
        spots = []
        for w in pre_tokens(text) if text else ():
            k = known.get(w)
            if k is None:
                known[w] = k = first_new + len(new)
                new.append(w)
            spots.append(k)
        places.append(np.array(spots, np.int64))
    for a in range(0, len(new), 50_000):
        counts.extend(table.count([SPACE + w for w in new[a : a + 50_000]]).tolist())
    numbers = np.array(counts, np.int64)
    return [int(numbers[p].sum()) for p in places]


def _counted(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, counts = merges(model), {}, []
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = part["text"].to_pylist()
                n_bytes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n_bytes, pa.int64()), pa.array(count_batch(texts, table, known, counts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens.  A null doc_id stays null; repeated rows give repeated results; an
    empty table gives an empty one.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(model), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
