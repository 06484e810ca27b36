"""Scores of texts by online logistic context mixing.

A text is a run of symbols: the bytes of each word and a stop after it, and one more stop at the end of the text.  A
symbol is a run of bits, its path in the prefix code of the one or two symbols before it.  Every bit of every word is predicted by
TABLES hashed contexts: the word's last 4 symbols; all of the word so far; the word before (its last letters, if it is
long) with the word's last 2 symbols; the word that the text has used most so far (in effect its language) with the last
2 symbols.  Each context's counts over all training texts are kept in a hashed table of states.  The predictions are
added in the logistic domain under weights that a gate (how often two of the contexts were seen) selects; the weights are
refined online: each text starts from the same ones, and every block of its words moves them along the gradient of the
coding cost.  All that predicts a bit stands before it, so the sum over a text's bits is the log probability of the text.

Every word of the training texts counts in every context, however rare it is.  Contexts that share a slot add up; the
weights of a context that says little shrink.

The tables have 2 ** SLOT_BITS slots each whatever the corpus: that is the bound of what the driver and each worker
hold.  Contexts inside a word are counted on the vocabulary, those over word borders on the texts; a task sends the
cells it has seen, and they are added up by slab.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import settle
from spanloom.llm.textarrays import _BYTE, _LOWER, _PLACE, _PLACES, doc_tokens, mix64, utf8

HELD_OUT = 2
FOLDS = 7
#: Contexts, those of them inside a word, and hashed slots of each: one byte a slot.
TABLES, INNER, SLOT_BITS = 4, 2, 23
#: Letters of a word before that count as they are; a longer one counts by its last 2.
WHOLE = 3
#: Slots that the nodes of one code tree are spread over: a cache line, so that a symbol's bits lie together.
LINE = 64
#: Cells of a table that are summed together.
SLAB = 1 << 16
#: A state is the log odds in steps of STEP (LEVELS of them, even odds in the middle) and how often its cell was seen.
STEP, LEVELS = 0.22, 64
SEEN = (1, 4, 32)
PRIOR = 0.4
#: Gates (states of how often the whole word so far and the word before were seen) and the first weight of each context.
GATES = 16
START = (0.30, 0.45, 0.35, 0.35)
#: Words of a text before the weights first move; later blocks grow by as many.  A move is RATE times the gradient by the
#: curvature so far, which begins at CURVE.
BLOCK_WORDS, RATE, CURVE = 16, 1.5, 50.0
#: Share of all symbols from which a pair of symbols has a code of its own: 1 / OWN_CODE pairs at most.
OWN_CODE = 3e-4
#: Share of the training tokens from which a word's count is looked up in memory (so there are 1 / LOOKED_UP such words
#: at most, 160 MB); the counts of rarer words come by a join.
LOOKED_UP = 1e-7
STOP, _START = 0x20, 256
_END = 1
#: Bytes of texts and words of one text that are scored, or counted, together: a context that they hold twice is looked
#: up once.  They bound the arrays to some hundred MB.
SLICE, PIECE = 1 << 20, 300_000
COUNTED, COUNTED_PIECE = 1 << 22, 1_200_000
#: Bytes that are cut into words at a time.
CUT = 1 << 17
#: Words that are scored at a time: their bits stay in a processor's cache.
STEP_WORDS = 2048
#: Sums that the bits side by side go to in turn.
LANES = 4
#: Words that are spelled and looked up at a time.
PART = 8192
_SALT = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.expr(f"crc32(cast({doc_id} as string)) % {FOLDS} = {HELD_OUT}"), F.lit(False))


@dataclass(frozen=True)
class Code:
    """Prefix codes of a symbol after the one or two before it; _START stands before a word's first.

    rows: the code after each pair (257 * the one before the last + the last).  Of code r the path of symbol s is number
    r * 256 + s: its steps start at ``begins`` in ``nodes`` and ``bits`` and are ``sizes`` many.  Nodes are numbered from
    the root on, so that the frequent ones differ in their low bits.
    """

    rows: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @cached_property
    def runs(self) -> Runs:
        """The steps of each path: the node's number in a line, with LINE for a bit that is set."""
        return Runs(self.nodes & np.uint8(LINE - 1) | self.bits * np.uint8(LINE), np.append(self.begins, self.nodes.size))

    @classmethod
    def of(cls, after_one: np.ndarray, pairs: np.ndarray | None = None, after_two: np.ndarray | None = None) -> Code:
        """after_one: (257, 256) counts of each symbol after each; after_two: (pairs, 256) those after the pairs that have
        a code of their own.  What never followed is coded by how often it followed the last alone, or stands at all."""
        any_where = after_one.sum(axis=0).astype(object)
        weights = [*(after_one.astype(object) * 2**24 + any_where + 1).tolist()]
        rows = np.tile(np.arange(_START + 1, dtype=np.int32), _START + 1)
        for k, pair in enumerate([] if pairs is None else pairs.tolist(), _START + 1):
            weights.append((after_two[k - _START - 1].astype(object) * 2**40 + after_one[pair % (_START + 1)].astype(object) * 2**16 + any_where + 1).tolist())
            rows[pair] = k
        sizes, nodes, bits = [], [], []
        for row in weights:
            heap = [(w, b) for b, w in enumerate(row)]
            heapq.heapify(heap)
            children, top = {}, 256
            while len(heap) > 1:
                x, y = heapq.heappop(heap), heapq.heappop(heap)
                children[top] = (x[1], y[1])
                heapq.heappush(heap, (x[0] + y[0], top))
                top += 1
            paths: list[tuple[list[int], list[int]]] = [([], [])] * 256
            level, number = [(heap[0][1], [], [])], 0
            while level:
                below = []
                for node, at, way in level:
                    if node < 256:
                        paths[node] = (at, way)
                    else:
                        below += [(child, [*at, number], [*way, bit]) for bit, child in enumerate(children[node])]
                        number += 1
                level = below
            for at, way in paths:
                sizes.append(len(at))
                nodes += at
                bits += way
        size = np.array(sizes)
        return cls(rows, (np.cumsum(size) - size).astype(np.int64), size.astype(np.int32), np.array(nodes, np.uint8), np.array(bits, bool))


@dataclass(frozen=True)
class Spelled:
    """Words spelled with their stops, as symbols and bits end to end.

    first_symbol, first_bit: of each word, and the end; steps: bits of each symbol; short: hash of the last 2 symbols
    before each; inner: place of each symbol in each inner context; node (its number in a line), bit: of each bit.
    """

    first_symbol: np.ndarray
    first_bit: np.ndarray
    steps: np.ndarray
    short: np.ndarray
    inner: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def _places(context: np.ndarray) -> np.ndarray:
    """First slot of the line of each hashed context, with its twist in the low bits."""
    return (context >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def symbol_paths(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first symbol of each word and the end, word, place, symbol, last two symbols) of words and their stops."""
    n = sizes + 1
    first = np.zeros(n.size + 1, np.int64)
    np.cumsum(n, out=first[1:])
    word = np.repeat(np.arange(n.size), n)
    place = np.arange(first[-1]) - first[word]
    symbol = np.full(place.size, STOP, np.int64)
    inside = np.flatnonzero(place < sizes[word])
    symbol[inside] = _LOWER[raw[begins[word[inside]] + place[inside]]]
    return first, word, place, symbol, _before(symbol, place, 1) + (_START + 1) * _before(symbol, place, 2)


def _before(symbol: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k-th symbol before each; _START before the word."""
    out = np.full(symbol.size, _START, np.int64)
    out[k:] = symbol[:-k]
    out[place < k] = _START
    return out


def spell(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, code: Code, inner: bool = True) -> Spelled:
    """The words at ``begins`` in raw.  A word of size 0 is the end of a text: a stop alone.  inner: also their places."""
    first, word, place, symbol, two = symbol_paths(raw, begins, sizes)
    short = mix64(two.astype(np.uint64) + _SALT[0])
    places = np.zeros((0, symbol.size), np.int64)
    if inner:
        tail = two | _before(symbol, place, 3) << 20 | _before(symbol, place, 4) << 30
        letters = _BYTE[symbol] * _PLACE[place & (_PLACES - 1)]
        so_far = np.cumsum(letters) - letters
        whole = so_far - so_far[first[:-1]][word] + place.astype(np.uint64) * _SALT[2]
        places = np.stack([_places(mix64(tail.astype(np.uint64) ^ _SALT[1])), _places(mix64(whole + _SALT[2]))])
    path = code.rows[two] * 256 + symbol
    steps = code.sizes[path]
    begin = np.zeros(symbol.size + 1, np.int64)
    np.cumsum(steps, out=begin[1:])
    step = code.runs.of(path)
    return Spelled(first, begin[first], steps.astype(np.uint8), short, places, step & np.uint8(LINE - 1), step >= LINE)


def spell_parts(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, code: Code, inner: Callable[[Spelled], np.ndarray] | None = None) -> tuple[Spelled, np.ndarray | None]:
    """The words spelled PART at a time (their arrays stay in a processor's cache), without inner places, and what ``inner``
    gives for the bits of each part, end to end."""
    parts, found = [], []
    for a in range(0, max(sizes.size, 1), PART):
        parts.append(spell(raw, begins[a : a + PART], sizes[a : a + PART], code, inner is not None))
        if inner is not None:
            found.append(inner(parts[-1]))
    first = (np.concatenate([np.zeros(1, np.int64), *(np.diff(getattr(s, name)) for s in parts)]).cumsum() for name in ("first_symbol", "first_bit"))
    whole = Spelled(*first, *(np.concatenate([getattr(s, name) for s in parts]) for name in ("steps", "short")), parts[0].inner[:, :0], *(np.concatenate([getattr(s, name) for s in parts]) for name in ("node", "bit")))
    return whole, np.concatenate(found) if found else None


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, ascending, and the number of each key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(keys.size, bool)
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    chosen = order[fresh]
    place = np.empty(keys.size, np.int64)
    place[order] = chosen[np.cumsum(fresh) - 1]
    is_chosen = np.zeros(keys.size, np.int64)
    is_chosen[chosen] = 1
    return np.flatnonzero(is_chosen), (np.cumsum(is_chosen) - 1)[place]


def most_used(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The type that stands most often in the text before each token (of several, the first that did); -1 at its begin."""
    n = np.diff(at)
    text = np.repeat(np.arange(n.size), n)
    order = np.argsort(text * (int(kind.max()) + 1) + kind, kind="stable")
    fresh = np.flatnonzero(np.append(True, (kind[order][1:] != kind[order][:-1]) | (text[order][1:] != text[order][:-1])))
    times = np.empty(kind.size, np.int64)
    times[order] = np.arange(kind.size) - np.repeat(fresh, np.diff(np.append(fresh, kind.size)))
    record = np.maximum.accumulate((text << 40) + times)
    at_record = np.maximum.accumulate(np.where(np.append(True, record[1:] != record[:-1]), np.arange(kind.size), 0))
    out = np.empty(kind.size, np.int64)
    out[1:] = kind[at_record[:-1]]
    out[at[:-1][n > 0]] = -1
    return out


def outer_contexts(raw: np.ndarray, at: np.ndarray, begins: np.ndarray, sizes: np.ndarray, kind: np.ndarray, types: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """What the word before each in its text counts as, and the word that its text has used most: by number, with the
    hash of each number."""
    last = np.maximum(begins + sizes - 1, 0)
    counts_as = np.where(sizes <= WHOLE, kind, types.size + (_LOWER[raw[last]].astype(np.int64) << 8 | _LOWER[raw[last - 1]])) if raw.size else kind
    before = np.empty_like(kind)
    before[1:] = counts_as[:-1]
    before[at[:-1][np.diff(at) > 0]] = types.size + (1 << 16)
    most = most_used(kind, at)
    most[most < 0] = types.size
    letters = np.arange(1 << 16, dtype=np.uint64)
    return [(before, np.concatenate([types, letters, np.array([3], np.uint64)]) * _SALT[3]), (most, np.append(types, _SALT[4]) * _SALT[4])]


class Runs:
    """Items of words, that lie from ``first`` on by word; those of any words are copied end to end, a word at a time."""

    def __init__(self, items: np.ndarray, first: np.ndarray) -> None:
        self.type = items.dtype
        self.runs = pa.Array.from_buffers(pa.large_binary(), first.size - 1, [None, pa.py_buffer(first * items.itemsize), pa.py_buffer(items)])

    def of(self, words: np.ndarray) -> np.ndarray:
        found = self.runs.take(pa.array(words)).buffers()[2]
        return np.frombuffer(found, self.type) if found is not None else np.zeros(0, self.type)


class Outer:
    """Slots of spelled words in an outer context."""

    def __init__(self, s: Spelled) -> None:
        self.symbols, self.bits = np.diff(s.first_symbol), np.diff(s.first_bit)
        self.short, self.steps, self.node = Runs(s.short, s.first_symbol), Runs(s.steps, s.first_symbol), Runs(s.node, s.first_bit)

    def slots(self, words: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of the bits of words (numbers in the spelled ones) end to end, under a context of each."""
        hashed = self.short.of(words) + np.repeat(context, self.symbols[words])
        hashed *= _SALT[0]
        out = np.repeat(_places(hashed), self.steps.of(words))
        out ^= self.node.of(words)
        return out


def inner_slots(s: Spelled) -> list[np.ndarray]:
    """Slots of the bits in each inner context."""
    return [np.repeat(place, s.steps) ^ s.node for place in s.inner]


def state(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """One byte for the counts of a cell."""
    level = np.clip(np.rint(np.log((ones + PRIOR) / (zeros + PRIOR)) / STEP) + LEVELS // 2, 0, LEVELS - 1)
    return (np.digitize(zeros + ones, SEEN) * LEVELS + level).astype(np.uint8)


#: Log odds (STEP times the level) and how often seen, by state.
STRETCH = ((np.arange(256) % LEVELS - LEVELS // 2) * STEP).astype(np.float32)
CONFIDENCE = (np.arange(256) // LEVELS).astype(np.int32)
EMPTY = int(state(np.zeros(1), np.zeros(1))[0])


@dataclass(frozen=True)
class Weights:
    """Of each context, by text and gate, and the curvature so far; room for the arrays of a step."""

    of: np.ndarray
    curve: np.ndarray
    room: np.ndarray
    rows: np.ndarray

    @classmethod
    def start(cls, rows: int) -> Weights:
        of = np.tile(np.array(START, np.float32)[:, None, None], (1, rows, GATES))
        return cls(of, np.full((rows, GATES), CURVE), np.empty((TABLES + 3, 0), np.float32), np.empty(0, np.int64))

    def cost(self, levels: list[np.ndarray], gate: np.ndarray, sign: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bits that each text costs in one block; then the weights move.  levels: of each bit by context (small whole
        numbers, log odds in steps); sign: of what the bit costs; text: distinct, with the first bit of each."""
        row = self.rows[: gate.size]
        row[:] = gate
        row[first[1:]] += GATES
        row[1:] -= gate[:-1]
        np.cumsum(row, out=row)
        of, curve = self.of[:, text].reshape(TABLES, -1), self.curve[text].reshape(-1)
        by_step = of * np.float32(STEP)
        *x, odds, part, bend = self.room[:, : gate.size]
        square = np.zeros(gate.size, np.int16)
        for k, level in enumerate(levels):
            x[k][:] = level
            square += np.square(level, dtype=np.int16)
            np.take(by_step[k], row, out=part if k else odds, mode="clip")
            if k:
                part *= x[k]
                odds += part
            else:
                odds *= x[k]
        odds *= sign
        wrong = np.exp(np.clip(odds, -20, 20, out=odds), out=odds)
        either = np.add(wrong, 1, out=part)
        wrong /= either
        np.multiply(square, wrong, out=bend)
        bend /= either
        cost = np.add.reduceat(np.log(either, out=either), first, dtype=np.float64) / np.log(2)
        wrong *= sign
        # Bits side by side are summed in different lanes: none waits for the sum before it.
        for lane in range(1, LANES):
            row[lane::LANES] += lane * curve.size
        curve += self._sums(row, bend, curve.size) * STEP**2
        for k in range(TABLES):
            of[k] -= RATE * STEP * self._sums(row, np.multiply(wrong, x[k], out=part), curve.size) / curve
        self.of[:, text], self.curve[text] = of.reshape(TABLES, -1, GATES), curve.reshape(-1, GATES)
        return cost

    def with_room(self, bits: int) -> Weights:
        """The same for steps of so many bits."""
        return self if bits <= self.rows.size else Weights(self.of, self.curve, np.empty((TABLES + 3, bits), np.float32), np.empty(bits, np.int64))

    @staticmethod
    def _sums(row: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, items, minlength=LANES * n).reshape(LANES, n).sum(axis=0)


def with_ends(tokens: np.ndarray, at: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts with an end (a word of size 0) after each: hashes, offsets, begins, sizes."""
    rows = at.size - 1
    whole_at = at + np.arange(rows + 1)
    word = np.ones(tokens.size + rows, bool)
    word[whole_at[1:] - 1] = False
    out = np.full(word.size, _END, np.uint64), np.zeros(word.size, np.int64), np.zeros(word.size, np.int64)
    for x, y in zip(out, (tokens, begins, sizes), strict=True):
        x[word] = y
    return out[0], whole_at, out[1], out[2]


def slices(raw: np.ndarray, off: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What doc_tokens gives, for runs of rows of about ``size`` bytes, cut into words CUT bytes at a time."""
    held: list[tuple] = []
    for found in doc_tokens(raw, off, slice_bytes=min(CUT, size)):
        if held and off[found[1]] - off[held[0][0]] > size:
            yield _merged(held)
            held = []
        held.append(found)
    if held:
        yield _merged(held)


def _merged(held: list[tuple]) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, begins, sizes = (np.concatenate([h[k] for h in held]) for k in (2, 4, 5))
    return held[0][0], held[-1][1], words, np.concatenate([np.zeros(1, np.int64), *(np.diff(h[3]) for h in held)]).cumsum(), begins, sizes


def text_costs(raw: np.ndarray, words: np.ndarray, at: np.ndarray, begins: np.ndarray, sizes: np.ndarray, code: Code, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits that each text costs, of words with the ends; the distinct words, and the number of each word among them.
    tables: (TABLES, slots) states."""
    rows = at.size - 1
    text = np.repeat(np.arange(rows), np.diff(at))
    first, kind = distinct(words)
    types = words[first]
    contexts = outer_contexts(raw, at, begins, sizes, kind, types)
    # Blocks of BLOCK_WORDS, 2 * BLOCK_WORDS, ... words, those of all texts side by side, STEP_WORDS or so at a time.
    block = ((np.sqrt(1 + 8 * ((np.arange(words.size) - at[text]) // BLOCK_WORDS)) - 1) // 2).astype(np.int64)
    order = np.argsort(block, kind="stable")
    starts = np.flatnonzero(np.append(True, (np.diff(block[order]) != 0) | (np.diff(text[order]) != 0)))
    edges = _edges(starts, block[order[starts]], words.size)
    weights, total = Weights.start(rows), np.zeros(rows)
    j = 0
    while j < edges.size - 1:
        last = max(j + 1, int(np.searchsorted(edges, edges[j] + PIECE, "right")) - 1)
        here = order[edges[j] : edges[last]]
        present, local = (np.arange(types.size), kind[here]) if here.size == words.size else np.unique(kind[here], return_inverse=True)
        s, inside = spell_parts(raw, begins[first[present]], sizes[first[present]], code, lambda s: _inside(s, tables))
        outer, inside, bits = Outer(s), Runs(inside, s.first_bit), np.diff(s.first_bit)
        # A word in a context costs the same looks into the tables wherever it stands: once a piece.
        seen = []
        for k, (context, hashes) in enumerate(contexts, INNER):
            one, number = distinct(kind[here] << 32 | context[here])
            pair, found = local[one], []
            for a in range(0, pair.size, PART):
                states = tables[k].take(outer.slots(pair[a : a + PART], hashes[context[here[one[a : a + PART]]]]))
                level = (states & np.uint8(LEVELS - 1)).view(np.int8) - np.int8(LEVELS // 2)
                if k == INNER:
                    every = inside.of(pair[a : a + PART]).view(np.int8).reshape(-1, 4).copy()
                    every[:, 2] = level
                    every[:, 3] += (states // LEVELS).view(np.int8)
                    level = every.view(np.int32).ravel()
                found.append(level)
            seen.append((Runs(np.concatenate(found), np.append(0, np.cumsum(bits[pair]))), number))
        at_bit = np.append(0, np.cumsum(bits[local]))
        weights = weights.with_room(int(np.diff(at_bit[edges[j : last + 1] - edges[j]]).max()))
        for a, b in zip(edges[j:last], edges[j + 1 : last + 1], strict=True):
            part = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)]
            record, most = (runs.of(number[a - edges[j] : b - edges[j]]) for runs, number in seen)
            one, two, three, flags = np.ascontiguousarray(record.view(np.int8).reshape(-1, 4).T)
            owner = text[order[part]]
            total[owner] += weights.cost([one, two, three, most], flags & np.int8(GATES - 1), 1 - 2 * (flags // np.int8(GATES)), owner, at_bit[part - edges[j]] - at_bit[a - edges[j]])
        j = last
    return total, types, kind


def _inside(s: Spelled, tables: np.ndarray) -> np.ndarray:
    """Four bytes a bit: its level in each inner context, none, its gate by the last of them with the bit above."""
    out = np.zeros((s.bit.size, 4), np.int8)
    for k, slots in enumerate(inner_slots(s)):
        states = tables[k].take(slots)
        out[:, k] = (states & np.uint8(LEVELS - 1)).view(np.int8) - np.int8(LEVELS // 2)
    out[:, 3] = states // LEVELS * np.uint8(4) + s.bit * np.uint8(GATES)
    return out.view(np.int32).ravel()


def _edges(starts: np.ndarray, block: np.ndarray, end: int) -> np.ndarray:
    """Where to cut words into steps: at each new block, and within it before a text after STEP_WORDS words."""
    fresh = np.append(True, block[1:] != block[:-1])
    begin = np.maximum.accumulate(np.where(fresh, starts, 0))
    step = (starts - begin) // STEP_WORDS
    return np.append(starts[fresh | np.append(True, step[1:] != step[:-1])], end)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lower-cased words of a batch with their hashes and counts; the empty word counts the ends."""
    for batch in batches:
        raw, off = utf8(batch["text"])
        found = [(words, begins, sizes) for _, _, words, _, begins, sizes in doc_tokens(raw, off, slice_bytes=CUT)]
        words, begins, sizes = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
        first, kind = distinct(words)
        types, counts = words[first], np.bincount(kind)
        size = sizes[first]
        at = np.zeros(size.size + 1, np.int64)
        np.cumsum(size, out=at[1:])
        letters = _LOWER[raw[np.arange(at[-1]) + np.repeat(begins[first] - at[:-1], size)]] if types.size else np.zeros(0, np.uint8)
        spelled = pa.StringArray.from_buffers(types.size, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))
        yield pa.RecordBatch.from_arrays([pa.array(types.view(np.int64)), spelled, pa.array(counts)], ["key", "word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([_END], pa.int64()), pa.array([""]), pa.array([batch.num_rows], pa.int64())], ["key", "word", "n"])


def _count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each symbol follows each pair, of a vocabulary (word, n)."""
    for batch in batches:
        raw, off = utf8(batch["word"])
        n = batch["n"].to_numpy()
        for a in range(0, batch.num_rows, 100_000):
            _, word, _, symbol, two = symbol_paths(raw, off[a:-1][:100_000], np.diff(off)[a : a + 100_000])
            path, at = np.unique(two * 256 + symbol, return_inverse=True)
            total = np.zeros(path.size, np.int64)
            np.add.at(total, at, n[a + word])
            yield pa.RecordBatch.from_arrays([pa.array(path // 256), pa.array(path % 256), pa.array(total)], ["pair", "symbol", "n"])


def _cells(table: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells (zeros, ones) of a table that aren't empty, packed, by slab."""
    pack = zstandard.ZstdCompressor(level=1)
    for slab, part in enumerate(counts.reshape(-1, 2 * SLAB)):
        at = np.flatnonzero(part).astype(np.uint32)
        if at.size:
            cells = pack.compress(at.tobytes() + part[at].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([table], pa.int32()), pa.array([slab], pa.int32()), pa.array([cells], pa.binary())], ["table", "slab", "cells"])


def _count_inner(code: Code) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells of the inner contexts, of a vocabulary (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((INNER, 2 << SLOT_BITS), np.int64)
        for batch in batches:
            raw, off = utf8(batch["word"])
            number = batch["n"].to_numpy()
            for a in range(0, batch.num_rows, PIECE):
                n = number[a : a + PIECE]
                s = spell(raw, off[a : a + n.size], np.diff(off[a : a + n.size + 1]), code)
                times = np.repeat(n, np.diff(s.first_bit))
                for k, slots in enumerate(inner_slots(s)):
                    np.add.at(counts[k], slots * 2 + s.bit, times)
        for k in range(INNER):
            yield from _cells(k, counts[k])

    return run


def _count_outer(code: Code) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells of the outer contexts, of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((TABLES - INNER, 2 << SLOT_BITS), np.int32)
        for batch in batches:
            raw, off = utf8(batch["text"])
            for _, _, *found in slices(raw, off, COUNTED):
                words, at, begins, sizes = with_ends(*found)
                first, kind = distinct(words)
                types = words[first]
                contexts = outer_contexts(raw, at, begins, sizes, kind, types)
                for a in range(0, words.size, COUNTED_PIECE):
                    here = slice(a, a + COUNTED_PIECE)
                    present = np.arange(types.size) if words.size <= COUNTED_PIECE else np.flatnonzero(np.bincount(kind[here], minlength=types.size))
                    s, _ = spell_parts(raw, begins[first[present]], sizes[first[present]], code)
                    outer, bits = Outer(s), Runs(s.bit.view(np.uint8), s.first_bit)
                    for k, (context, hashes) in enumerate(contexts):
                        # Equal words in equal contexts are counted at once.
                        pairs = np.sort(kind[here] << 32 | context[here])
                        fresh = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
                        times, pairs = np.diff(np.append(fresh, pairs.size)).astype(np.int32), pairs[fresh]
                        local = np.searchsorted(present, pairs >> 32)
                        for b in range(0, pairs.size, PART):
                            some = local[b : b + PART]
                            cell = outer.slots(some, hashes[pairs[b : b + PART] & 0xFFFFFFFF])
                            cell += cell
                            cell += bits.of(some)
                            np.add.at(counts[k], cell, np.repeat(times[b : b + PART], outer.bits[some]))
        for k in range(TABLES - INNER):
            yield from _cells(INNER + k, counts[k])

    return run


def _states(slabs: pa.Table) -> pa.Table:
    """The states of a slab whose cells stand in several rows."""
    total, unpack = np.zeros(2 * SLAB, np.int64), zstandard.ZstdDecompressor()
    for cells in slabs["cells"]:
        packed = unpack.decompress(cells.as_py())
        n = len(packed) // 12
        total[np.frombuffer(packed, np.uint32, n)] += np.frombuffer(packed, np.int64, n, 4 * n)
    found = zstandard.ZstdCompressor(level=1).compress(state(total[0::2], total[1::2]).tobytes())
    return pa.table({"table": slabs["table"][:1], "slab": slabs["slab"][:1], "states": pa.array([found], pa.binary())})


@dataclass(frozen=True)
class Model:
    """code and states of the contexts; words (sorted hashes) with counts that are looked up; tokens, distinct tokens, texts."""

    code: Code
    tables: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    texts: int


def _code(follows: DataFrame) -> Code:
    """The code of (pair, symbol, n): pairs of OWN_CODE of all symbols and more have one of their own."""
    after_one = np.zeros((_START + 1, 256), np.int64)
    ones = follows.groupBy((F.col("pair") % (_START + 1)).alias("last"), "symbol").agg(F.sum("n").alias("n")).toArrow()
    after_one[ones["last"].to_numpy(), ones["symbol"].to_numpy()] = ones["n"].to_numpy()
    common = follows.groupBy("pair").agg(F.sum("n").alias("m")).where(F.col("m") >= max(1.0, OWN_CODE * float(after_one.sum())))
    twos = follows.join(F.broadcast(common), "pair").select("pair", "symbol", "n").toArrow()
    pairs, row = np.unique(twos["pair"].to_numpy(), return_inverse=True)
    after_two = np.zeros((pairs.size, 256), np.int64)
    after_two[row, twos["symbol"].to_numpy()] = twos["n"].to_numpy()
    return Code.of(after_one, pairs, after_two)


def _fewer(df: DataFrame) -> DataFrame:
    """The same rows in a quarter of the partitions, if two a core are left: each one's tables are sent but once."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions() // 4))


def learn(train: DataFrame) -> tuple[Model, DataFrame]:
    """(model, training counts (key, n) by word hash) of texts (text)."""
    train = train.select("text")
    vocabulary = settle(train.mapInArrow(_count_words, "key bigint, word string, n bigint").where("n > 0").groupBy("key", "word").agg(F.sum("n").alias("n")))
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("key") == _END, F.col("n"))), F.lit(0)).alias("texts")).first()
    tokens, distinct, texts = sums.n or 0, sums.v, sums.texts
    code = _code(settle(vocabulary.mapInArrow(_count_symbols, "pair bigint, symbol bigint, n bigint").groupBy("pair", "symbol").agg(F.sum("n").alias("n"))))
    least = LOOKED_UP * tokens
    cells = "table int, slab int, cells binary"
    counted = _fewer(vocabulary).mapInArrow(_count_inner(code), cells).unionByName(_fewer(train).mapInArrow(_count_outer(code), cells))
    slabs = settle(counted.groupBy("table", "slab").applyInArrow(_states, "table int, slab int, states binary"))
    tables = np.full((TABLES, 1 << SLOT_BITS), EMPTY, np.uint8)
    unpack = zstandard.ZstdDecompressor()
    for row in slabs.toArrow().to_pylist():
        tables[row["table"], row["slab"] * SLAB : (row["slab"] + 1) * SLAB] = np.frombuffer(unpack.decompress(row["states"]), np.uint8)
    entries = vocabulary.where((F.col("n") >= least) & (F.col("key") != _END)).select("key", "n").toArrow()
    words, counts = entries["key"].to_numpy().view(np.uint64), entries["n"].to_numpy()
    order = np.argsort(words)
    return Model(code, tables, words[order], counts[order], tokens, distinct, texts), vocabulary.select("key", "n")


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Costs of texts, with what of the base score the looked-up words give and the hashes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch["text"])
            for a, b, *found in slices(raw, off, SLICE):
                words, at, *places = with_ends(*found)
                cost, types, kind = text_costs(raw, words, at, *places, model.code, model.tables)
                spot = np.minimum(np.searchsorted(model.words, types), max(model.words.size - 1, 0))
                looked_up = (model.words[spot] == types) & (types != _END) if model.words.size else np.zeros(types.size, bool)
                known = looked_up[kind]
                logs = np.zeros(types.size)
                logs[looked_up] = np.log10(model.counts[spot[looked_up]] + 1.0)
                text = np.repeat(np.arange(b - a), np.diff(at))
                base = np.bincount(text, logs[kind], minlength=b - a)
                rare = np.flatnonzero(~known & (words != _END))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["row_id"].slice(a, b - a), batch["doc_id"].slice(a, b - a), pa.array(np.diff(at)), pa.array(np.bincount(text[known], minlength=b - a)), pa.array(base.astype(np.float64)), pa.array(cost), pa.array(np.diff(off[a : b + 1])),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, at).astype(np.int32)), pa.array(words[rare].view(np.int64))),
                    ],
                    ["row_id", "doc_id", "n_tokens", "found", "base", "cost", "n_bytes", "rare"],
                )

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of docs.

    A null or empty text is its end alone (bits_per_byte null).  A null doc_id isn't held out.  Repeated rows count and
    are scored each; without training rows every token is unknown and every bit even; texts of any length are scored
    whole, PIECE words at a time; columns of docs beside doc_id and text are ignored; an empty table gives an empty
    result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, vocabulary = learn(docs.where(~held_out()))
    schema = "row_id bigint, doc_id bigint, n_tokens bigint, found bigint, base double, cost double, n_bytes bigint, rare array<bigint>"
    scored = settle(docs.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(_scored(model), schema))
    rare = scored.select("row_id", F.explode("rare").alias("key")).groupBy("row_id", "key").agg(F.count(F.lit(1)).alias("times"))
    more = rare.join(vocabulary, "key").groupBy("row_id").agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    below, end = float(np.log10(model.tokens + model.distinct + 1)), float(np.log10(model.texts + 1))
    out = scored.drop("rare").join(more, "row_id", "left")
    known = F.col("found") + F.coalesce("times", F.lit(0)) + (1 if model.texts else 0)
    return out.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + end - F.col("n_tokens") * below).alias("base_score"), (F.col("cost") * -float(np.log10(2))).alias("score"),
        F.when(F.col("n_bytes") > 0, F.col("cost") / F.col("n_bytes")).alias("bits_per_byte"),
    )
