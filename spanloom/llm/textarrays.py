"""Words and shingles of Arrow text columns as numpy arrays, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z is lower-cased first.  Both rules act on single
bytes below 0x80, so they give the same words on UTF-8 bytes as on code points.  Words are known by a 64-bit
multilinear hash (random table by byte value times random multiplier by place in the word, wrapped at 2**64).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; bounds the temporary arrays to some 40 times as much.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACES = 1 << 12
_PLACE = _rng.integers(0, 1 << 64, _PLACES, dtype=np.uint64) | np.uint64(1)
_SHINGLE = _rng.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def _hash_words(raw: np.ndarray, cuts: np.ndarray, spaces: np.ndarray = _SPACE, lower: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of raw, none of which crosses a cut; the words' count before each cut; begins; sizes."""
    inside = ~spaces[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[cuts[cuts < raw.size]] = False
    begins = inside & ~before
    at = np.flatnonzero(inside)
    if not at.size:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(cuts.size, np.int64), none, none
    first = np.flatnonzero(begins[at])
    size = np.diff(np.append(first, at.size))
    place = np.arange(at.size) - np.repeat(first, size)
    h = _BYTE[lower[raw[at]]] * _PLACE[place & (_PLACES - 1)]
    if size.max() > _PLACES:
        h *= (place // _PLACES * 2 + 1).astype(np.uint64)
    return mix64(np.add.reduceat(h, first)), np.searchsorted(at[first], cuts), at[first], size


def doc_tokens(raw: np.ndarray, off: np.ndarray, spaces: np.ndarray = _SPACE, lower: np.ndarray = _LOWER, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, word offsets by row, begins in raw, sizes) for runs of rows of about
    slice_bytes.

    A longer text comes alone; it is hashed in pieces that end at white space, and only its hashes are held whole.
    """
    row, rows = 0, off.size - 1
    while row < rows:
        if off[row + 1] - off[row] > slice_bytes:
            parts, a, end = [], int(off[row]), int(off[row + 1])
            while a < end:
                b = min(a + slice_bytes, end)
                while b < end and not spaces[raw[b]]:
                    gap = np.flatnonzero(spaces[raw[b : b + 4096]])
                    b = b + int(gap[0]) if gap.size else min(b + 4096, end)
                words, _, begins, sizes = _hash_words(raw[a:b], np.zeros(1, np.int64), spaces, lower)
                parts.append((words, begins + a, sizes))
                a = b
            words, begins, sizes = (np.concatenate([p[k] for p in parts]) for k in range(3))
            yield row, row + 1, words, np.array([0, words.size]), begins, sizes
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(off, off[row] + slice_bytes, "right")) - 1)
        words, at, begins, sizes = _hash_words(raw[off[row] : off[last]], off[row : last + 1] - off[row], spaces, lower)
        at = at.copy()
        at[-1] = words.size
        yield row, last, words, at, begins + off[row], sizes
        row = last


def doc_words(raw: np.ndarray, off: np.ndarray, spaces: np.ndarray = _SPACE, lower: np.ndarray = _LOWER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What doc_tokens gives, without the places."""
    for a, b, words, at, _, _ in doc_tokens(raw, off, spaces, lower):
        yield a, b, words, at


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The distinct hashed shingles of one text, sorted; a text of fewer words than width is one shingle, none of no words."""
    if not words.size:
        return words
    n = min(width, words.size)
    h = np.full(words.size - n + 1, np.uint64(n))
    for k in range(n):
        h += words[k : words.size - n + 1 + k] * _SHINGLE[k]
    return np.unique(mix64(h))
