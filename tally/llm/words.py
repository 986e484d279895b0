"""Vectorised word splitting and hashing over the bytes of an Arrow text column.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; UTF-8 continuation
bytes never equal a separator, so bytes can be split directly. Hashes are 64-bit:
a polynomial over a random byte table (prefix sums, so one pass for all words of
a chunk), mixed with the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text turned into word hashes at once; bounds the working memory of a task.
CHUNK = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK + 1)
        inverse = np.uint64(pow(_MULT, -1, 2**64))
        up, down = np.full(size, np.uint64(_MULT)), np.full(size, inverse)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``; no word crosses a place in ``bounds``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = space[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = True
    before[1:] = gap
    after = before[1:].copy()
    after[:-1] = gap[1:]
    after[-1] = True
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner] = True
    after[inner - 1] = True
    word = ~gap
    return np.flatnonzero(word & before[:-1]), np.flatnonzero(word & after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, lower-cased."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text in pieces of about CHUNK bytes, cut at separators."""
    at = 0
    while len(data) - at > CHUNK:
        cut = np.flatnonzero(_SPACE[data[at + CHUNK :]][: 4 * CHUNK])
        if not len(cut):
            cut = np.flatnonzero(_SPACE[data[at + CHUNK :]])
        if not len(cut):
            break
        stop = at + CHUNK + int(cut[0])
        yield data[at:stop]
        at = stop
    yield data[at:]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows); a null is empty."""
    column = pa.array(column) if not isinstance(column, pa.Array) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def word_hashes(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of rows of a text column: the first row, and each row's word hashes in order."""
    data, offsets = text_buffers(column)
    rows, row = len(column), 0
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        if stop == row + 1 and len(part) > CHUNK:
            found = []
            for piece in _pieces(part):
                found.append(hashes(piece, *spans(piece, np.zeros(0, np.int64))))
            yield row, [np.concatenate(found)]
        else:
            bounds = offsets[row : stop + 1] - offsets[row]
            starts, ends = spans(part, bounds)
            each = hashes(part, starts, ends)
            yield row, np.split(each, np.searchsorted(starts, bounds[1:-1]))
        row = stop


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``size`` words; a shorter text is one run."""
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    acc = np.full(n, np.uint64(k))
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(acc)
