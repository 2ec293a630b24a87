"""Tokens of a batch of texts as 64-bit hashes, by whole-array numpy operations.

A token is a run of bytes of one class (a table of 256 classes; class 0 separates), so no Python object is made
for a token. Bytes above 127 never equal an ASCII byte, so classes of ASCII characters hold for UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; bounds the temporary arrays, not the text.
PIECE = 1 << 20
#: Texts of about so many bytes are tokenised together.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15

with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(1024, _BASE, np.uint64), dtype=np.uint64)

#: Lower case for A-Z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WORDS = np.ones(256, np.uint8)
WORDS[[32, 9, 10, 11, 12, 13]] = 0

#: Letters, digits, "_" and all bytes beyond ASCII in one class, other printable characters in another.
WORDS_AND_MARKS = np.full(256, 2, np.uint8)
WORDS_AND_MARKS[:33] = 0
WORDS_AND_MARKS[127] = 0
WORDS_AND_MARKS[128:] = 1
for _span in (range(48, 58), range(65, 91), range(97, 123), (95,)):
    WORDS_AND_MARKS[list(_span)] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        grown = np.cumprod(np.full(1 << (n - 1).bit_length(), _BASE, np.uint64), dtype=np.uint64)
        if n > 1 << 16:
            return grown
        _POWERS = grown
    return _POWERS


def text_slices(column: pa.Array | pa.ChunkedArray, size: int = CHUNK):
    """(first row, bytes, offsets) for runs of rows of about ``size`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS, fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each text and the end), in the order of the texts."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    kinds = classes[data]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
    new[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    real = kinds[start] != 0
    start, end = start[real], end[real]
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # a piece of whole tokens at a time
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, side="right")))
        a, lengths = start[at:to], end[at:to] - start[at:to]
        first = np.cumsum(lengths) - lengths
        local = np.arange(lengths.sum()) - np.repeat(first, lengths)
        part = data[local + np.repeat(a, lengths)]
        values = _BYTE[part if fold is None else fold[part]] * _powers(int(lengths.max()))[local]
        out[at:to] = mix(np.add.reduceat(values, first) ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        at = to
    return out, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` tokens; of fewer tokens, of the whole sequence as one."""
    n = len(hashes)
    k = min(width, n)
    if not k:
        return hashes
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(_BASE) + hashes[i : n - k + 1 + i])
    return out
