"""A bounded memory of pieces of text and their token ids, for tokenisers that work piece by piece.

A piece that was met gets a number; ids stand in one array with the place and count of each number. So a text costs a look-up for
each piece, and its ids are gathered by whole-array operations. New pieces of many texts are coded together.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Pieces of the texts that are coded at a time, about.
GROUP = 200_000
#: Elements that are gathered at a time, about.
BLOCK = 1 << 22


class _Numbers(dict):
    """Piece -> number. Looking up a new one numbers it and puts it on the list of those to code."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, piece) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Memory:
    """``code`` gives the ids of pieces, as one array, and how many each has. Beyond ``limit`` pieces or ``size`` characters the
    older generation goes: only speed depends on it."""

    def __init__(self, code: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int, kind, size: int = 1 << 23):
        self.code, self.limit, self.size, self.kind = code, limit, size, np.dtype(kind)
        self.older: _Numbers | dict = {}
        self.older_at = (np.empty(0, self.kind), np.zeros(1, np.int64))
        self._begin()

    def _begin(self) -> None:
        self.numbers, self.held = _Numbers(), 0
        self.flat, self.ends = np.empty(0, self.kind), np.zeros(1, np.int64)  # ends[i] to ends[i + 1] are the ids of number i

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        known = np.fromiter(map(self.older.get, new, itertools.repeat(-1)), np.int64, len(new)) if self.older else np.full(len(new), -1)
        coded, counts = self.code([p for p, k in zip(new, known.tolist(), strict=True) if k < 0])
        if (known >= 0).any():
            flat, ends = self.older_at
            at = np.where(known >= 0, ends[known], 0)
            size = np.where(known >= 0, ends[known + 1] - ends[known], 0)
            fresh = known < 0
            size[fresh] = counts
            at[fresh] = len(flat) + np.cumsum(counts) - counts
            coded, counts = gather(np.concatenate([flat, coded.astype(self.kind, copy=False)]), at, size), size
        self.flat = np.concatenate([self.flat, coded.astype(self.kind, copy=False)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        self.held += sum(map(len, new))

    def encode(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); a text is given as its pieces."""
        look = self.numbers.__getitem__
        numbers = [np.fromiter(map(look, pieces), np.int64, len(pieces)) for pieces in texts]
        self._learn()
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        every = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        counts = self.ends[every + 1] - self.ends[every]
        ids = gather(self.flat, self.ends[every], counts)
        sums = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        self._age()
        return ids, np.diff(sums)

    def take(self, distinct: list, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct[i] for each i of ``at``, one after the other; at which id each begins, and their end)."""
        numbers = np.fromiter(map(self.numbers.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        fresh = numbers < 0
        self.numbers.new = list(itertools.compress(distinct, fresh.tolist()))
        numbers[fresh] = np.arange(len(self.numbers), len(self.numbers) + len(self.numbers.new))
        self.numbers.update(zip(self.numbers.new, numbers[fresh].tolist(), strict=True))
        self._learn()
        wide = self.kind.itemsize
        values = pa.Array.from_buffers(pa.large_binary(), len(self.ends) - 1, [None, pa.py_buffer(self.ends * wide), pa.py_buffer(self.flat)])
        taken = values.take(pa.array(numbers[at]))
        bounds = np.frombuffer(taken.buffers()[1], np.int64, len(at) + 1) // wide
        ids = np.frombuffer(taken.buffers()[2], self.kind, int(bounds[-1])) if bounds[-1] else np.empty(0, self.kind)
        self._age()
        return ids, bounds

    def _age(self) -> None:
        if len(self.numbers) > self.limit or self.held > self.size:
            self.older, self.older_at = dict(self.numbers), (self.flat, self.ends)
            if len(self.older) > 2 * self.limit or self.held > 2 * self.size:  # one group alone is that large
                self.older, self.older_at = {}, (np.empty(0, self.kind), np.zeros(1, np.int64))
            self._begin()


def give_back() -> None:
    """Return freed memory to the machine, where its C library can: a Python worker lives on after a task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim:
        trim(0)


def gather(flat: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[a : a + n] for each place and count, one after the other. About BLOCK elements at a time have their places worked out."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    if total <= BLOCK:
        return flat[np.repeat(at - (ends - counts), counts) + np.arange(total)]
    out, row = np.empty(total, flat.dtype), 0
    while row < len(ends):
        done = int(ends[row] - counts[row])
        to = max(row + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
        own, n = ends[row:to], counts[row:to]
        out[done : int(own[-1])] = flat[np.repeat(at[row:to] - (own - n), n) + np.arange(done, int(own[-1]))]
        row = to
    return out


def in_groups(texts: list, split: Callable[[object], list], memory: Memory):
    """(ids, counts) of about GROUP pieces' worth of texts at a time, in order."""
    group, size = [], 0
    for t in texts:
        group.append(split(t))
        size += len(group[-1])
        if size > GROUP:
            yield memory.encode(group)
            group, size = [], 0
    if group:
        yield memory.encode(group)
