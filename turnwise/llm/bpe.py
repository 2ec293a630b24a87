"""Byte-level BPE as a finite-state transducer, and streaming decoding with an incremental UTF-8 machine.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of theirs. So the
merges compile into a machine that reads bytes and guesses where tokens end: its hypotheses are a place in the trie of
tokens with the token before. ``Transducer`` determinises it lazily: a state is the set of live hypotheses, built when first reached
and kept, and a step puts out the one token that ends the encoding of the bytes read so far. The tokens before it
follow from where that token begins; a window of bytes is held back, and what all live hypotheses share is emitted
when it is full, so lookahead is bounded. Whole pieces that are a token are that token, as in the library whose
ids these are.

Texts are split by the vocabulary's pattern, each match being encoded by itself. Work on pieces met before is kept in a
bounded memory. All is row by row: no shuffle, no skew.

Defined cases: a null text counts as empty and has no ids; ids decode to the same bytes; bytes that aren't UTF-8 decode
to U+FFFD as in Python's "replace"; an id that no token has is a ValueError; repeated rows give equal results, an empty table an empty one; texts of any
length are coded whole. Extra columns pass through ``with_ids``, which replaces a column of its result's name; ``round_trip`` returns the
columns of ``keep``, which must not be named ids or decoded (ValueError).
"""

from __future__ import annotations

import base64
import functools
import gc
import itertools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm.memory import Memory, gather, give_back, in_groups

#: States and runs that are kept; beyond them a memory starts anew. Only speed depends on it.
STATES, PIECES = 120_000, 100_000
#: Pieces of up to so many bytes step together. They are shorter than the window, so their tokens need no more lookahead.
LOCKSTEP = 64
#: Rows that are coded at a time.
ROWS = 500
#: Bytes of a piece that are held back before tokens are emitted; more than the longest token has.
WINDOW = 1024
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Runs that no match of the pattern crosses: a word with the blank before it, or white space.
_RUNS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Where white space follows a word a run begins; longer texts are cut there, into segments of about so many characters.
_CUT, SEGMENT = re.compile(rf"[^{_SPACE}][{_SPACE}]"), 1 << 20


def segments(text: str | None) -> list[str | None]:
    """The text, or its parts, whose runs are those of the text."""
    if not text or len(text) <= SEGMENT:
        return [text]
    out, at = [], 0
    while (cut := _CUT.search(text, at + SEGMENT)) is not None:
        out.append(text[at : cut.end() - 1])
        at = cut.end() - 1
    return [*out, text[at:]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        child: dict[int, int] = {}
        token_at, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                below = child.get(key, 0)
                if not below:
                    below = child[key] = len(token_at)
                    token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = below
            token_at[node] = rank
        self.token_at, self.child = np.array(token_at, np.int64), _Table(child)
        self._halve()
        self._fits = _Table()
        self._reset()

    def _reset(self) -> None:
        # a hypothesis: node << 20 | token before + 1; a state's hypotheses stand in ``live`` from at[state] to at[state + 1]
        self.live, self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(self.limit + 2, np.int64), 1
        self.at[1] = 1
        self.number = {self.live[:1].tobytes(): 0}
        self.table = _Table()  # state << 8 | byte -> state << 20 | token that ends the text up to there

    def _halve(self) -> None:
        """The two parts whose merge gives each token, by ascending length; ``own``: whether a token is the encoding of its bytes."""
        n = len(self.lengths)
        self.left, self.right, self.own = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        pairs, by_length = {}, {}
        for token, rank in self.ranks.items():
            if len(token) == 1:
                self.own[rank] = True
                continue
            for i in range(1, len(token)):
                x, y = self.ranks.get(token[:i], -1), self.ranks.get(token[i:], -1)
                if x >= 0 and y >= 0:
                    pairs[x << 20 | y] = rank
                    if x < rank and y < rank:
                        by_length.setdefault(len(token), []).append((x, y, rank))
        self.pairs = _Table(pairs)
        for k in sorted(by_length):
            x, y, whole = np.array(by_length[k], np.int64).T
            good = self.own[x] & self.own[y]
            x, y, whole = x[good], y[good], whole[good]
            good = self._uncrossed(x, y, top=False)
            self.left[whole[good]], self.right[whole[good]], self.own[whole[good]] = x[good], y[good], True

    def _uncrossed(self, x: np.ndarray, y: np.ndarray, top: bool = True) -> np.ndarray:
        """For each two tokens side by side, whether no merge reaches across their border.

        The merges of both are undone, the latest first. Two parts that meet at the border at some time would merge if
        their rank comes before both next merges, of equal ranks the leftmost first. top: the whole tokens count too.
        """
        never = 1 << 40
        x, y, good = x.copy(), y.copy(), np.ones(len(x), bool)
        until_x, until_y, on, first = np.full(len(x), never), np.full(len(x), never), np.arange(len(x)), not top
        while len(on):
            if not first:
                merged = self.pairs.find(x[on] << 20 | y[on])
                crossed = (merged >= 0) & (merged < until_x[on]) & (merged <= until_y[on])
                good[on[crossed]] = False
                on = on[~crossed]
            first = False
            a, b = x[on], y[on]
            undo_x = (self.left[a] >= 0) & ((a > b) | (self.left[b] < 0))
            undo_y = ~undo_x & (self.left[b] >= 0)
            i, j = on[undo_x], on[undo_y]
            until_x[i], until_y[j] = x[i], y[j]
            x[i], y[j] = self.right[x[i]], self.left[y[j]]
            on = on[undo_x | undo_y]
        return good

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: merge the pair of least rank, the leftmost first, until none is left. For tests."""
        never, rank = 1 << 60, self.ranks.get
        cut = list(range(len(data) + 1))
        pair = [rank(data[i : i + 2], never) for i in range(len(data) - 1)]
        while pair:
            best = min(pair)
            if best == never:
                break
            i = pair.index(best)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank(data[cut[i] : cut[i + 2]], never)
            if i:
                pair[i - 1] = rank(data[cut[i - 1] : cut[i + 1]], never)
        return [self.ranks[data[x:y]] for x, y in zip(cut, cut[1:], strict=False)]

    def fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the two are the encoding of their bytes; at a start (-1), whether the token is of its own."""
        out = self.own[token]
        later = np.flatnonzero(out & (before >= 0))
        if len(later):
            keys = before[later] << 20 | token[later]
            known = self._fits.find(keys)
            new = np.unique(keys[known < 0])
            if len(new):
                if self._fits.used + len(new) > len(self._fits.keys) // 2:
                    self._fits = _Table()
                    new = np.unique(keys)
                self._fits.add(new, self._uncrossed(new >> 20, new & 0xFFFFF).astype(np.int64))
                known = self._fits.find(keys)
            out[later] = known == 1
        return out

    def _advance(self, keys: np.ndarray) -> np.ndarray:
        """Steps (state << 8 | byte, all different) that weren't needed before: all hypotheses read the byte; exactly one token ends the text so far."""
        state, byte = keys >> 8, keys & 255
        sizes = self.at[state + 1] - self.at[state]
        h = gather(self.live, self.at[state], sizes)
        row = np.repeat(np.arange(len(keys)), sizes)
        node = self.child.find(h >> 20 << 8 | byte[row])
        here = node >= 0
        row, node, last = row[here], node[here], h[here] & 0xFFFFF
        token = self.token_at[node]
        ends = np.flatnonzero(token >= 0)
        ends = ends[self.fits(last[ends] - 1, token[ends])]
        done = np.full(len(keys), -1, np.int64)
        done[row[ends]] = token[ends]
        if (done < 0).any():
            raise ValueError("a byte of the text is no token of the vocabulary")
        # the state reached: what is still alive, and the start of a token after the one that ends here
        counts = np.bincount(row, minlength=len(keys)) + 1
        stops = np.cumsum(counts)
        live = np.empty(int(stops[-1]), np.int64)
        live[stops - 1] = done + 1
        live[np.arange(len(row)) + row] = node << 20 | last
        raw, to, bounds = live.tobytes(), [], (8 * stops).tolist()
        for a, b in zip([0, *bounds], bounds, strict=False):
            name = raw[a:b]
            n = self.number.get(name)
            if n is None:
                n = self.number[name] = self.count
                start, size = int(self.at[n]), (b - a) // 8
                if start + size > len(self.live):
                    self.live = np.concatenate([self.live, np.zeros(len(self.live) + size, np.int64)])
                if n + 2 >= len(self.at):
                    self.at = np.concatenate([self.at, np.zeros(len(self.at), np.int64)])
                self.live[start : start + size] = live[a // 8 : b // 8]
                self.at[n + 1] = start + size
                self.count += 1
            to.append(n)
        found = np.array(to, np.int64) << 20 | done
        self.table.add(keys, found)
        return found

    def _step(self, keys: np.ndarray) -> np.ndarray:
        found = self.table.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            several, back = np.unique(keys[new], return_inverse=True)
            found[new] = self._advance(several)[back]
        return found

    def _renew(self) -> None:
        if self.count > self.limit or self.table.used > 4 * self.limit:
            self._reset()

    def _agreed(self, ends: list[int], state: int) -> int:
        """How many of the bytes read lie in tokens that all live hypotheses share."""
        heads = {len(ends) - self.depth[h >> 20] for h in self.live[self.at[state] : self.at[state + 1]].tolist()}
        while len(heads) > 1:
            last = max(heads)
            heads = (heads - {last}) | {last - self.length[ends[last - 1]]}
        return heads.pop()

    def _trace(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= self.length[token]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """One piece of any length, a window of bytes at a time."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, ends, short = 0, [], [], {}
        for b in piece:
            found = short.get(state << 8 | b)
            if found is None:
                if len(short) > self.limit:
                    short.clear()
                found = short[state << 8 | b] = int(self._step(np.array([state << 8 | b]))[0])
            state = found >> 20
            ends.append(found & 0xFFFFF)
            if len(ends) > WINDOW:
                sure = self._agreed(ends, state)
                out += self._trace(ends, sure)
                ends = ends[sure:]
        out += self._trace(ends, len(ends))
        self._renew()
        return out

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces of WINDOW bytes at most, how many each has): all pieces step together, by whole-array lookups."""
        self._renew()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        text = np.frombuffer(b"".join(pieces[i].ljust(longest, b"\0") for i in order.tolist()), np.uint8).reshape(len(pieces), longest).T.astype(np.int64)
        ends = np.zeros((longest, len(pieces)), np.int64)
        state = np.zeros(len(pieces), np.int64)
        for i in range(longest):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # those longer than i
            found = self._step(state[:n] << 8 | text[i, :n])
            state[:n] = found >> 20
            ends[i, :n] = found & 0xFFFFF
        at, rows, out = sizes.copy(), np.arange(len(pieces)), []
        while len(rows):
            rows = rows[at[rows] > 0]
            column = np.full(len(pieces), -1, np.int32)
            column[rows] = token = ends[at[rows] - 1, rows]
            at[rows] -= self.lengths[token]
            out.append(column)
        if not out:
            return np.empty(0, np.int32), np.zeros(len(pieces), np.int64)
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))
        ids = np.stack(out[::-1], axis=1)[place]
        held = ids >= 0
        return ids[held].astype("<i4"), held.sum(axis=1)


class _Table:
    """Numbers by number, as two arrays with open addresses; at most half of them are used."""

    def __init__(self, known: dict[int, int] | None = None, size: int = 1 << 20):
        while known and 2 * len(known) > size:
            size *= 2
        self.mask = size - 1
        self.keys, self.values, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
        if known:
            self.add(np.fromiter(known, np.int64, len(known)), np.fromiter(known.values(), np.int64, len(known)))

    def _place(self, keys):
        return (keys * 0x9E3779B1 >> 7) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1."""
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are all different and not there; of those that want one place the first gets it, the others move on."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            k, v, size = self.keys[old], self.values[old], 2 * len(self.keys)
            self.mask, self.keys, self.values, self.used = size - 1, np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
            self.add(k, v)
            return self.add(keys, values)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at[left]] < 0)
            _, first = np.unique(at[left[free]], return_index=True)
            got = left[free[first]]
            self.keys[at[got]], self.values[at[got]] = keys[got], values[got]
            waits = np.ones(len(left), bool)
            waits[free[first]] = False
            left = left[waits]
            at[left] = (at[left] + 1) & self.mask
        self.used += len(keys)
        return None


class Utf8:
    """UTF-8 read byte by byte: ``feed`` gives the text that is complete and keeps the bytes of a character begun."""

    #: First byte -> (bytes that follow, range of the first of them), by the definition of UTF-8.
    _LEAD = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)} | {b: (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)}

    def __init__(self):
        self.pending = b""

    def feed(self, data: bytes) -> str:
        out, pending = [], self.pending
        for b in data:
            while True:
                if not pending:
                    if b < 0x80:
                        out.append(chr(b))
                    elif b in self._LEAD:
                        pending = bytes([b])
                    else:
                        out.append("�")
                    break
                more, low, high = self._LEAD[pending[0]]
                if not (low <= b <= high if len(pending) == 1 else 0x80 <= b <= 0xBF):
                    out.append("�")  # the character broke off; the byte starts anew
                    pending = b""
                    continue
                pending += bytes([b])
                if len(pending) == more + 1:
                    out.append(pending.decode())
                    pending = b""
                break
        self.pending = pending
        return "".join(out)

    def finish(self) -> str:
        out, self.pending = "�" if self.pending else "", b""
        return out


class Coder:
    """Texts to ids and back, for one vocabulary and pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.machine = Transducer(self.ranks)
        self.pattern = regex.compile(pattern)
        self.plain = pattern == public_tokenizers.PATTERN
        self.bytes_of = self.machine.bytes_of
        self.memory = Memory(self.learn, PIECES, "<i4")
        # the bytes of all tokens in one array, and whether each is whole characters
        self.sizes = self.machine.lengths
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(self.sizes))), np.uint8)
        self.broken = np.ones(len(self.sizes), bool)
        for token, data in self.bytes_of.items():
            try:
                data.decode()
                self.broken[token] = False
            except UnicodeDecodeError:
                pass

    def pieces(self, run: str) -> list[bytes]:
        """The pattern's matches in a run. It takes letters and then marks, so plain words need no regular expression."""
        if self.plain:
            word = run.rstrip(".,;:!?*$%&#|")
            if word.isalpha() or word[:1] == " " and word[1:].isalpha():
                data = run.encode()
                n = len(run) - len(word)
                return [data[:-n], data[-n:]] if n else [data]
        return [x.encode("utf-8", "replace") for x in self.pattern.findall(run)]

    def learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of runs, how many each has)."""
        number: dict[bytes, int] = {}
        split = [[number.setdefault(p, len(number)) for p in self.pieces(run)] for run in runs]
        pieces = list(number)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        flat, counts = [whole[whole >= 0]], (whole >= 0).astype(np.int64)
        at = np.cumsum(counts) - counts
        rest = np.flatnonzero(whole < 0)
        long = [i for i in rest.tolist() if len(pieces[i]) > LOCKSTEP]
        rest = np.array([i for i in rest.tolist() if len(pieces[i]) <= LOCKSTEP], np.int64)
        parts = [(rest[k : k + 20_000], *self.machine.encode_many([pieces[i] for i in rest[k : k + 20_000].tolist()])) for k in range(0, len(rest), 20_000)]
        parts += [(np.array([i]), ids, np.array([len(ids)])) for i in long for ids in (np.array(self.machine.encode(pieces[i]), np.int64),)]
        before = len(flat[0])
        for i, ids, n in parts:
            flat.append(ids)
            counts[i], at[i] = n, before + np.cumsum(n) - n
            before += len(ids)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        every = np.fromiter(itertools.chain.from_iterable(split), np.int64, int(sizes.sum()))
        sums = np.concatenate([[0], np.cumsum(counts[every])])[np.concatenate([[0], np.cumsum(sizes)])]
        return gather(np.concatenate(flat).astype("<i4"), at[every], counts[every]), np.diff(sums)

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        if any(t and len(t) > SEGMENT for t in texts):
            cut = [segments(t) for t in texts]
            ids, counts = self.encode_many_short(list(itertools.chain.from_iterable(cut)))
            return ids, np.add.reduceat(counts, np.cumsum([0, *map(len, cut[:-1])]))
        return self.encode_many_short(texts)

    def encode_many_short(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same, for texts whose runs may be held at once."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each collection would walk the memory
        try:
            parts = list(in_groups(texts, lambda t: _RUNS.findall(t) if t else [], self.memory))
        finally:
            if collecting:
                gc.enable()
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.empty(0, "<i4"), np.empty(0, np.int64))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each run of ids. Tokens of whole characters are their bytes; the others go through the machine, which must
        complete each character with tokens of that kind, else the whole text is streamed through it. An id that no token has is an error."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes) and self.sizes[ids].all()):
            raise ValueError("an id that the vocabulary doesn't have")
        sizes = self.sizes[ids]
        data = gather(self.blob, self.starts[ids], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        at = np.flatnonzero(self.broken[ids])
        text_of = np.repeat(np.arange(len(counts)), counts)[at] if len(at) else at
        odd, machine, before, clean = set(), Utf8(), (-2, -1), {}
        for k, (i, t) in enumerate(zip(at.tolist(), text_of.tolist(), strict=True)):
            if (i - 1, t) != before:  # a new run of such tokens begins
                if machine.pending:
                    odd.add(before[1])
                machine.pending = b""
            key = (machine.pending, int(ids[i]))
            step = clean.get(key)
            if step is None:
                text = machine.feed(self.bytes_of[key[1]])
                step = clean[key] = (machine.pending, "\ufffd" in text and "\ufffd".encode() not in key[0] + self.bytes_of[key[1]])
            machine.pending, wrong = step
            if wrong:
                odd.add(t)
            before = (i, t)
        if machine.pending:
            odd.add(before[1])
        if not odd:
            return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
        stops = np.cumsum(counts).tolist()
        streamed = {t: self.stream(ids[a:b].tolist()) for t, (a, b) in enumerate(zip([0, *stops], stops, strict=False)) if t in odd}
        raw = data.tobytes()
        return pa.array([streamed[t] if t in odd else raw[a:b].decode() for t, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))], pa.string())

    def stream(self, ids: list[int]) -> str:
        machine = Utf8()
        return "".join([machine.feed(self.bytes_of[i]) for i in ids]) + machine.finish()

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0].as_py()


@functools.cache
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def encoder(path: str, pattern: str):
    """A column function text -> array of ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        ids, counts = coder(path, pattern).encode_many(texts.to_pylist())
        return _lists(ids, counts)

    return encode.asNondeterministic()


def decoder(path: str, pattern: str):
    """A column function array of ids -> text; null stays null."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        c = coder(path, pattern)
        return pa.array([None if x is None else c.decode(x) for x in (None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).tolist() for v in ids)], pa.string())

    return decode.asNondeterministic()


def with_ids(docs: DataFrame, path: str, pattern: str, name: str = "ids") -> DataFrame:
    return docs.withColumn(name, encoder(path, pattern)(F.col("text")))


def round_trip(docs: DataFrame, keep: list[str], path: str, pattern: str) -> DataFrame:
    """``keep``, ids and decoded (the text that the ids give), in one pass that holds few rows at a time."""
    own = docs.select(*keep).schema
    if {"ids", "decoded"} & set(own.names):
        raise ValueError("ids and decoded are columns of the result")

    def code(batches):
        c = coder(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids, counts = c.encode_many(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(ids, counts), c.decode_many(ids, counts)], [*own.names, "ids", "decoded"])
        give_back()

    schema = T.StructType([*own.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(*keep, F.col("text").alias("turnwise_text")).mapInArrow(code, schema)
