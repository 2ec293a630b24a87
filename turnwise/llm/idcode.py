"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart.

The more frequent an id in all documents, the smaller its rank, and the fewer bytes hold it: two bits of a control
byte say how many (1 to 4) for each of four ids; control bytes stand before the data bytes of a block. Reading is
table lookup by numpy: a control byte gives four lengths, their sums give places, and up to four gathers the values.

``write_ids`` tokenises once into a table in the shared folder, counts ids over all of it (the result is bounded by the
vocabulary), then writes the files in ascending order of the id: ranges of ids are sorted apart and each task writes one file.
``read_ids`` reads them back and adds where each document starts.

Texts are cut into words by whole-array operations, a few megabytes at a time; each different word of those is looked up once in a bounded memory
of words met before, and new ones are encoded. This is exact because the vocabulary drops white space before it splits (``Tokens`` is tested against whole texts).

Defined cases: a null or empty text has only the end id; a null doc_id comes first; rows of one id stand together, in the
order of their ids' bytes; an empty table gives no files; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import itertools
import operator
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.llm.common import materialize, scratch, shared_dir
from turnwise.llm.memory import Memory, gather
from turnwise.llm.store import Reader, Writer

MAGIC = b"TWIDS001"
_id = operator.attrgetter("id")
#: Ids of a block, about; a longer document is a block by itself.
BLOCK_IDS = 1 << 16
#: Words that are kept; beyond them the older half goes. Only speed depends on it.
WORDS = 250_000
FILES = "part int, file string, size bigint, docs bigint, ids bigint"
#: Bytes of texts that are coded at a time, about; a longer text is coded by itself.
GROUP_BYTES = 1 << 22
#: A Latin letter in UTF-8, lower or beyond ASCII; an ASCII mark (``<`` may begin a special token's name).
_LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_MARK = rb"[!-/:;=-@\[-`{-~]"
#: What the vocabulary makes of a piece of such letters, marks and digits before it merges.
_PARTS = re.compile(rb"'(?:[stmd]|re|ve|ll)|%s+|[0-9]|%s+" % (_LETTER, _MARK))
#: The same by byte: 1 for white space, 2 for letters of ASCII, 3 for marks.
_MARKS = [x for x in range(33, 127) if not chr(x).isalnum()]
_CLASS = bytes(1 if x in b" \t\n\x0b\x0c\r" else 3 if x in _MARKS else 2 if x < 128 and chr(x).isalpha() else 0 for x in range(256))
#: The byte-level spelling: visible Latin-1 characters stand for their byte, the others for the characters from 256 on, in order.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}
_SPELLING = "".join(chr(_SPELLING.get(b, b)) for b in range(256)).replace(chr(256 + 10), "\n", 1)


def pieces(texts: pa.Array, fold: bool) -> tuple[pa.Array, np.ndarray]:
    """(pieces in UTF-8 whose ids one after the other are the texts', at which piece each text begins and their end).

    White space always parts pieces. For a vocabulary that is lower case and splits letters from marks (``fold``), A-Z are lowered, except before what may combine, and a mark
    after a Latin letter begins a piece, so that fewer different pieces occur; texts that may name special tokens stay as they are.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    raw = (texts.buffers()[2] or pa.py_buffer(b"")).slice(at[0], at[-1] - at[0]).to_pybytes()
    data, kinds, at = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_CLASS), np.uint8), at - at[0]
    space = kinds == 1
    begins = np.ones(len(data), bool)  # whether a piece begins at a byte
    begins[1:] = space[:-1]
    begins[at[at < len(data)]] = True
    if fold:
        lowered, parts = np.frombuffer(raw.lower(), np.uint8).copy(), kinds == 3
        kept = np.flatnonzero(data[1:] >= 0xC4)  # before what may be a combining character: h with a line below is one letter, H is not
        lowered[kept] = data[kept]
        after = kinds == 2
        after[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        parts[1:] &= after[:-1]
        if b"<|" in raw:
            special = np.repeat(pc.match_substring(texts, b"<|").to_numpy(zero_copy_only=False), np.diff(at))
            parts &= ~special
            lowered = np.where(special, data, lowered)
        begins |= parts
        data = lowered
    solid = ~space
    begins &= solid
    first = np.searchsorted(np.flatnonzero(begins), at)
    data = data[solid]
    starts = np.append(np.flatnonzero(begins[solid]), len(data))
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]), first


def _spelled(words: list[bytes]) -> list[str]:
    """Lowered words with a character for each byte."""
    return b"\n".join(words).decode().lower().encode().decode("latin-1").translate(_SPELLING).split("\n") if words else []


class Tokens:
    """A tokenizer file with a memory of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        # whether the vocabulary folds case and parts marks from letters is seen from what it does
        probe = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        after = [*map(chr, _MARKS), "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'x", ".'s"]
        self.fold = probe("AZ") == probe("az") and all(probe(a + m) == probe(a.lower()) + probe(m) for a in ("z", "Mz", "\u00e9") for m in after)
        if probe("ab cd") != probe("ab") + probe("cd") or probe(" \t\n"):
            raise ValueError(f"{path} doesn't drop white space before it splits: texts can't be encoded word by word")
        #: the parts of plain pieces can go to the vocabulary's model itself: the steps before it only part, lower and spell them
        asked = ("seen", "being", "ÀÉ", "çaßÿ", "Øþ", "internationally", "a1b22", "'tis", "'relay", "it's", "o'clock", "!'s", "x''ll", "(a)-[b]", "''d", "1.5%", "re!%re", *map(chr, _MARKS))
        self.direct = self.fold and all([t.id for p in _spelled(_PARTS.findall(w.encode())) for t in self.tokenizer.model.tokenize(p)] == probe(w) for w in asked if "<" not in w)
        self.memory = Memory(self.learn, WORDS, self.kind)

    def learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces, how many each has): the parts of plain ones by the model, others through the whole tokenizer together, with blanks between."""
        short = np.fromiter(map(bytes.isalpha, new), bool, len(new)) & np.fromiter(map(bytes.islower, new), bool, len(new)) & self.direct  # letters of ASCII alone
        longer, parts, rest = np.flatnonzero(~short).tolist(), [], []
        for i in longer:
            found = _PARTS.findall(new[i]) if self.direct else ()
            parts.append(found if sum(map(len, found)) == len(new[i]) else ())
            if not parts[-1]:
                rest.append(new[i].decode())
        asked = [w.decode() for w in itertools.compress(new, short.tolist())] + _spelled(list(itertools.chain.from_iterable(parts)))
        done = [self._merged(asked[at : at + 5_000]) for at in range(0, len(asked), 5_000)] + [self._whole(rest[at : at + 20_000]) for at in range(0, len(rest), 20_000)]
        ids, counts = zip(*done, strict=True) if done else ([np.empty(0, self.kind)], [np.empty(0, np.int64)])
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        # each piece's place in ids: pieces of ASCII letters, of parts, of the rest stand one after the other
        kinds = np.zeros(len(new), np.int8)
        kinds[longer] = [1 if p else 2 for p in parts]
        order = np.argsort(kinds, kind="stable")
        held = np.ones(len(new), np.int64)
        held[longer] = [len(p) or 1 for p in parts]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(held[order])])]
        at, size = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        at[order], size[order] = ends[:-1], np.diff(ends)
        return gather(ids, at, size), size

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.tokenizer.model.tokenize, words))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(map(_id, itertools.chain.from_iterable(found)), self.kind, int(counts.sum())), counts

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)  # blanks part them, and offsets say whose an id is
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        ends = np.searchsorted(np.fromiter((x for x, _ in coded.offsets), np.int64, len(coded)), starts)
        return np.array(coded.ids, self.kind), np.diff(ends)

    def coded(self, texts: pa.Array, end: int):
        """For some texts at a time, in order: (their ids, the end id after each; at which id each text begins, and their end)."""
        sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, "right")))
            found, first = pieces(texts.slice(at, to - at), self.fold)
            coded = found.dictionary_encode()
            ids, bounds = self.memory.take(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy())
            bounds = bounds[first]
            yield np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))
            at = to

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each text and the end id, as bytes of ``kind``."""
        data = pa.array([None if t is None else t.encode("utf-8", "replace") for t in texts], pa.large_binary())
        return [ids[x:y].tobytes() for ids, bounds in self.coded(data, end) for x, y in zip(bounds, bounds[1:], strict=False)]


@contextlib.contextmanager
def _no_collection():
    """Nothing here is cyclic, and each collection would walk the memory."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


@functools.cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


# four lengths of a control byte
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes)."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        at = np.flatnonzero(lengths > k)
        if not len(at):
            break
        out[at] |= raw[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _block(docs: list[tuple[int | None, np.ndarray]], rank: np.ndarray) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    control, data = pack(rank[ids])
    names = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], np.uint8).tobytes()
    return struct.pack("<IQQQ", len(docs), len(ids), len(control), len(data)) + names + np.array([len(x) for _, x in docs], "<u8").tobytes() + control + data


def write_ids(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None) -> tuple[str, DataFrame, np.ndarray]:
    """(folder, table of files, id of each rank)."""
    folder = folder or shared_dir(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        files, by_rank = _files(docs, tokenizer, end, folder)
        return folder, keep(files), by_rank


def _files(docs: DataFrame, tokenizer: str, end: int, folder: str) -> tuple[DataFrame, np.ndarray]:
    """The files are written when the table of them is read; it is read once."""
    spark = docs.sparkSession
    kind, size = tokens(tokenizer).kind, tokens(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True)

    def code(batches):
        t, n = tokens(tokenizer), np.zeros(size, np.int64)
        with _no_collection():
            for b in batches:
                at = 0
                for ids, bounds in t.coded(b["text"], end):
                    n += np.bincount(ids, minlength=size)
                    docs, bounds = b["doc_id"].slice(at, len(bounds) - 1), bounds * kind.itemsize
                    if bounds[-1] >= 1 << 31:
                        raise ValueError("a text has too many ids for one value of a table")
                    at += len(docs)
                    data = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([docs, data, pa.nulls(len(docs), pa.binary())], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([n.tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    written = materialize(docs.select("doc_id", "text").mapInArrow(code, "doc_id bigint, ids binary, counts binary"))  # a row of counts from each task
    coded = written.where(F.col("ids").isNotNull()).select("doc_id", "ids")

    def count(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            for x in b["counts"]:
                n += np.frombuffer(x.as_buffer(), np.int64)
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["id", "n"])

    totals = np.zeros(size, np.int64)
    for r in written.where(F.col("counts").isNotNull()).select("counts").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        totals[r["id"]] = r["n"]
    by_rank = np.lexsort((np.arange(size), -totals)).astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def write(batches):
        out, held, ids, docs_n, ids_n = None, [], 0, 0, 0
        for b in batches:
            for doc, x in zip(b["doc_id"].to_pylist(), b["ids"], strict=True):
                if out is None:
                    out = Writer(folder, f"ids-{TaskContext.get().partitionId():06d}", ".bin")
                    out.write(MAGIC)
                held.append((doc, np.frombuffer(x.as_py(), kind)))
                ids += len(held[-1][1])
                docs_n, ids_n = docs_n + 1, ids_n + len(held[-1][1])
                if ids >= BLOCK_IDS:
                    out.write(_block(held, shared.value))
                    held, ids = [], 0
        if out is not None:
            if held:
                out.write(_block(held, shared.value))
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": out.name, "size": out.size, "docs": docs_n, "ids": ids_n}], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("size", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = coded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(write, FILES), by_rank


def read_ids(spark: SparkSession, folder: str, files: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before) and ids (unsigned 32-bit little-endian), from the files."""
    placed = files.withColumn("start", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each file
    shared = spark.sparkContext.broadcast(by_rank)

    def read(batches):
        reader = Reader(folder)
        for b in batches:
            for f in b.to_pylist():
                start, at = f["start"], len(MAGIC)
                if reader.read(f["file"], 0, at) != MAGIC:
                    raise ValueError(f"{f['file']} is no file of ids")
                while at < f["size"]:
                    docs, n, c, d = struct.unpack("<IQQQ", reader.read(f["file"], at, 28))
                    raw = reader.read(f["file"], at + 28, 17 * docs + c + d)
                    at += 28 + 17 * docs + c + d
                    counts = np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64)
                    body = 17 * docs
                    ids = shared.value[unpack(raw[body : body + c], raw[body + c :], n)].astype("<u4").tobytes()
                    ends = np.cumsum(counts)
                    names = pa.array(np.frombuffer(raw, "<i8", docs).copy(), mask=np.frombuffer(raw, np.uint8, docs, 8 * docs) != 0)
                    yield pa.RecordBatch.from_arrays([names, pa.array(start + ends - counts), pa.array([ids[4 * (e - k) : 4 * e] for e, k in zip(ends, counts, strict=True)], pa.binary())], ["doc_id", "start", "ids"])
                    start += n
        reader.close()

    return placed.repartition(max(1, files.count())).mapInArrow(read, "doc_id bigint, start bigint, ids binary")
