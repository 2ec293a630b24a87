"""Media columns: TIFF files in a binary column, read to one row per page.

``pages`` walks the image directories (either byte order, classic or 64-bit offsets, a cycle ends the walk), decodes strips or
tiles that are stored plain, by PackBits, LZW or deflate, undoes the horizontal and the floating-point predictor, and joins planes; samples of 1, 2 or 4 bits become a byte each.
``encode`` writes the same forms, for round trips. ``read_pages`` is the Spark operator.

Row by row: no shuffle, no skew; output leaves a task in pieces of bounded size.

Defined cases: a null media value gives no page; bytes that aren't a TIFF file, or a page that can't be decoded, give
one row with ``error`` and no samples, and the walk goes on with the next page; columns to keep are named, others are dropped; a page
column whose name is kept already gets the prefix ``tiff_``; repeated rows give repeated pages, an empty table no page; files of any length are read whole.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tag numbers, field types and compression numbers of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIP_OFFSETS, BANDS, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT, FILL_ORDER = 322, 323, 324, 325, 339, 266
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Bytes of samples after which a batch of rows is handed on.
FLUSH = 8 << 20


class Page(NamedTuple):
    page: int
    width: int
    height: int
    bands: int
    bits: int
    description: str | None
    samples: np.ndarray  # height x width x bands


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


_CLEAR, _END = 256, 257


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first, the width growing one code early."""
    out, table, last, width, held, have = [], [], None, 9, 0, 0
    for byte in data:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have & ((1 << width) - 1)
        if code == _END:
            break
        if code == _CLEAR:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], None, 9
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, have, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, have
        held, have = held << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
        held &= (1 << have) - 1

    table = {bytes([i]): i for i in range(256)}
    put(_CLEAR)
    size, prefix = 258, b""
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix])
        table[longer] = size
        size += 1
        if size == 4094:
            put(_CLEAR)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif size >= 1 << width:
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    put(_END)
    if have:
        out.append(held << (8 - have) & 255)
    return bytes(out)


#: What reading a damaged file may raise.
BROKEN = (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, struct.error, zlib.error, OverflowError, MemoryError)
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
DECODE = {PLAIN: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}
ENCODE = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list] | Exception]]:
    """(byte order, tag -> values, or why they can't be read) of each image directory in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    version = struct.unpack_from(order + "H", data, 2)[0]
    if version not in (42, 43):
        raise ValueError(f"TIFF version {version}")
    big = version == 43
    count, word, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
    at = struct.unpack_from(order + word, data, 8 if big else 4)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        first, tags = at + struct.calcsize("<" + count), {}
        try:
            for i in range(n):
                tag, kind, number = struct.unpack_from(order + "HH" + word, data, first + i * entry)
                form = FIELD.get(kind)
                if form is None:
                    continue
                where = first + i * entry + 4 + struct.calcsize("<" + word)
                total = struct.calcsize("<" + form) * number
                if total > struct.calcsize("<" + word):
                    where = struct.unpack_from(order + word, data, where)[0]
                if form != "s" and where + total > len(data):
                    raise ValueError(f"tag {tag} goes beyond the file")
                tags[tag] = [data[where : where + number]] if form == "s" else list(struct.unpack_from(order + form * number, data, where))
        except BROKEN as e:
            yield order, e
            if first + n * entry + struct.calcsize("<" + word) > len(data):
                return
        else:
            yield order, tags
        at = struct.unpack_from(order + word, data, first + n * entry)[0]


def _block(raw: bytes, order: str, tags: dict, shape: tuple[int, int, int], bits: int) -> np.ndarray:
    real, size, (rows, width, deep) = tags.get(SAMPLE_FORMAT, [1])[0] == 3, bits // 8, shape
    if real and bits < 16:
        raise ValueError(f"{bits} bits for a floating-point sample")
    form, predictor = tags.get(COMPRESSION, [PLAIN])[0], tags.get(PREDICTOR, [1])[0]
    if form not in DECODE:
        raise ValueError(f"compression {form}")
    if bits < 8:  # rows begin at whole bytes; each sample becomes a byte
        if predictor != 1:
            raise ValueError(f"predictor {predictor} for {bits} bits")
        across = -(-width * deep * bits // 8)
        packed = np.frombuffer(DECODE[form](raw.translate(_MIRROR) if tags.get(FILL_ORDER, [1])[0] == 2 else raw), np.uint8, count=rows * across).reshape(rows, across)
        split = np.unpackbits(packed, axis=1)[:, : width * deep * bits].reshape(rows, width * deep, bits)
        return (np.packbits(split, axis=2) >> (8 - bits)).reshape(shape)
    if predictor == 3 and real:  # sums of bytes, then planes of bytes, the most significant first in either order
        summed = np.cumsum(np.frombuffer(DECODE[form](raw), np.uint8, count=rows * width * deep * size).reshape(rows, width * size, deep), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(summed.reshape(rows, size, width * deep).transpose(0, 2, 1)).view(f">f{size}").reshape(shape)
    kind = np.dtype(f"{order}{'f' if real else 'u'}{size}")
    values = np.frombuffer(DECODE[form](raw), kind, count=rows * width * deep).reshape(shape)
    if predictor == 2 and kind.kind == "u":
        values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))  # wraps as it must
    elif predictor != 1:
        raise ValueError(f"predictor {predictor}")
    return values


def _page(data: bytes, index: int, order: str, tags: dict) -> Page:
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    bands, bits = tags.get(BANDS, [1])[0], tags.get(BITS, [1])[0]
    if bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError(f"{bits} bits for a sample")
    apart = tags.get(PLANAR, [1])[0] == 2 and bands > 1
    deep = 1 if apart else bands
    tiled = TILE_OFFSETS in tags
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_SIZES])
    w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(STRIP_ROWS, [height])[0]))
    across, down = -(-width // w), -(-height // h)
    planes = []
    for plane in range(bands if apart else 1):
        out = None
        for k in range(across * down):
            y, x = k // across * h, k % across * w
            rows = h if tiled else min(h, height - y)
            at = plane * across * down + k
            block = _block(data[offsets[at] : offsets[at] + sizes[at]], order, tags, (rows, w, deep), bits)
            if out is None:
                out = np.empty((height, width, deep), block.dtype.newbyteorder("="))
            out[y : y + rows, x : x + w] = block[: height - y, : width - x]
        planes.append(out)
    text = tags.get(DESCRIPTION, [None])[0]
    return Page(index, width, height, bands, bits, None if text is None else bytes(text).rstrip(b"\0").decode("utf-8", "replace"), np.concatenate(planes, axis=2))


def walk(data: bytes) -> Iterator[tuple[int | None, Page | Exception]]:
    """(number, page or why it can't be read) of each directory. A chain that breaks off is one more; what is no TIFF file has no number."""
    chain = directories(data)
    for index in itertools.count():
        try:
            order, tags = next(chain)
        except StopIteration:
            return
        except BROKEN as e:
            yield index or None, e
            return
        try:
            found = tags if isinstance(tags, Exception) else _page(data, index, order, tags)
        except BROKEN as e:
            found = e
        yield index, found


def pages(data: bytes) -> Iterator[Page]:
    """All pages; the first that can't be read raises its error."""
    for _, page in walk(data):
        if isinstance(page, Exception):
            raise page
        yield page


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = 64, tile: tuple[int, int] | None = None, order: str = "<", descriptions: list[str] | None = None) -> bytes:
    """Images (height x width [x bands], unsigned 8 or 16 bits) as pages of one classic file."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for number, image in enumerate(images):
        a = image if image.ndim == 3 else image[:, :, None]
        height, width, bands = a.shape
        h, w = tile or (strip_rows, width)
        offsets, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = a[y : y + h, x : x + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = ENCODE[compression](part.astype(part.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        out += b"\0" * (len(out) % 2)
        tags = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [8 * a.dtype.itemsize] * bands), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1]), BANDS: ("H", [bands]), PREDICTOR: ("H", [predictor])}
        tags |= {TILE_WIDTH: ("I", [w]), TILE_HEIGHT: ("I", [h]), TILE_OFFSETS: ("I", offsets), TILE_SIZES: ("I", sizes)} if tile else {STRIP_ROWS: ("I", [h]), STRIP_OFFSETS: ("I", offsets), STRIP_SIZES: ("I", sizes)}
        if descriptions:
            tags[DESCRIPTION] = ("s", [descriptions[number].encode() + b"\0"])
        entries = []
        for tag, (form, values) in sorted(tags.items()):
            raw = values[0] if form == "s" else struct.pack(order + form * len(values), *values)
            n = len(raw) if form == "s" else len(values)
            if len(raw) > 4:
                where = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                where = raw.ljust(4, b"\0")
            entries.append(struct.pack(order + "HHI", tag, {"s": 2, "H": 3, "I": 4}[form], n) + where)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_image(text: str | None, width: int) -> tuple[np.ndarray, int]:
    """UTF-8 bytes as rows of 8-bit samples, padded by 255 to whole rows, one at least; and the bytes before padding."""
    data = (text or "").encode("utf-8", "replace")
    rows = max(1, -(-len(data) // width))
    return np.frombuffer(data.ljust(rows * width, b"\xff"), np.uint8).reshape(rows, width), len(data)


def text_encoder(width: int = 576, compression: int = DEFLATE, predictor: int = 2):
    """A column function text -> a TIFF file whose one page holds it; the description has the number of bytes."""

    @F.arrow_udf(T.BinaryType())
    def stored(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            image, n = text_image(t.as_py(), width)
            out.append(encode([image], compression, predictor, descriptions=[f"n_bytes={n}"]))
        return pa.array(out, pa.binary())

    return stored.asNondeterministic()


def signature(samples: np.ndarray) -> str:
    """64 bits, which of 64 equal stretches of the page are brighter than its mean, and the mean in thousandths."""
    flat = samples.reshape(-1)
    edges = np.linspace(0, flat.size, 65).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    part, size = total[edges[1:]] - total[edges[:-1]], np.maximum(1, edges[1:] - edges[:-1])
    bits = part * flat.size > int(total[-1]) * size
    return f"{np.packbits(bits).tobytes().hex()}-{int(total[-1]) * 1000 // max(1, flat.size)}"


PAGE_COLUMNS = "page int, width int, height int, bands int, bits int, description string, samples binary, feature string, error string"


def read_pages(media: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``keep`` and PAGE_COLUMNS: a row for each page of the TIFF files in ``column``."""
    source = media.select(*keep, F.col(column).alias("turnwise_media"))
    fields = [T.StructField(f"tiff_{f.name}" if f.name in keep else f.name, f.dataType) for f in T._parse_datatype_string(PAGE_COLUMNS).fields]
    names = [f.name for f in fields]

    def read(batches):
        for b in batches:
            rows, at, held = [], [], 0
            for i, data in enumerate(b["turnwise_media"]):
                if not data.is_valid:
                    continue
                for number, p in walk(data.as_py()):
                    try:
                        if isinstance(p, Exception):
                            raise p
                        rows.append((p.page, p.width, p.height, p.bands, p.bits, p.description, p.samples.tobytes(), signature(p.samples), None))
                        held += len(rows[-1][6])
                    except BROKEN as e:
                        rows.append((number, *[None] * 7, f"{type(e).__name__}: {e}"[:200]))
                    at.append(i)
                if held > FLUSH:
                    yield _batch(b, rows, at)
                    rows, at, held = [], [], 0
            if rows:
                yield _batch(b, rows, at)

    kinds = [pa.int32()] * 5 + [pa.string(), pa.binary(), pa.string(), pa.string()]

    def _batch(b, rows, at):
        own = b.take(pa.array(at, pa.int64())).columns[:-1]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*b.schema.names[:-1], *names])

    schema = T.StructType([*media.select(*keep).schema.fields, *fields])
    return source.mapInArrow(read, schema)
