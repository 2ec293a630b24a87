"""WARC archives with a two-level capture index.

``write_archive`` sorts captures by reversed-host URL key, so that each task writes one run of keys: an archive of one gzip
member for each record, and beside it an index file whose lines (key, id, offset, length) stand in compressed
blocks of BLOCK lines. A sparse directory at the end of the index file has the first key and place of every
block; a table of parts has the first key and the files of each part. ``lookup`` searches parts, directory and block by
halves and then reads byte ranges; ``fetch`` does so for a table of keys, a task for each part, and reads neighbours in one range.
``read_archive`` goes through all blocks and reads the records of each in one range.

Records of equal payloads of MIN_DEDUP bytes or more: that with the largest id is a response, others refer to it. The largest id
of a payload is found by a grouped maximum over (digest, id) only, which sums up before it is dealt out; payloads of
revisits are not written.

Defined cases: a null payload is empty; a null URL has the key "-"; a null id is less than any other, and is written
as "null"; rows equal in payload and id to the response are responses too; an empty table gives an archive without parts;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import materialize, scratch, shared_dir
from turnwise.llm.store import Reader, Writer

MIN_DEDUP = 1000
BLOCK = 256
#: Slots of digests: at most so many numbers are broadcast.
SLOTS = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PARTS = "first_key string, last_key string, archive string, index string, directory_at bigint, directory_size bigint, records bigint"
RECORDS = "key string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``; what isn't a URL is its own key."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.regexp_replace(F.when(url.isNull(), "-").when(host == "", url).otherwise(key), r"[\t\r\n]", " ")


def _header(lines: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None, revisit: bool) -> bytes:
    """One record; of a revisit only headers are written."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    clean = " ".join((url or "").split())
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Identified-Payload-Type", "text/html"), ("X-Payload-Length", str(size))]
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return gzip.compress(_header(lines) + body + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """A record from its gzip member; a response's digest and size come from the payload as read."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    ident = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">")
    number = lambda x: None if x == "null" else int(x)
    out = {"page_id": number(ident("WARC-Record-ID")), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": None}
    if out["record_type"] == "revisit":
        return out | {"refers_to": number(ident("WARC-Refers-To")), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None}
    payload = body.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha1(payload).hexdigest()
    if digest != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"record {out['page_id']}: its payload has another digest")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


def _slot(digest: Column) -> Column:
    return F.crc32(digest.cast("binary")) % SLOTS


def captures(pages: DataFrame, min_dedup: int = MIN_DEDUP) -> DataFrame:
    """key, page_id, url, payload (null for revisits), digest, size and refers (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    shared = base.where(F.col("size") >= min_dedup).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    # only pages in a slot of a shared payload meet the table of those; the slots have a fixed bound, so they are broadcast
    shared = materialize(shared)
    slots = F.broadcast(shared.select(_slot(F.col("of")).alias("slot")).distinct())
    big = base.where(F.col("size") >= min_dedup).withColumn("slot", _slot(F.col("digest")))
    copies = big.join(slots, "slot", "left_semi").drop("slot").join(shared, F.col("digest") == F.col("of"), "left").drop("of")
    single = big.join(slots, "slot", "left_anti").drop("slot").unionByName(base.where(F.col("size") < min_dedup))
    joined = copies.unionByName(single.withColumn("first", F.lit(None).cast("bigint")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(url_key(F.col("url")).alias("key"), "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("first")).alias("refers"))


def write_archive(pages: DataFrame, folder: str | None = None, block: int = BLOCK, min_dedup: int = MIN_DEDUP) -> tuple[str, DataFrame]:
    """Write archives and indexes to a new folder: (folder, table of parts)."""
    folder = folder or shared_dir(pages.sparkSession)

    def write(batches):
        part, archive, index, lines, blocks, first, last, records = TaskContext.get().partitionId(), None, None, [], [], None, None, 0

        def flush():
            if lines:
                raw = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode())
                blocks.append((lines[0][0], index.write(raw), len(raw)))
                lines.clear()

        for b in batches:
            for key, page_id, url, payload, digest, size, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive is None:
                    archive, index, first = Writer(folder, f"part-{part:06d}", ".warc.gz"), Writer(folder, f"part-{part:06d}", ".cdx"), key
                member = record(page_id, url, payload or b"", digest, size, refers, payload is None)
                lines.append((key, "null" if page_id is None else page_id, archive.write(member), len(member)))
                last, records = key, records + 1
                if len(lines) == block:
                    flush()
        if archive is not None:
            flush()
            raw = zlib.compress(json.dumps(blocks).encode())
            at = index.write(raw)
            archive.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"first_key": first, "last_key": last, "archive": archive.name, "index": index.name, "directory_at": at, "directory_size": len(raw), "records": records}])

    with scratch(pages.sparkSession) as keep:
        ordered = captures(pages, min_dedup).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
        return folder, keep(ordered.mapInArrow(write, PARTS))


def _lines(reader: Reader, index: str, at: int, size: int) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(reader.read(index, at, size)).decode().split("\n")]


def _directory(reader: Reader, part: dict) -> list[tuple[str, int, int]]:
    return json.loads(zlib.decompress(reader.read(part["index"], part["directory_at"], part["directory_size"])))


def _fetch(reader: Reader, archive: str, lines: list[list[str]]):
    """The records of consecutive lines, by one range read."""
    start = int(lines[0][2])
    raw = reader.read(archive, start, int(lines[-1][2]) + int(lines[-1][3]) - start)
    for key, _, at, size in lines:
        yield {"key": key} | parse(raw[int(at) - start : int(at) - start + int(size)])


def read_archive(spark: SparkSession, folder: str, parts: DataFrame, payload: bool = True) -> DataFrame:
    """All records: part by part, block by block."""
    n = max(1, parts.count())

    def read(batches):
        reader = Reader(folder)
        for b in batches:
            for part in b.to_pylist():
                for _, at, size in _directory(reader, part):
                    rows = list(_fetch(reader, part["archive"], _lines(reader, part["index"], at, size)))
                    for r in rows:
                        r["payload"] = r["payload"] if payload else None
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
        reader.close()

    return parts.repartition(n).mapInArrow(read, RECORDS)


_RECORDS = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _between(begins: list[str], key: str) -> range:
    """Which of the sorted stretches, given by their first keys, may have the key."""
    return range(max(0, bisect.bisect_left(begins, key) - 1), bisect.bisect_right(begins, key))


def _parts_of(parts: list[dict], firsts: list[str], key: str) -> list[int]:
    return [k for k in _between(firsts, key) if parts[k]["last_key"] >= key]


def fetch(spark: SparkSession, folder: str, parts: DataFrame, keys: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the distinct values of ``keys`` (key), by search; keys without a record give no row.

    The table of parts (a row for each task that wrote) goes to all tasks. A key goes to each part that may have it, so a hot
    key is read by as many tasks as wrote it; within a part keys come in order, and a block is read once for neighbouring keys.
    """
    table = sorted((p.asDict() for p in parts.collect()), key=lambda p: (p["first_key"], p["last_key"]))
    if not table:
        return spark.createDataFrame([], RECORDS)
    firsts = [p["first_key"] for p in table]

    def deal(batches):
        for b in batches:
            pairs = [(k, key) for key in b["key"].to_pylist() for k in _parts_of(table, firsts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int32()), pa.array([key for _, key in pairs], pa.string())], ["part", "key"])

    def read(batches):
        reader, at, blocks, begins, block, lines, own, wanted = Reader(folder), None, [], [], None, [], [], []

        def flush():
            """The records of the lines wanted of the block at hand, neighbours in one range."""
            rows, start = [], 0
            for k in range(1, len(wanted) + 1):
                if k == len(wanted) or wanted[k] != wanted[k - 1] + 1:
                    rows += _fetch(reader, table[at]["archive"], [lines[i] for i in wanted[start:k]])
                    start = k
            wanted.clear()
            for r in rows:
                r["payload"] = r["payload"] if payload else None
            return pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

        for b in batches:
            for part, key in zip(b["part"].to_pylist(), b["key"].to_pylist(), strict=True):
                if part != at:
                    if wanted:
                        yield flush()
                    at, block, blocks = part, None, _directory(reader, table[part])
                    begins = [x[0] for x in blocks]
                for k in _between(begins, key):
                    if k != block:
                        if wanted:
                            yield flush()
                        block, lines = k, _lines(reader, table[at]["index"], *blocks[k][1:])
                        own = [x[0] for x in lines]
                    wanted += range(bisect.bisect_left(own, key), bisect.bisect_right(own, key))
        if wanted:
            yield flush()
        reader.close()

    dealt = keys.select("key").where(F.col("key").isNotNull()).distinct().mapInArrow(deal, "part int, key string")
    return dealt.repartitionById(len(table), "part").sortWithinPartitions("part", "key").mapInArrow(read, RECORDS)


def lookup(folder: str, parts: list[dict], key: str) -> list[dict]:
    """Records of one key: halving the parts' keys, a directory and a block's lines, then reading ranges.

    ``parts`` are the rows of the table of parts, sorted by first key: one for each task that wrote, whatever the records.
    """
    reader, out = Reader(folder), []
    firsts = [p["first_key"] for p in parts]
    for part in (parts[k] for k in _parts_of(parts, firsts, key)):
        blocks = _directory(reader, part)
        for _, at, size in (blocks[k] for k in _between([x[0] for x in blocks], key)):
            lines = _lines(reader, part["index"], at, size)
            keys = [x[0] for x in lines]
            found = lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            if found:
                out += _fetch(reader, part["archive"], found)
    reader.close()
    return out
