"""N-gram Jaccard join: links between documents whose sets of word shingles are alike, and their components.

Grouped prefix join. Shingles have a global order, rarest first; two sets can only be alike if they share a shingle in their
prefixes, the first ``n - ceil(t n) + 1``. Documents of equal sets are one class; classes of identical prefix and
size are one group. Groups meet by prefix shingle, pairs are filtered by size and position, then expanded to their
members and verified on the whole sets.

Skew. A shingle shared by more than BUCKET members (families of near copies, passages in many documents) would
give a square of pairs. Such a bucket instead takes a pivot, its most copied member or that of a bucket it overlaps, and each member is replaced by its
difference from the pivot (the shingles that only one of the two has). Links to the pivot follow at once. For two members
with differences D and E, the distance between the sets is that between D and E, so the same prefix join is made on the
differences: members with |D| + |E| within the distance allowed are both linked to the pivot, all others must share one of the rarest
shingles of the differences. Buckets that are still large take a pivot of their own, LEVELS times; what is left then is
joined pair by pair. No link between components is lost at any step, no bucket is capped.

Order. A sketch of 2^22 counters, filled by all documents and added up in parts, gives each shingle a class of frequency; order is
by class, then hash. Any order is correct; this one makes prefixes rare. Sketch and bitmaps have a fixed size (2 to 4 MB),
so they may reach the driver and be broadcast. A parity signature of two bits or more for each shingle bounds the distance of two sets from below, so
most pairs that aren't links go before whole sets are fetched. Sets are rebuilt from texts for documents that still have a candidate.

Components come from repeated minima over links with pointer jumping, each round written to the shared folder.

Defined cases: a null text, an empty one and one without words have no shingle and are linked with nothing; a text of fewer words
than a shingle has its whole sequence as one; equal texts are linked; repeated rows count as documents of their own; a
null doc_id takes part but never names a component unless it has no other; extra columns are ignored. Shingles are
compared as 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm import hashing
from turnwise.llm.common import materialize, tidy

#: A bucket of more members becomes part of a family; after LEVELS families within families what is left is joined pair by pair.
BUCKET, LEVELS = 32, 6
#: Members that a family's centre is taken from; chunks of a family that get a copy of the centre each.
SAMPLE, SALTS = 33, 1024
SKETCH_BITS, MAP_BITS = 22, 24
CHUNKS = 32


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in hashing.text_slices(texts):
        words, first = hashing.tokens(data, offsets)
        runs = hashing.shingles(words, width) if len(words) >= width else words[:0]
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(runs[a : b - width + 1] if b - a >= width else hashing.shingles(words[a:b], width))


def _fold(parts: DataFrame, kind: str, join) -> np.ndarray:
    """Arrays that tasks have filled, as rows (chunk, data), joined element by element: a result of fixed size. No more tasks than chunks start Python."""

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for c, d in zip(b["chunk"].to_pylist(), b["data"].to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(d), kind)
                held[c] = x.copy() if c not in held else join(held[c], x)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], ["chunk", "data"])

    rows = parts.repartition("chunk").coalesce(CHUNKS).mapInArrow(merge, "chunk int, data binary").collect()
    return np.concatenate([np.frombuffer(zlib.decompress(d), kind) for _, d in sorted((r["chunk"], r["data"]) for r in rows)]) if rows else np.empty(0, kind)


def _parts(filled: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(filled, CHUNKS)], pa.binary())], ["chunk", "data"])


def frequency_classes(docs: DataFrame, width: int) -> np.ndarray:
    """For each counter of the sketch a class of 0 to 63, twice the logarithm of the count."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            held, n = [], 0
            for s in shingle_sets(b["text"], width):
                held.append(s)
                n += len(s)
                if n > 1 << 21:
                    total += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=len(total)).astype(np.uint32)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=len(total)).astype(np.uint32)
        yield _parts(total)

    counts = _fold(docs.select("text").mapInArrow(count, "chunk int, data binary"), "<u4", np.add)
    if not len(counts):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    return np.minimum(63, 2 * np.log2(counts + 1.0)).astype(np.uint8)


def ordered(sets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Shingles as numbers whose order is the global one: the class, then the hash."""
    return np.sort(classes[sets >> np.uint64(64 - SKETCH_BITS)].astype(np.int64) << 57 | (sets >> np.uint64(7)).astype(np.int64))


def signature(x: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits, in a power of two of at least 64 and 2 n places."""
    size = 1 << max(6, (2 * len(x) - 1).bit_length())
    return np.packbits(np.bincount(x & (size - 1), minlength=size).astype(np.uint8) & 1).tobytes()


def least_distance(a: bytes, b: bytes) -> int:
    """At most the symmetric difference of the two sets: each shingle that only one has flips one parity."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _digest(x: np.ndarray, *more: int) -> bytes:
    return hashlib.blake2b(x.tobytes() + repr(more).encode(), digest_size=16).digest()


def _key(digest: bytes, doc_id: int | None) -> int:
    """Place in a bitmap of a document of this set and id."""
    return zlib.crc32(digest + (b"" if doc_id is None else str(doc_id).encode())) & ((1 << MAP_BITS) - 1)


def _key_column() -> Column:
    return F.crc32(F.concat("digest", F.coalesce(F.col("rep").cast("string"), F.lit("")).cast("binary"))).bitwiseAND((1 << MAP_BITS) - 1)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits at the values of the single column ``key``, which are below 2^MAP_BITS."""

    def fill(batches):
        bits = np.zeros(1 << MAP_BITS, bool)
        for b in batches:
            bits[b["key"].to_numpy()] = True
        yield _parts(np.packbits(bits))

    found = _fold(keys.mapInArrow(fill, "chunk int, data binary"), "u1", np.bitwise_or)
    return found if len(found) else np.zeros((1 << MAP_BITS) // 8, np.uint8)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return bits[keys >> 3] >> (7 - (keys & 7)).astype(np.uint8) & 1 == 1


class Likeness:
    """``100 * intersection >= share * union`` in integers."""

    def __init__(self, share: int):
        self.share = share

    def need(self, total):
        """Least intersection of two sets whose sizes sum to ``total``."""
        return -(-self.share * total // (100 + self.share))

    def apart(self, total):
        """Greatest symmetric difference."""
        return total - 2 * self.need(total)

    def prefix(self, n: int) -> int:
        return n - -(-self.share * n // 100) + 1

    @property
    def whole(self) -> int:
        return 100 + self.share

    def slack(self, d: int, n: int) -> int:
        """Of a set of n shingles at distance d from a centre. Two sets with |D| and |E| differ by at most |D| + |E|, so they are linked
        if their slacks sum to 0 or less; otherwise they are linked just if D and E share the sum over twice ``whole``, rounded up."""
        return self.whole * d - (100 - self.share) * n

    # the same as columns
    def need_column(self, total: Column) -> Column:
        return F.ceil(total * self.share / (100 + self.share))

    def sizes_column(self, a: Column, b: Column) -> Column:
        return (100 * F.least(a, b)) >= (self.share * F.greatest(a, b))


def _prefixes(docs: DataFrame, classes, width: int, like: Likeness) -> DataFrame:
    """doc_id, digest (of the set), grp (of prefix and size), n, prefix and signature of every document."""

    def build(batches):
        for b in batches:
            ids, rows = b["doc_id"].to_pylist(), []
            for doc, s in zip(ids, shingle_sets(b["text"], width), strict=True):
                x = ordered(s, classes.value)
                p = x[: like.prefix(len(s)) if len(s) else 0]
                rows.append((doc, _digest(s), _digest(p, len(s)), len(s), p.copy(), signature(x)))
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                ends = np.cumsum([0, *(len(r[4]) for r in part)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.binary()), pa.array([r[3] for r in part], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[4] for r in part]))), pa.array([r[5] for r in part], pa.binary())],
                    ["doc_id", "digest", "grp", "n", "prefix", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id bigint, digest binary, grp binary, n bigint, prefix array<bigint>, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame, classes, width: int) -> DataFrame:
    """(digest, n, shingles) of the classes in ``wanted`` (digest, rep), from the texts; a bitmap spares most others."""

    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(_key_column().alias("key"))))

    def build(batches):
        for b in batches:
            rows, held = [], 0
            for doc, s in zip(b["doc_id"].to_pylist(), shingle_sets(b["text"], width), strict=True):
                if not len(s):
                    continue
                d = _digest(s)
                if _has(bits.value, np.array([_key(d, doc)]))[0]:
                    rows.append((d, len(s), ordered(s, classes.value).tobytes()))
                    held += 8 * len(s)
                if held > 8 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["digest", "n", "shingles"])

    found = docs.select("doc_id", "text").mapInArrow(build, "digest binary, n bigint, shingles binary")
    return found.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def _near(pairs: DataFrame, signed: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that their signatures don't rule out."""

    def check(batches):
        for b in batches:
            keep = [least_distance(x, y) <= like.apart(m + n) for x, y, m, n in zip(*(b[c].to_pylist() for c in ("sig_a", "sig_b", "n_a", "n_b")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = signed.select(F.col("digest").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    other = signed.select(F.col("digest").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    return pairs.join(own, "a").join(other, "b").mapInArrow(check, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose sets are alike. A set travels once for each pair as b, and once as a for all its pairs."""

    def check(batches):
        held, x = None, None
        for b in batches:
            left, right = [], []
            for a, other, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), b["shingles"], strict=True):
                y = np.frombuffer(y.as_buffer(), np.int64)
                if other is None:
                    held, x = a, y.copy()
                elif a == held and len(np.intersect1d(x, y, assume_unique=True)) >= like.need(len(x) + len(y)):
                    left.append(a)
                    right.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    own = sets.select(F.col("digest").alias("a"), F.lit(None).cast("binary").alias("b"), "shingles").join(pairs.select("a").distinct(), "a", "left_semi")
    other = pairs.select("a", F.col("b").alias("digest")).join(sets.select("digest", "shingles"), "digest").select("a", F.col("digest").alias("b"), "shingles")
    return own.unionByName(other).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first()).mapInArrow(check, "a binary, b binary")


def _families(hot: DataFrame) -> DataFrame:
    """(family, digest, root) from large buckets (bucket, digest, root): buckets with about the same members become one family.

    A member names its largest bucket, a bucket takes the name that most of its members give. Every bucket lies within one family.
    """
    sized = hot.join(hot.groupBy("bucket").agg(F.count("*").alias("m")), "bucket")
    named = sized.groupBy("digest").agg(F.max(F.struct("m", "bucket"))["bucket"].alias("name"))
    votes = hot.select("bucket", "digest").join(named, "digest").groupBy("bucket", "name").agg(F.count("*").alias("v"))
    family = votes.groupBy("bucket").agg(F.max(F.struct("v", "name"))["name"].alias("family"))
    return hot.join(family, "bucket").groupBy("family", "digest").agg(F.min("root").alias("root"))


def _centres(family: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, centre): the shingles that more than half of at most SAMPLE members hold, chosen by hash; any centre is correct."""

    def majority(batches):
        name, held = None, []

        def centre():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([found[2 * n > len(held)].tobytes()], pa.binary())], ["family", "centre"])

        for b in batches:
            for f, x in zip(b["family"].to_pylist(), b["shingles"], strict=True):
                if f != name and held:
                    yield centre()
                    held = []
                name = f
                held.append(np.frombuffer(x.as_buffer(), np.int64).copy())
        if held:
            yield centre()

    turn = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("digest"), "digest"))
    chosen = family.select("family", "digest").withColumn("turn", turn).where(F.col("turn") <= SAMPLE).drop("turn")
    rows = chosen.join(sets.select("digest", "shingles"), "digest").select("family", "shingles")
    return rows.repartition("family").sortWithinPartitions("family").mapInArrow(majority, "family bigint, centre binary")


def _differences(family: DataFrame, centres: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """(family, digest, root, d, slack, difference): how each member differs from its family's centre.

    A difference lists first what only the member has, rarest first, then what only the centre has, most frequent
    first: shingles that few members of the family have in their differences come first. Chunks of a family, dealt by the
    hash of the member, meet a copy of the centre each.
    """

    def differ(batches):
        name, centre = None, None
        for b in batches:
            out = []
            for f, d, root, n, x in zip(*(b[c].to_pylist() for c in ("family", "digest", "root", "n")), b["shingles"], strict=True):
                x = np.frombuffer(x.as_buffer(), np.int64)
                if d is None:
                    name, centre = f, x.copy()
                elif f == name:
                    z = np.concatenate((np.setdiff1d(x, centre, assume_unique=True), np.setdiff1d(centre, x, assume_unique=True)[::-1]))
                    out.append((f, d, root, len(z), like.slack(len(z), n), z))
            if out:
                ends = np.cumsum([0, *(r[3] for r in out)], dtype=np.int32)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[5] for r in out])))], ["family", "digest", "root", "d", "slack", "difference"])

    salted = family.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    members = salted.join(sets.select("digest", "n", "shingles"), "digest").select("family", "salt", "digest", "root", "n", "shingles")
    none = F.lit(None)
    copies = salted.select("family", "salt").distinct().join(centres, "family").select("family", "salt", none.cast("binary").alias("digest"), none.cast("binary").alias("root"), F.lit(0).cast("bigint").alias("n"), F.col("centre").alias("shingles"))
    dealt = members.unionByName(copies).repartition("family", "salt").sortWithinPartitions("family", "salt", F.col("digest").asc_nulls_first())
    return dealt.mapInArrow(differ, "family bigint, digest binary, root binary, d bigint, slack bigint, difference array<bigint>")


def _roles(apart: DataFrame, like: Likeness) -> DataFrame:
    """``apart`` with the family's pivot, ``linked`` (to the pivot), the root so known, and how far to post the difference.

    Two members whose slacks sum to 0 or less are linked, as each is that near to the centre. The pivot has the least slack, so such
    pairs are all linked to it; every other link joins a member that isn't linked to the pivot, and shares a shingle of the differences.
    """
    pivots = apart.groupBy("family").agg(F.min(F.struct("slack", "digest", "root")).alias("pivot"))
    least, twice = F.col("pivot.slack"), 2 * like.whole
    linked = F.col("slack") + least <= 0
    # the least overlap with any partner that matters: of a linked member with one that isn't, of others with all and among themselves
    with_free, with_all = F.floor((F.col("slack") - least) / twice) + 1, F.ceil((F.col("slack") + least) / twice)
    reach = lambda overlap: F.greatest(F.lit(0), F.col("d") - F.greatest(F.lit(1), overlap) + 1).cast("int")
    both = apart.join(pivots, "family").withColumn("linked", linked)
    return both.withColumns({
        "root": F.when(F.col("linked"), F.col("pivot.root")).otherwise(F.col("root")),
        "short": reach(F.when(F.col("linked") | (least <= 0), with_free).otherwise(with_all)),
        "long": reach(F.when(F.col("linked"), with_free).otherwise(with_all)),
    })


def _postings(roles: DataFrame) -> DataFrame:
    """(family, token, digest, root, d, slack, k, kind, own, free, rest), a row for each posted shingle that two different roots share.

    kind 0: linked to the pivot, 1: not, 2: not, and of use only with kind 0. own, free, rest: how many of each kind the bucket has.
    """
    kind = F.when(F.col("linked"), 0).when(F.col("k") < F.col("short"), 1).otherwise(2)
    posted = roles.select("family", "digest", "root", "d", "slack", "linked", "short", F.posexplode(F.slice("difference", 1, F.col("long"))).alias("k", "token"))
    posted = posted.select("family", "token", "digest", "root", "d", "slack", "k", kind.alias("kind"))
    counted = posted.groupBy("family", "token").agg(
        *(F.count_if(F.col("kind") == i).alias(c) for i, c in enumerate(("own", "free", "rest"))), F.min("root").alias("least"), F.max("root").alias("most")
    )
    useful = counted.where((F.col("least") != F.col("most")) & ((F.col("free") > 1) | (F.col("own") > 0))).drop("least", "most")
    return posted.join(useful, ["family", "token"]).where((F.col("kind") < 2) | (F.col("own") > 0))


def _meet(postings: DataFrame, like: Likeness) -> DataFrame:
    """(family, a, b, overlap): members of different roots that share a posted shingle and may have the overlap that a link needs."""
    sides = [postings.select("family", "token", *(F.col(c).alias(f"{c}_{x}") for c in ("digest", "root", "d", "slack", "k", "kind"))) for x in "ab"]
    overlap = F.ceil((F.col("slack_a") + F.col("slack_b")) / (2 * like.whole))
    of_use = ((F.col("kind_a") < 2) & (F.col("kind_b") < 2)) | (F.col("kind_a") == 0) | (F.col("kind_b") == 0)
    may = of_use & (F.least(F.col("d_a") - F.col("k_a"), F.col("d_b") - F.col("k_b")) >= overlap)
    joined = sides[0].join(sides[1], ["family", "token"]).where((F.col("digest_a") < F.col("digest_b")) & (F.col("root_a") != F.col("root_b")) & may)
    return joined.select("family", F.col("digest_a").alias("a"), F.col("digest_b").alias("b"), overlap.alias("overlap")).distinct()


def _overlapping(pairs: DataFrame, apart: DataFrame) -> DataFrame:
    """The pairs (a, b) whose differences share as many shingles as a link needs."""
    own = apart.select("family", F.col("digest").alias("a"), F.col("difference").alias("x"))
    other = apart.select("family", F.col("digest").alias("b"), F.col("difference").alias("y"))
    both = pairs.join(own, ["family", "a"]).join(other, ["family", "b"])
    return both.where(F.size(F.array_intersect("x", "y")) >= F.col("overlap")).select("a", "b")


def _within(postings: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of postings (family, token, digest, n, k) of one token that may be linked: a self-join on (family, token)."""
    a = postings.select("family", "token", *(F.col(c).alias(f"{c}_a") for c in ("digest", "n", "k")))
    b = postings.select("family", "token", *(F.col(c).alias(f"{c}_b") for c in ("digest", "n", "k")))
    shared = F.greatest(F.lit(1), like.need_column(F.col("n_a") + F.col("n_b")))
    may = like.sizes_column(F.col("n_a"), F.col("n_b")) & (F.least(F.col("n_a") - F.col("k_a"), F.col("n_b") - F.col("k_b")) >= shared)
    joined = a.join(b, (a["family"] == b["family"]) & (a["token"] == b["token"]) & (F.col("digest_a") < F.col("digest_b")) & may)
    return joined.select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"))


def links(docs: DataFrame, width: int, share: int, bucket: int = BUCKET, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, digest, n; classes: digest, rep, copies; links: a, b between digests).

    The links connect exactly the classes that all links of the join would connect; within a family not every link is listed.
    """
    spark, like = docs.sparkSession, Likeness(share)
    classes = spark.sparkContext.broadcast(frequency_classes(docs, width))
    table = materialize(_prefixes(docs, classes, width, like))
    classed = materialize(table.where(F.col("n") > 0).groupBy("digest", "grp", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    many = materialize(classed.groupBy("grp").agg(F.count("*").alias("members")).where(F.col("members") > 1))
    groups = table.where(F.col("n") > 0).select("grp", "n", "prefix").distinct()
    tokens = groups.join(many, "grp", "left").select(F.coalesce("members", F.lit(1)).alias("members"), F.explode("prefix").alias("token"))
    shared = materialize(tokens.groupBy("token").agg(F.sum("members").alias("m"), F.count("*").alias("g")).where(F.col("g") > 1).drop("g"))

    mask = (1 << MAP_BITS) - 1
    bits = spark.sparkContext.broadcast(_bitmap(shared.select(F.col("token").bitwiseAND(mask).alias("key"))))

    def post(batches):
        for b in batches:
            lists = b["prefix"]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy()) if b.num_rows else np.empty(0, np.int64)
            row = np.repeat(np.arange(b.num_rows), sizes)
            k = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(_has(bits.value, flat & mask)) if len(flat) else np.empty(0, np.int64)
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep], pa.int64()), b["grp"].take(at), b["n"].take(at), pa.array(k[keep], pa.int64())], ["token", "grp", "n", "k"])

    met = groups.mapInArrow(post, "token bigint, grp binary, n bigint, k bigint").join(shared, "token")
    met = materialize(met.withColumn("family", F.lit(0)))
    # small buckets: pairs of groups, expanded to their members
    small = met.where(F.col("m") <= bucket).withColumnRenamed("grp", "digest")
    pairs_of_groups = _within(small, like).distinct()
    members = classed.select("grp", "digest")
    left, right = members.select(F.col("grp").alias("a"), F.col("digest").alias("x")), members.select(F.col("grp").alias("b"), F.col("digest").alias("y"))
    expanded = pairs_of_groups.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # members of one group: a bucket of its own
    inside = classed.join(many, "grp").select(F.col("grp").alias("family"), F.lit(0).cast("bigint").alias("token"), "digest", "n", F.lit(0).cast("bigint").alias("k"), "members")
    met_nodes = materialize(expanded.union(_within(inside.where(F.col("members") <= bucket), like)).distinct())
    nodes = met_nodes.select(F.col("a").alias("digest")).union(met_nodes.select(F.col("b").alias("digest"))).distinct()
    reps = nodes.join(classed.select("digest", "rep"), "digest")
    signed = table.where(F.col("n") > 0).select("digest", "doc_id", "n", "sig").join(reps, "digest").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("digest", "n", "sig").dropDuplicates(["digest"])
    pairs = materialize(_near(met_nodes, signed, like))
    # large buckets
    hot = met.where(F.col("m") > bucket).select(F.xxhash64("token").alias("bucket"), "grp").join(classed.select("grp", "digest"), "grp").select("bucket", "digest")
    hot = materialize(hot.unionByName(inside.where(F.col("members") > bucket).select(F.xxhash64("family").alias("bucket"), "digest")).select("bucket", "digest", F.col("digest").alias("root")))
    wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).union(hot.select("digest")).distinct()
    sets = materialize(_sets(docs, wanted.join(classed.select("digest", "rep"), "digest"), classes, width))
    found = [_verified(pairs, sets, like)]
    for level in range(levels):
        if hot.isEmpty():
            break
        family = materialize(_families(hot))
        apart = materialize(_differences(family, _centres(family, sets), sets, like))
        roles = materialize(_roles(apart, like))
        found.append(roles.where(F.col("linked") & (F.col("digest") != F.col("pivot.digest"))).select(F.col("pivot.digest").alias("a"), F.col("digest").alias("b")))
        posted = materialize(_postings(roles))
        few = (F.col("free") * F.col("free") + 2 * F.col("own") * (F.col("free") + F.col("rest")) <= bucket * bucket) if level + 1 < levels else F.lit(True)
        found.append(_overlapping(materialize(_meet(posted.where(few), like)), apart))
        if level + 1 < levels:
            hot = materialize(posted.where(~few).select(F.xxhash64("family", "token").alias("bucket"), "digest", "root").distinct())
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return table.select("doc_id", "digest", "n"), classed.select("digest", "rep", "copies"), materialize(out)


@tidy
def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that links reach, for every node of an edge (a, b)."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    state = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = state.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        jump = state.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = materialize(lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "before"))
        state = moved.select("node", "root")
        if moved.where(F.col("root") != F.col("before")).isEmpty():
            return state


@tidy
def join(docs: DataFrame, width: int = 5, share: int = 80, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row of ``docs``."""
    table, classed, edges = links(docs, width, share, **options)
    roots = components(edges)
    named = classed.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", F.coalesce("root", "digest").alias("root"), "rep")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = named.join(least, "root").select("digest", "component_id")
    real = table.where(F.col("n") > 0).join(component, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return real.union(table.where(F.col("n") == 0).select("doc_id", "n", F.col("doc_id")))
