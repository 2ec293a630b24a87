"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source has a weight and a cap of ``max_epochs`` times its size. Weights share the whole; a source whose
share exceeds its cap is clamped there and the rest is shared again by weight, until no share exceeds a cap.
Each document is then taken ``floor(target / source_size)`` whole times, and the words that are still missing
come from documents in the order of a seeded hash: each a whole time more, and the one at the end a fraction.
So the words taken meet the target to the word. A source's plan is one row: how often all its documents are taken, and the
hash up to which once more.

Only DataFrame operations. The driver holds one row of totals for each round of clamping, never sources or
documents. A hot source is split into hash buckets whose number grows with its rows: sums are kept by bucket, and only
rows of one bucket are ordered together.

Defined cases: a null text has size 0 and is never taken; a null source is a source, last in the order; sources
without words have target 0; an empty table gives an empty result; repeated rows count each for itself, and rows
of one id, or without one, are taken in the order of their sizes, so that a source's taken words meet its target then too;
in ``repeat_rows`` rows equal in id and text are taken alike. Extra columns are ignored by ``mix`` and kept by ``repeat_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.llm.common import WORD, materialize, tidy

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Rows of a hash bucket, about.
BUCKET_ROWS = 2000


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """rank (from 0) of each source by code point, null last: ranges are sorted apart, then offset by the rows before."""
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = materialize(ordered.withColumn("part", F.spark_partition_id()))
    before = placed.groupBy("part").count()  # a row for each partition
    before = before.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("offset"))
    within = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return placed.join(before, "part").select("source", "source_size", (F.col("offset") + within - 1).alias("rank"))


def _weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    return sources.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, ...) with ``target`` as double. Targets sum to the sum of all sizes."""
    wide = lambda c: c.cast("decimal(38,0)")
    state = materialize(sources.select("*", (max_epochs * F.col("source_size")).alias("cap"), (F.col("source_size") == 0).alias("full")))
    total = state.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]
    while True:
        clamped = F.col("full")
        at = state.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("gone"), F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("open")).first()
        rest, weight = total - (at["gone"] or 0), at["open"] or 0
        if not weight:
            break
        over = ~clamped & (wide(F.col("weight")) * F.lit(rest).cast("decimal(19,0)") > wide(F.col("cap")) * F.lit(weight).cast("decimal(19,0)"))
        if not state.where(over).limit(1).count():
            break
        state = materialize(state.withColumn("full", clamped | over))
    share = (F.col("weight") * F.lit(rest).cast("long")).cast("double") / F.lit(max(weight, 1)).cast("double")
    return state.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).drop("cap", "full")


def seeded_key(doc_id: Column, seed: str, text: Column | None = None) -> Column:
    """The hash by whose order documents are taken; with ``text`` it tells apart different texts of one id."""
    more = [] if text is None else [F.lit(":"), F.xxhash64(text).cast("string")]
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), *more).cast("binary"))


def _of(source: Column) -> Column:
    return source.eqNullSafe(F.col("of"))


def _cut_row(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """``cut`` with cut_row: of the equal rows at each cut, in the order of ``row``, the one that is taken in part.

    Rows are counted by the task that wrote them (the upper bits of ``row``); only those of the one task where the cut falls are numbered.
    """
    full = F.floor(F.col("cut_part") / F.greatest(F.lit(1), F.col("cut_each"))).cast("long")
    at = sized.join(cut.withColumn("full", full), F.col("source").eqNullSafe(F.col("c")) & (F.col("key") == F.col("cut")) & (F.col("size") == F.col("cut_each")))
    at = at.select("c", "cut", "full", "row", F.shiftright("row", 33).alias("task"))
    counted = at.groupBy("c", "task", "full").agg(F.count("*").alias("n"))
    counted = counted.withColumn("earlier", F.sum("n").over(W.partitionBy("c").orderBy("task")) - F.col("n"))
    there = counted.where((F.col("earlier") <= F.col("full")) & (F.col("full") < F.col("earlier") + F.col("n"))).select(F.col("c").alias("c2"), F.col("task").alias("t2"), (F.col("full") - F.col("earlier") + 1).alias("nth"))
    numbered = at.join(there, F.col("c").eqNullSafe(F.col("c2")) & (F.col("task") == F.col("t2"))).withColumn("k", F.row_number().over(W.partitionBy("c").orderBy("row")))
    found = numbered.where(F.col("k") == F.col("nth")).select(F.col("c").alias("c3"), F.col("row").alias("cut_row"))
    return cut.join(found, F.col("c").eqNullSafe(F.col("c3")), "left").drop("c3")


@tidy
def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each source of ``sized`` (source, size, key and, if wanted, row): ``of``, source_size, target, whole, cut, cut_each, cut_part, cut_size.

    ``whole`` is how often every document is taken; those before (``cut``, ``cut_each``) in the order of (key, size) are taken once more, and of those
    equal to both, whose sizes sum to cut_size, cut_part words. With a column ``row`` there is cut_row too: equal rows before it are taken once more, it in part.
    """
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")))
    filled = water_fill(_weighted(_ranked(totals.select("source", "source_size")), weights), max_epochs)
    quota = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole"), (quota - whole * F.col("source_size")).alias("missing"))
    # the keys' first 20 bits deal a source's documents to buckets in the order of the keys
    dealt = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / bucket_rows)).cast("long")
    filled = materialize(filled.join(totals.select(F.col("source").alias("s"), dealt.alias("buckets")), F.col("of").eqNullSafe(F.col("s"))).drop("s"))
    first = F.conv(F.substring("key", 1, 5), 16, 10).cast("long")
    placed = sized.join(filled.select("of", "missing", "buckets"), _of(F.col("source"))).withColumn("bucket", F.least(F.floor(first * F.col("buckets") / (1 << 20)).cast("long"), F.col("buckets") - 1))
    sums = placed.groupBy("of", "bucket", "missing").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("of").orderBy("bucket"))
    sums = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    crossing = materialize(sums.where((F.col("before") <= F.col("missing")) & (F.col("upto") > F.col("missing"))).select(F.col("of").alias("c"), F.col("bucket").alias("b"), "before"))
    inside = placed.join(crossing, F.col("of").eqNullSafe(F.col("c")) & (F.col("bucket") == F.col("b")))
    keys = inside.groupBy("of", "key", "size", "before", "missing").agg(F.sum("size").alias("cut_size"))
    start = F.col("before") + F.sum("cut_size").over(W.partitionBy("of").orderBy("key", "size")) - F.col("cut_size")
    cut = keys.withColumn("start", start).where((F.col("start") <= F.col("missing")) & (F.col("start") + F.col("cut_size") > F.col("missing")))
    cut = cut.select(F.col("of").alias("c"), F.col("key").alias("cut"), F.col("size").alias("cut_each"), (F.col("missing") - F.col("start")).alias("cut_part"), "cut_size")
    rows = ["cut_row"] if "row" in sized.columns else []
    if rows:
        cut = _cut_row(sized, materialize(cut))
    return filled.join(cut, F.col("of").eqNullSafe(F.col("c")), "left").select("of", "source_size", "target", "whole", "cut", "cut_each", "cut_part", "cut_size", *rows)


def _more() -> Column:
    """Words beyond the whole repetitions."""
    place, cut = F.struct("key", "size", "row"), F.struct("cut", "cut_each", "cut_row")
    part = F.col("cut_part") % F.greatest(F.lit(1), F.col("cut_each"))
    return F.when(F.col("cut").isNull(), 0).when(place < cut, F.col("size")).when(place == cut, part).otherwise(0).cast("long")


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, whole, more (words beyond whole repetitions) and taken."""
    sized = materialize(docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed).alias("key"), F.monotonically_increasing_id().alias("row")))
    out = sized.join(plan(sized, **options), _of(F.col("source"))).withColumn("more", _more())
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", "more", (F.col("whole") * F.col("size") + F.col("more")).alias("taken"))


@tidy
def _times(docs: DataFrame, seed: str, **options) -> DataFrame:
    """The plan of each source, packed, for rows told apart by id and text."""
    sized = materialize(docs.select("source", text_size(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed, F.col("text")).alias("key")))
    return plan(sized, **options).select("of", F.struct("whole", "cut", "cut_part", "cut_size").alias("turnwise_plan"))


def repeat_rows(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix as rows: each document as often as it is taken, a fraction counting as one if it is half the document or more (of rows equal in id and text, half of all).

    Documents without words are not taken. Texts are not dealt out: they meet only the table of sources.
    """
    packed = _times(docs, seed, **options)
    of = "turnwise_of"
    p, key = F.col("turnwise_plan"), seeded_key(docs["doc_id"], seed, docs["text"])
    once = (key < p["cut"]) | ((key == p["cut"]) & (2 * p["cut_part"] >= p["cut_size"]))
    times = F.when(F.coalesce(docs["text"].rlike(WORD), F.lit(False)), p["whole"] + F.when(once, 1).otherwise(0)).otherwise(0)
    joined = docs.join(packed.withColumnRenamed("of", of), docs["source"].eqNullSafe(F.col(of)))
    return joined.select(*(docs[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("turnwise_copy")).drop("turnwise_copy")
