"""Label sequences and spans: gaps and islands by windows, one row a character."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def label_rows(df: DataFrame, keys: list[str], labels: str) -> DataFrame:
    """One row (keys, pos, label) for each element of a label array."""
    return df.select(*keys, F.posexplode(labels).alias("pos", "label"))


def bio_spans(rows: DataFrame, keys: list[str], confidence: str | None = None) -> DataFrame:
    """Spans (keys, char_start, char_end, entity_type[, confidence]) of B-/I- labels in rows (keys, pos, label).

    A ``B-`` begins a span, an ``I-`` of the same type goes on with it, all else ends it; an ``I-`` without a beginning
    gives none, nor does a label without a type.
    """
    w = W.partitionBy(*keys).orderBy("pos")
    kind = F.when(F.col("label").contains("-"), F.substring_index("label", "-", -1)).otherwise(F.col("label"))
    goes_on = F.col("label").startswith("I-") & (kind == F.lag(kind).over(w)) & F.lag("label").over(w).contains("-")
    marked = rows.withColumn("kind", kind).withColumn("breaks", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    islands = marked.withColumn("island", F.sum("breaks").over(w.rowsBetween(W.unboundedPreceding, 0)))
    extra = [F.avg(confidence).alias("confidence")] if confidence else []
    grouped = islands.groupBy(*keys, "island", "kind").agg(F.min("pos").alias("char_start"), (F.max("pos") + 1).alias("char_end"), F.min_by("label", "pos").alias("first"), *extra)
    return grouped.where(F.col("first").startswith("B-")).select(*keys, "char_start", "char_end", F.col("kind").alias("entity_type"), *(["confidence"] if confidence else []))


def char_labels(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Token labels (keys, start, end, label, score) laid on characters: a token's later characters are inside, and an
    ``I-`` that doesn't follow its own type becomes ``B-``."""
    chars = tokens.where(F.col("end") > F.col("start")).select(*keys, "label", "score", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    spread = chars.withColumn("label", F.when((F.col("pos") > F.col("start")) & F.col("label").startswith("B-"), F.concat(F.lit("I-"), F.substring_index("label", "-", -1))).otherwise(F.col("label")))
    w = W.partitionBy(*keys).orderBy("pos")
    kind = F.substring_index("label", "-", -1)
    orphan = F.col("label").startswith("I-") & ~F.coalesce((F.lag(kind).over(w) == kind) & (F.lag("pos").over(w) == F.col("pos") - 1), F.lit(False))
    return spread.withColumn("label", F.when(orphan, F.concat(F.lit("B-"), kind)).otherwise(F.col("label"))).select(*keys, "pos", "label", "score")


def labels_of_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse: (keys, pos, label) of the characters within spans."""
    at = spans.select(*keys, "entity_type", "char_start", F.explode(F.sequence("char_start", F.col("char_end") - 1)).alias("pos"))
    return at.select(*keys, "pos", F.concat(F.when(F.col("pos") == F.col("char_start"), "B-").otherwise("I-"), "entity_type").alias("label"))
