"""Projections: allow-lists of fields, compact packets, columns left out before export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a packet keeps of its input, in order.
PACKET_FIELDS = ("target_concept", "target_surface", "doctor_question", "patient_answer", "previous_target_mentions", "local_context")


def pick(df: DataFrame, *fields: str) -> DataFrame:
    """Only these columns; one that the table lacks is null, so that both planes keep a stable schema."""
    return df.select(*(F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields))


def label_plane(dialogues: DataFrame, turns: DataFrame, labels: tuple[str, ...], turn_labels: tuple[str, ...], key: str = "dialogue_id", order: str = "turn_index") -> DataFrame:
    """The label plane: a dialogue's labels and those of its turns in order, and nothing of its text."""
    turn_id = F.concat(F.col(key), F.lit("_t"), F.lpad(F.col(order).cast("string"), 3, "0"))
    rows = turns.select(key, F.struct(F.col(order), turn_id.alias("turn_id"), *turn_labels).alias("t"))
    each = rows.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("turn_annotations"))
    return dialogues.select(key, *labels).join(each, key, "left")


def compact(packets: DataFrame, source: str = "input", fields: tuple[str, ...] = PACKET_FIELDS, keep: tuple[str, ...] = ("packet_id",)) -> DataFrame:
    """``keep`` and the named fields of the struct ``source``; without ``keep`` it is a student's input."""
    return packets.select(*keep, *(F.col(f"{source}.{f}").alias(f) for f in fields))


def without_prefix(df: DataFrame, prefix: str = "reference_") -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(prefix)))
