"""Runs, transitions and repeated tracks: windows over (track, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_length(df: DataFrame, track: list[str], order: list[str], state: str) -> DataFrame:
    """Rows that differ in state from the row before; null is a state of its own."""
    w = W.partitionBy(*track).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", first | ~F.lag(state).over(w).eqNullSafe(F.col(state))).where("_new").drop("_new")


def transitions(df: DataFrame, track: list[str], order: list[str], state: str, at: str | None = None) -> DataFrame:
    """(track, from_state, to_state, gap) between consecutive runs; ``gap`` is of the column ``at``."""
    w = W.partitionBy(*track).orderBy(*order)
    at = at or order[0]
    moved = run_length(df, track, order, state).withColumn("to_state", F.lead(state).over(w)).withColumn("gap", F.lead(at).over(w) - F.col(at)).withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    return moved.where(~F.col("last")).select(*track, F.col(state).alias("from_state"), "to_state", "gap")


def changing_tracks(df: DataFrame, track: list[str], order: list[str], state: str, at: str | None = None, poles: tuple[str, str] = ("0", "1")) -> DataFrame:
    """Tracks of two runs or more: runs, greatest gap, and whether both poles occur."""
    at = at or order[0]
    w = W.partitionBy(*track).orderBy(*order)
    runs = run_length(df, track, order, state).withColumn("gap", F.col(at) - F.lag(at).over(w))
    both = F.bool_or(F.col(state) == poles[0]) & F.bool_or(F.col(state) == poles[1])
    return runs.groupBy(*track).agg(F.count("*").alias("runs"), F.max("gap").alias("max_gap"), F.coalesce(both, F.lit(False)).alias("reversal")).where(F.col("runs") >= 2)


def repeated_tracks(df: DataFrame, track: list[str], at: str, min_span: int, cue: Column | None = None) -> DataFrame:
    """Tracks seen at two places or more that are ``min_span`` apart, and how many of their rows have a cue."""
    cues = F.count_if(cue) if cue is not None else F.lit(0).cast("long")
    out = df.groupBy(*track).agg(F.countDistinct(at).alias("places"), (F.max(at) - F.min(at)).alias("span"), cues.alias("cue_rows"))
    return out.where((F.col("places") > 1) & (F.col("span") >= min_span))


def first_of(df: DataFrame, track: list[str], condition: Column, at: str, name: str = "first_at") -> DataFrame:
    return df.groupBy(*track).agg(F.min(F.when(condition, F.col(at))).alias(name))


def in_order(df: DataFrame, track: list[str], order: list[str], at: str) -> DataFrame:
    """One row: whether ``at`` never falls along the order of any track."""
    w = W.partitionBy(*track).orderBy(*order)
    fine = F.coalesce(F.lag(at).over(w) <= F.col(at), F.lit(True))
    return df.select(fine.alias("f")).agg(F.coalesce(F.bool_and("f"), F.lit(True)).alias("in_order"))
