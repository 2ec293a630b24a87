"""Turn snapshots, running counters, context windows and leakage-safe units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions.text import stable_id


def snapshot_grid(turns: DataFrame, events: DataFrame, key: str = "dialogue_id", order: tuple[str, ...] = ("turn_index", "event_id"), include_pre_turn: bool = False) -> DataFrame:
    """(key, turn_index, episode_id, state, last_update_turn, evidence_count) of every episode at every turn from its first event on.

    The grid of a dialogue is its turns times its episodes; nothing crosses dialogues. Events before the first turn count
    only with ``include_pre_turn``.
    """
    used = events if include_pre_turn else events.where(F.col("turn_index") >= 0)
    last = used.groupBy(key, "episode_id", "turn_index").agg(F.max_by("new_state", F.struct(*order)).alias("s"), F.count("*").alias("n"))
    names = last.select(key, "episode_id").distinct()
    grid = turns.select(key, "turn_index").join(names, key)
    if include_pre_turn:
        grid = grid.unionByName(last.where(F.col("turn_index") < 0).select(key, "turn_index", "episode_id"))
    w = W.partitionBy(key, "episode_id").orderBy("turn_index").rowsBetween(W.unboundedPreceding, 0)
    at = grid.join(last, [key, "episode_id", "turn_index"], "left")
    out = at.select(
        key,
        "turn_index",
        "episode_id",
        F.last("s", ignorenulls=True).over(w).alias("state"),
        F.last(F.when(F.col("s").isNotNull(), F.col("turn_index")), ignorenulls=True).over(w).alias("last_update_turn"),
        F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("evidence_count"),
    )
    return out.where(F.col("state").isNotNull())


def snapshots(turns: DataFrame, grid: DataFrame, key: str = "dialogue_id", active: str = "present") -> DataFrame:
    """A row for each turn: states of its episodes, how many are active, distance from the last evidence."""
    rows = grid.groupBy(key, "turn_index").agg(F.count_if(F.col("state") == active).alias("active_count"), F.max("last_update_turn").alias("latest"), F.array_sort(F.collect_list(F.struct("episode_id", "state", "last_update_turn", "evidence_count"))).alias("states"))
    out = turns.select(key, "turn_index").join(rows, [key, "turn_index"], "left")
    return out.select(key, "turn_index", F.coalesce("active_count", F.lit(0)).cast("long").alias("active_count"), (F.col("turn_index") - F.col("latest")).alias("distance_since_last"), "states")


def with_initial(taken: DataFrame, turns: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """Snapshots and, for each dialogue, the one before its first turn (at -1): nothing is known yet."""
    first = turns.select(key).distinct().select(key, F.lit(-1).cast(taken.schema["turn_index"].dataType).alias("turn_index"), F.lit(0).cast("long").alias("active_count"))
    return taken.unionByName(first, allowMissingColumns=True)


def history(turns: DataFrame, evidence: DataFrame, holds: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """(key, turn_index, evidence_count, evidence_by_source, holds, transition_ids_hash) at each turn: all up to and with it.

    ``evidence`` has transition_id and source_kind, ``holds`` a row for each open hold. Ids are gathered within a dialogue only, in
    the order of turns and ids, and travel as their digest; counts by source are a map.
    """
    at = evidence.groupBy(key, "turn_index").agg(F.array_sort(F.collect_list("transition_id")).alias("ids"), F.collect_list("source_kind").alias("kinds"))
    held = holds.groupBy(key, "turn_index").agg(F.count("*").alias("h"))
    w = W.partitionBy(key).orderBy("turn_index").rowsBetween(W.unboundedPreceding, 0)
    rows = turns.select(key, "turn_index").join(at, [key, "turn_index"], "left").join(held, [key, "turn_index"], "left")
    upto = rows.select(key, "turn_index", F.flatten(F.collect_list("ids").over(w)).alias("ids"), F.flatten(F.collect_list("kinds").over(w)).alias("kinds"), F.coalesce(F.sum("h").over(w), F.lit(0)).cast("long").alias("holds"))
    names = F.array_sort(F.array_distinct("kinds"))
    by = F.array_join(F.transform(names, lambda k: F.concat_ws("=", k, F.size(F.filter("kinds", lambda x: x == k)))), ",")
    return upto.select(key, "turn_index", F.size("ids").cast("long").alias("evidence_count"), by.alias("evidence_by_source"), "holds", F.md5(F.array_join("ids", "|").cast("binary")).alias("transition_ids_hash"))


def running(turns: DataFrame, counters: dict[str, Column], key: str = "dialogue_id") -> DataFrame:
    """Running counts of conditions up to and with each turn."""
    w = W.partitionBy(key).orderBy("turn_index").rowsBetween(W.unboundedPreceding, 0)
    return turns.select("*", *(F.sum(F.coalesce(c, F.lit(False)).cast("long")).over(w).alias(name) for name, c in counters.items()))


def context(turns: DataFrame, first: int, last: int, key: str = "dialogue_id", name: str = "context") -> DataFrame:
    """Texts of the rows from ``first`` to ``last`` around each turn, in order."""
    w = W.partitionBy(key).orderBy("turn_index").rowsBetween(first, last)
    return turns.withColumn(name, F.collect_list("text").over(w))


def as_of_before(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row strictly before it: one union and one window, no theta join."""
    marked = left.select("*", F.lit(0).alias("_side"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values)).unionByName(right.select(key, at, *values).withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, -1)  # at equal places the left row stands first
    packed = F.last(F.when(F.col("_side") == 1, F.struct(*values)), ignorenulls=True).over(w)
    kept = [c for c in left.columns if c not in values]
    return marked.withColumn("_v", packed).where(F.col("_side") == 0).select(*kept, *(F.col(f"_v.{v}").alias(v) for v in values))


def action_family(act: Column) -> Column:
    inform = ("Inform-Symptom", "Inform-Etiology", "Inform-Existing_Examination_and_Treatment", "Inform-Basic_Information")
    recommend = ("Inform-Medical_Advice", "Inform-Drug_Recommendation", "Inform-Precautions")
    return F.when(act == "Request-Symptom", "ASK_SYMPTOM").when(act.startswith("Request-"), "ASK_OTHER").when(act == "Diagnose", "DIAGNOSE").when(act.isin(*inform), "CLINICAL_INFORM").when(act.isin(*recommend), "RECOMMEND").otherwise("OTHER")


def prediction_units(turns: DataFrame, taken: DataFrame, key: str = "dialogue_id", context_turns: int = 6) -> tuple[DataFrame, DataFrame]:
    """(features, labels) of doctor turns: a feature row holds the snapshot of the turn before (of -1 for an opening turn) and earlier texts only."""
    said = turns.withColumn("text", F.concat_ws(": ", "speaker", "text"))
    around = context(said, -context_turns, -1, key).where(F.col("speaker") == "doctor")
    taken = with_initial(taken, turns, key)
    previous = taken.select(key, (F.col("turn_index") + 1).alias("turn_index"), F.col("turn_index").alias("input_turn"), "active_count", "distance_since_last")
    unit = stable_id(F.col(key), F.col("turn_index"), F.lit("doctor_action"))
    features = around.join(previous, [key, "turn_index"], "left").select(unit.alias("unit_id"), key, F.col("turn_index").alias("target_turn"), "input_turn", "active_count", "distance_since_last", F.array_join("context", "\n").alias("context_text"))
    labels = turns.where(F.col("speaker") == "doctor").select(unit.alias("unit_id"), "act", action_family(F.col("act")).alias("action_family"))
    return features, labels


def no_leak(features: DataFrame) -> DataFrame:
    return features.agg(F.coalesce(F.bool_and(F.coalesce(F.col("input_turn") < F.col("target_turn"), F.lit(False))), F.lit(True)).alias("no_leak"))
