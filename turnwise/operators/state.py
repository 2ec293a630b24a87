"""State of tracked entities: operations, ordered folds, trajectories, episodes.

The state before an event is decided by the previous existence event alone, so the fold is a window with lag; ``fold`` is
the general form for any transition table, over the sorted events of one episode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions.vocab import PRESENT_OPERATIONS


def transition(state: Column, operation: Column) -> Column:
    return F.when(operation.isin(*PRESENT_OPERATIONS), "present").when(operation == "RETRACT_EXISTENCE", "absent").when(operation == "RESOLVE", "resolved").otherwise(state)


def operation_for(facet: Column, assertion: Column, previous: Column) -> Column:
    return F.when(facet != "existence", "UPDATE_FACET").when(assertion == "negative", "RETRACT_EXISTENCE").when(previous.isin("absent", "resolved"), "RECUR").otherwise("ASSERT_EXISTENCE")


def collapse(evidence: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """Evidence of one assertion about one concept in one turn as one event: the first row by place, and all ids."""
    by = [key, "subject", "concept", "facet", "assertion", "turn_index"]
    first = F.struct("char_start", "card_id")
    return evidence.groupBy(*by).agg(F.min(first).alias("first"), F.array_sort(F.collect_list("card_id")).alias("supporting_card_ids")).select(*by, F.col("first.char_start").alias("char_start"), F.col("first.card_id").alias("card_id"), "supporting_card_ids")


def derive(events: DataFrame, episode: list[str], order: list[str]) -> DataFrame:
    """previous_state, operation, new_state, state_changed and gap of every event (facet, assertion, turn_index)."""
    w = W.partitionBy(*episode).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    after = F.when(F.col("facet") == "existence", F.when(F.col("assertion") == "negative", "absent").otherwise("present"))
    previous = F.coalesce(F.last(after, ignorenulls=True).over(before), F.lit("unknown"))
    out = events.withColumn("previous_state", previous).withColumn("operation", operation_for(F.col("facet"), F.col("assertion"), F.col("previous_state")))
    out = out.withColumn("new_state", transition(F.col("previous_state"), F.col("operation")))
    return out.withColumn("state_changed", F.col("new_state") != F.col("previous_state")).withColumn("gap", F.col("turn_index") - F.lag("turn_index").over(w))


def fold(operations: Column, start: str = "unknown") -> Column:
    """State after an array of operations in order."""
    return F.aggregate(operations, F.lit(start), transition)


def trajectory(operations: Column, first: Column, last: Column, n: Column) -> Column:
    """Class of an episode from its operations, first and last state and number of existence events; branches in this order."""
    gone = ("absent", "resolved")
    return (
        F.when(n == 0, "facet_only")
        .when(F.array_contains(operations, "RECUR"), "recurred_after_absence")
        .when((first == "present") & last.isin(*gone), "present_to_absent")
        .when(first.isin(*gone) & (last == "present"), "absent_to_present")
        .when(F.array_contains(operations, "WORSEN"), "persistent_worsening")
        .when(F.array_contains(operations, "IMPROVE"), "persistent_improving")
        .otherwise(F.concat(F.when(n > 1, "persistent_").otherwise("single_"), last))
    )


def episodes(derived: DataFrame, episode: list[str], order: list[str], cutoff: str | None = None) -> DataFrame:
    """A row for each episode: trajectory, current state, first and last turn, evidence; with a cutoff column also the state before it."""
    facts = F.col("facet") == "existence"
    place = F.struct(*order)
    early = facts & ((F.col("turn_index") < F.col(cutoff)) | F.col(cutoff).isNull()) if cutoff else None
    more = [] if cutoff is None else [
        F.coalesce(F.max_by(F.when(early, F.col("new_state")), F.when(early, place)), F.lit("unknown")).alias("pre_cutoff_state"),
        F.count_if(early).alias("pre_cutoff_evidence"),
    ]
    out = derived.groupBy(*episode).agg(
        F.collect_set(F.when(facts, F.col("operation"))).alias("operations"),
        F.min_by(F.when(facts, F.col("new_state")), F.when(facts, place)).alias("first_state"),
        F.max_by(F.when(facts, F.col("new_state")), F.when(facts, place)).alias("last_state"),
        F.count_if(facts).alias("existence_events"),
        F.min("turn_index").alias("first_turn"),
        F.max("turn_index").alias("last_turn"),
        F.count("*").alias("evidence_count"),
        *more,
    )
    return out.withColumn("trajectory", trajectory(F.col("operations"), F.col("first_state"), F.col("last_state"), F.col("existence_events"))).withColumn("current_state", F.coalesce("last_state", F.lit("unknown"))).drop("operations", "first_state", "last_state")


def links(mentions: DataFrame, found: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """Mentions of the other side joined to the episode of their concept; of several subjects the least episode id."""
    one = found.groupBy(key, "concept").agg(F.min("episode_id").alias("episode_id"))
    return mentions.join(one, [key, "concept"], "left")


CONTRACT = {
    "present_then_negative_is_absent": (["ASSERT_EXISTENCE", "RETRACT_EXISTENCE"], "absent"),
    "negative_then_present_is_present": (["RETRACT_EXISTENCE", "ASSERT_EXISTENCE"], "present"),
    "resolved_then_recur_is_present": (["ASSERT_EXISTENCE", "RESOLVE", "RECUR"], "present"),
    "facet_does_not_change_existence": (["ASSERT_EXISTENCE", "UPDATE_FACET"], "present"),
}
