"""Question packets, annotation checks, write scopes and agreement votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions.text import matching
from turnwise.functions.vocab import ANNOTATION_FIELDS, PROPOSITION_FIELDS


def write_scopes(a: dict[str, Column], status: Column) -> tuple[Column, Column]:
    """(existence scope, facet scope) that an annotation may write to."""
    when, existence, facet = a["temporality"], a["existence_effect"], a["facet_effect"]
    barred = (status == "HOLD_META_DISAGREEMENT") | ~a["target_binding"].isin("DIRECT_TARGET", "TARGET_FACET") | (a["subject"] != "patient")
    by_time = F.when(when == "current", "CURRENT").when(when == "historical", "HISTORY").otherwise("NONE")
    one = F.when(barred, "NONE").when((existence == "MOVE_TO_HISTORY") & when.isin("current", "historical"), "CURRENT_TO_HISTORY").when(existence.isin("HOLD", "NO_EXISTENCE_CHANGE"), "NONE").otherwise(by_time)
    two = F.when(barred, "NONE").when((facet == "UPDATE_CURRENT_FACET") & (when == "current"), "CURRENT").when((facet == "UPDATE_HISTORICAL_FACET") & (when == "historical"), "HISTORY").otherwise("NONE")
    return one, two


def annotation_errors(a: dict[str, Column], packet_id: Column, question: Column, answer: Column, fields=None, empty_quote: bool = True) -> Column:
    """Names of the fields of an annotation that break their rule, in order."""
    fields = fields or ANNOTATION_FIELDS
    facets = [f for f in ANNOTATION_FIELDS["question_facet"] if f != "unclear"]
    bad = [(name, ~F.coalesce(a[name].isin(*values), F.lit(False))) for name, values in fields.items()]
    if "packet_id" in a:
        bad.append(("packet_id", ~a["packet_id"].eqNullSafe(packet_id)))
    for name, text in (("question_quote", question), ("answer_quote", answer)):
        bad.append((name, ~F.coalesce(text.contains(a[name]), F.lit(False))))
    bad.append(("updated_facets", ~F.coalesce(F.forall(a["updated_facets"], lambda x: F.coalesce(x.isin(*facets), F.lit(False))), F.lit(False))))
    if "confidence" in a:
        bad.append(("confidence", ~F.coalesce(a["confidence"].between(0, 1), F.lit(False))))
    return matching(bad)


def proposition_errors(proposed: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, errors by packet) of proposed (packet_id, ord, card_id, fields, evidence_quote, source_text, confidence): an
    id must be an anchor's, the first row of an id counts, enums, quote and confidence must hold, and anchors without a row are missing."""
    w = W.partitionBy("packet_id", "card_id").orderBy("ord")
    allowed = anchors.select("packet_id", "card_id").withColumn("allowed", F.lit(True))
    known = proposed.join(allowed, ["packet_id", "card_id"], "left").withColumn("nth", F.row_number().over(w))
    fine = F.col("source_text").contains(F.col("evidence_quote")) & F.col("confidence").between(0, 1)
    for name, values in PROPOSITION_FIELDS.items():
        fine = fine & F.col(name).isin(*values)
    error = F.when(F.col("allowed").isNull() | (F.col("nth") > 1), "invalid_or_duplicate_card_id").when(~F.coalesce(fine, F.lit(False)), F.concat(F.lit("invalid_schema:"), "card_id"))
    checked = known.withColumn("error", error)
    missing = anchors.select("packet_id", "card_id").join(proposed.select("packet_id", "card_id"), ["packet_id", "card_id"], "left_anti").groupBy("packet_id").agg(F.count("*").alias("n"))
    errors = checked.where(F.col("error").isNotNull()).select("packet_id", "error").unionByName(missing.select("packet_id", F.concat(F.lit("missing_anchor_count:"), F.col("n")).alias("error")))
    return checked.where(F.col("error").isNull()).drop("error", "allowed", "nth"), errors


def packets(turns: DataFrame, asks: Column, key: str = "dialogue_id", before: int = 4, after: int = 1) -> DataFrame:
    """Adjacent doctor question and patient answer with the texts from ``before`` turns earlier to ``after`` later."""
    w = W.partitionBy(key).orderBy("turn_index")
    near = F.collect_list(F.struct("speaker", "text", "turn_index")).over(w.rowsBetween(-before, after))
    paired = turns.withColumn("asks", asks & (F.col("speaker") == "doctor")).withColumn("answer", F.lead("text").over(w)).withColumn("answered", F.lead("speaker").over(w) == "patient").withColumn("local_context", near)
    return paired.where(F.col("asks") & F.col("answered")).select(key, "turn_index", F.col("text").alias("question"), "answer", "local_context")


def last_mentions(targets: DataFrame, mentions: DataFrame, k: int = 3, key: str = "dialogue_id") -> DataFrame:
    """The last k mentions before each target (key, concept, turn_index), with their place from the nearest.

    Mentions are numbered; a running count tells each target the numbers it wants, so at most k rows a target are joined.
    """
    by = [key, "concept"]
    m = mentions.select(*by, F.col("turn_index").alias("mention_turn"), F.row_number().over(W.partitionBy(*by).orderBy("turn_index")).alias("number"))
    sides = targets.select(*by, "turn_index", F.lit(0).alias("seen")).unionByName(mentions.select(*by, "turn_index", F.lit(1).alias("seen")))
    upto = sides.withColumn("count", F.sum("seen").over(W.partitionBy(*by).orderBy("turn_index", "seen").rowsBetween(W.unboundedPreceding, 0))).where("seen = 0")  # at one turn the target stands first
    wanted = upto.where("count > 0").select(*by, "turn_index", F.explode(F.sequence(F.greatest(F.lit(1), F.col("count") - k + 1), F.col("count")).cast("array<int>")).alias("number"), "count")
    return wanted.join(m, [*by, "number"]).select(*by, "turn_index", "mention_turn", (F.col("count") - F.col("number") + 1).alias("nth"))


def signature(fields: list[Column], facets: Column) -> Column:
    """Order of facets counts."""
    return F.to_json(F.struct(*(c.alias(f"f{i}") for i, c in enumerate(fields)), facets.alias("facets")))


def vote(candidates: DataFrame, key: str, source_order: tuple[str, ...], least: int = 2) -> DataFrame:
    """The signature that ``least`` sources share, from the first of them in the order; else a hold. (key, signature, picked, sources, status)"""
    place = F.array_position(F.array(*map(F.lit, source_order)), F.col("source"))
    counted = candidates.groupBy(key, "signature").agg(F.count("*").alias("n"), F.min(F.struct(place.alias("p"), "source"))["source"].alias("picked"), F.min(place).alias("p"))
    best = counted.groupBy(key).agg(F.min_by(F.struct("signature", "picked", "n"), F.struct(-F.col("n"), "p")).alias("b"))
    held = F.col("b.n") < least
    return best.select(key, F.when(~held, F.col("b.signature")).alias("signature"), F.when(~held, F.col("b.picked")).alias("picked"), F.when(held, 0).otherwise(F.col("b.n")).cast("long").alias("agreeing"), F.when(held, "HOLD_META_DISAGREEMENT").otherwise("ADAPTIVE_META_MAJORITY").alias("status"))


def disputes(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that both have and whose signatures differ: only these need another pass."""
    return first.select(key, F.col("signature").alias("a")).join(second.select(key, F.col("signature").alias("b")), key).where(~F.col("a").eqNullSafe(F.col("b")))


def blind_guard(split: str, blind: tuple[str, ...] = ("test",), allowed: bool = False) -> None:
    """Refuses a blind partition unless it is allowed expressly."""
    if split in blind and not allowed:
        raise PermissionError(f"the partition {split!r} is blind")


HOLD = "HOLD_META_DISAGREEMENT"


def coverage(final: DataFrame, by: list[str] | None = None, least: float = 0.90) -> DataFrame:
    """Rows, shares with a settled label, on hold and with authority, and whether the settled share reaches the checkpoint."""
    n, held = F.count("*"), F.col("label_status") == HOLD
    out = final.groupBy(*(by or [])).agg(n.alias("rows"), (F.count_if(~held) / F.greatest(n, F.lit(1))).alias("silver_coverage"), (F.count_if(held) / F.greatest(n, F.lit(1))).alias("hold_rate"), (F.count_if("state_authority") / F.greatest(n, F.lit(1))).alias("state_authority_rate"))
    return out.withColumn("checkpoint_pass", F.col("silver_coverage") >= least)


def gate(final: DataFrame, errors: Column, most_invalid: float = 0.005, views: int = 2) -> DataFrame:
    """One row of the counts and tests that a teacher's final labels must pass; scopes are worked out again and compared.

    ``final`` has label_status, state_authority, agreement_sources, existence_write_scope, facet_write_scope and the fields that scopes need.
    """
    held = F.col("label_status") == HOLD
    one, two = write_scopes({c: F.col(c) for c in ("temporality", "existence_effect", "facet_effect", "target_binding", "subject")}, F.col("label_status"))
    settled, authority = F.count_if(~held), F.col("state_authority")
    counts = final.agg(
        F.count("*").alias("rows"),
        settled.alias("silver_count"),
        (F.count_if(~held & (F.size(errors) > 0)) / F.greatest(settled, F.lit(1))).alias("invalid_rate"),
        F.count_if(held & authority).alias("hold_with_authority"),
        F.count_if(~(one.eqNullSafe(F.col("existence_write_scope")) & two.eqNullSafe(F.col("facet_write_scope")))).alias("scope_mismatches"),
        F.count_if(authority & ~F.col("subject").eqNullSafe("patient")).alias("nonpatient_with_authority"),
        F.count_if(authority & ~F.coalesce(F.col("target_binding").isin("DIRECT_TARGET", "TARGET_FACET"), F.lit(False))).alias("unbound_with_authority"),
        F.count_if(~held & (F.size(F.array_distinct("agreement_sources")) < views)).alias("too_few_views"),
    )
    tested = counts.withColumns({
        "schema_and_quotes_valid": F.col("invalid_rate") <= most_invalid,
        "views_agree": F.col("too_few_views") == 0,
        "hold_has_no_authority": F.col("hold_with_authority") == 0,
        "scopes_valid": (F.col("scope_mismatches") + F.col("nonpatient_with_authority") + F.col("unbound_with_authority")) == 0,
    })
    return tested.withColumn("gate_pass", F.col("schema_and_quotes_valid") & F.col("views_agree") & F.col("hold_has_no_authority") & F.col("scopes_valid"))
