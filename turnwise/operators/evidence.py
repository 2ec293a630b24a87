"""Units, cards, aliases, reasons, routes and review packets."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions.text import first_match, fullmatch, java, matching
from turnwise.functions.vocab import BLOCKING_AUTHORITY, DEMO_FACETS


def recode_speaker(role: Column, doctor: str = "assistant") -> Column:
    """One name for the doctor's side; all else is the patient."""
    return F.when(role == doctor, "doctor").otherwise("patient")


def units(turns: DataFrame, openings: DataFrame | None = None, key: str = "dialogue_id") -> DataFrame:
    """Rows (key, turn_index, speaker, text, source): turns, and openings (key, text) as the patient's turn -1."""
    body = turns.select(key, F.col("turn_index").cast("long").alias("turn_index"), "speaker", "text", F.lit("dialogue_turn").alias("source"))
    if openings is None:
        return body
    first = openings.select(key, F.lit(-1).cast("long").alias("turn_index"), F.lit("patient").alias("speaker"), "text", F.lit("self_report").alias("source"))
    return first.unionByName(body)


def cue_conditions(text: Column, speaker: Column, cues) -> list[tuple[str, Column]]:
    return [(name, text.rlike(java(pattern)) & (F.lit(True) if who is None else speaker == who)) for name, pattern, who in cues]


def review_reasons(text: Column, speaker: Column, entity_type: Column, concept: Column, confidence: Column, cues, floor: float = 0.8) -> Column:
    """Names of all rules that hold, in order."""
    fixed = [("doctor_context_only", speaker == "doctor"), ("unresolved_normalization", (entity_type == "Symptom") & concept.isNull()), ("low_ner_confidence", confidence < floor)]
    return matching(fixed + cue_conditions(text, speaker, cues))


def state_change_allowed(speaker: Column, entity_type: Column, concept: Column, reasons: Column, source: Column) -> Column:
    return (speaker == "patient") & (entity_type == "Symptom") & concept.isNotNull() & (F.size(reasons) == 0) & (source == "dialogue_turn")


def default_proposition(allowed: Column) -> Column:
    """Subject, facet, assertion and temporality of a card: settled if it may change state, open else."""
    pick = lambda value: F.when(allowed, F.lit(value)).otherwise(F.lit("unresolved"))
    return F.struct(pick("patient").alias("subject"), pick("existence").alias("facet"), pick("positive").alias("assertion"), pick("current").alias("temporality"))


def route(allowed: Column, review: Column, speaker: Column, entity_type: Column) -> Column:
    """The first route that fits."""
    return (
        F.when(allowed, "accepted_current_symptom").when(review, "bounded_review_hold").when(speaker == "doctor", "doctor_context_only").when(entity_type != "Symptom", "patient_nonstate_fact").otherwise("unresolved_hold")
    )


def routing(cards: DataFrame, authorizations: DataFrame) -> DataFrame:
    """A row for each card with its first route, and one more for each authorization that a calibrated model gave."""
    own = cards.select("card_id", F.col("card_id").alias("source_card_id"), "dialogue_id", "turn_index", "route", (F.col("route") == "accepted_current_symptom").alias("state_change_allowed"))
    more = authorizations.select(F.col("authorization_id").alias("card_id"), F.col("card_id").alias("source_card_id"), "dialogue_id", "turn_index", F.lit("proxy_calibrated_nli_authority").alias("route"), F.lit(True).alias("state_change_allowed"))
    return own.unionByName(more)


def aliases(mentions: DataFrame) -> DataFrame:
    """(surface, concept or null, candidates) from (surface, concept): a concept with strictly more mentions than any other, or else all."""
    counted = mentions.groupBy("surface", "concept").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("r", F.rank().over(W.partitionBy("surface").orderBy(F.desc("n"))))
    best = ranked.groupBy("surface").agg(F.count_if(F.col("r") == 1).alias("tops"), F.min(F.when(F.col("r") == 1, F.col("concept"))).alias("top"), F.array_sort(F.collect_set("concept")).alias("candidates"))
    return best.select("surface", F.when(F.col("tops") == 1, F.col("top")).alias("concept"), "candidates")


def with_concept(spans: DataFrame, table: DataFrame) -> DataFrame:
    """Exact look-up of the surface; a surface that isn't known has no concept."""
    return spans.join(table.where(F.col("concept").isNotNull()).select("surface", "concept"), "surface", "left")


_BLOCK, _PACK = 2000, 500
_SUGGESTED = "surface string, alias string, concept string, similarity double"


def _best(k: int):
    """Batches of (surfaces, aliases), both lists, to the k best aliases of each surface; bounds of the ratio spare most comparisons."""

    def order(x):
        ratio, alias, concept = x
        return ratio, alias is not None, alias or "", concept is not None, concept or ""

    def run(batches):
        for b in batches:
            for surfaces, known in zip(b["surfaces"], b["aliases"], strict=True):
                best = [[] for _ in surfaces]
                match = difflib.SequenceMatcher(None)
                for entry in known:
                    match.set_seq2(entry["alias"] or "")
                    for own, surface in zip(best, surfaces, strict=True):
                        match.set_seq1(surface or "")
                        least = own[-1][0] if len(own) == k else -1.0
                        if match.real_quick_ratio() < least or match.quick_ratio() < least:
                            continue
                        own.append((match.ratio(), entry["alias"], entry["concept"]))
                        own.sort(key=order, reverse=True)
                        del own[k:]
                rows = [(s, a, c, r) for s, own in zip(surfaces, best, strict=True) for r, a, c in own]
                yield pd.DataFrame(rows, columns=["surface", "alias", "concept", "similarity"])

    return run


def suggestions(surfaces: DataFrame, table: DataFrame, k: int = 3) -> DataFrame:
    """The k most similar aliases of each distinct surface, exactly: packs of surfaces meet every block of the alias table by its number.

    A pack and a block keep k aliases for each surface, of which the best remain, so pairs never become rows.
    """
    asked = surfaces.select("surface").distinct()
    blocks, packs = (max(1, -(-df.count() // size)) for df, size in ((table, _BLOCK), (asked, _PACK)))
    entry = F.struct(F.col("surface").alias("alias"), F.col("concept").cast("string").alias("concept"))
    known = table.groupBy(F.pmod(F.xxhash64("surface", "concept"), F.lit(blocks)).alias("block")).agg(F.collect_list(entry).alias("aliases"))
    packed = asked.groupBy(F.pmod(F.xxhash64("surface"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("surface")).alias("s"))
    packed = packed.select(F.transform("s", lambda x: x["surface"]).alias("surfaces"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = packed.join(known, "block").select("surfaces", "aliases").mapInPandas(_best(k), _SUGGESTED)
    w = W.partitionBy("surface").orderBy(F.desc("similarity"), F.desc("alias"), F.desc("concept"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def source_hold(text: Column, span: Column, pattern: str, after_span: str, before_span: str) -> Column:
    """A fixed pattern, or one around the row's own span (which is quoted)."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(span, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return text.rlike(java(pattern)) | F.regexp_like(text, F.concat(quoted, F.lit(after_span))) | F.regexp_like(text, F.concat(F.lit(before_span), quoted))


def anchors_of(anchors: Column, candidates: Column) -> Column:
    return F.when(F.size(anchors) > 0, anchors).otherwise(candidates)


def high_value(anchors: Column, reasons: Column, blocking: tuple[str, ...] = BLOCKING_AUTHORITY) -> Column:
    """All anchors are symptoms with a concept, there is one, and no reason blocks."""
    sound = F.forall(anchors, lambda a: (F.coalesce(a["entity_type"], F.lit("Symptom")) == "Symptom") & a["concept"].isNotNull())
    return (F.size(anchors) > 0) & sound & ~F.coalesce(F.arrays_overlap(reasons, F.array(*map(F.lit, blocking))), F.lit(False))


def facet_hint(text: Column, reasons: Column, patterns=DEMO_FACETS) -> Column:
    return first_match(text, patterns, F.when(F.array_contains(reasons, "facet_resolution_required"), "severity").otherwise("existence"))


def review_packets(cards: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """Cards to review of one turn as one packet: anchors in order, reasons distinct and sorted."""
    return cards.groupBy(key, "turn_index").agg(
        F.array_sort(F.collect_list(F.struct("char_start", "card_id", "span_text", F.col("concept"), "entity_type"))).alias("anchors"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
    )


def question_answer(turns: DataFrame, key: str, asks: Column, answers: Column, short: str | None = None) -> DataFrame:
    """Adjacent pairs in which the first turn asks and the next answers, if ``short`` in a text that it matches as a whole."""
    w = W.partitionBy(key).orderBy("turn_index")
    both = turns.withColumn("asks", asks).withColumn("answers", answers)
    paired = both.withColumn("q_turn", F.lag("turn_index").over(w)).withColumn("q_text", F.lag("text").over(w)).withColumn("asked", F.lag("asks").over(w))
    out = paired.where(F.col("asked") & F.col("answers") & (F.col("q_turn") == F.col("turn_index") - 1))
    if short:
        out = out.where(fullmatch(F.col("text"), short))
    return out.select(key, "q_turn", F.col("turn_index").alias("a_turn"), F.col("q_text").alias("question"), F.col("text").alias("answer"))


def fallback_label(rows: DataFrame, by_turn: DataFrame, by_dialogue: DataFrame) -> DataFrame:
    """A label of the turn, the best by the order 1, 0, 2, or else the dialogue's."""
    rank = F.when(F.col("label") == "1", 0).when(F.col("label") == "0", 1).otherwise(2)
    near = by_turn.groupBy("dialogue_id", "turn_index", "concept").agg(F.min_by("label", rank).alias("near"))
    far = by_dialogue.groupBy("dialogue_id", "concept").agg(F.min_by("label", rank).alias("far"))
    joined = rows.join(near, ["dialogue_id", "turn_index", "concept"], "left").join(far, ["dialogue_id", "concept"], "left")
    return joined.withColumn("label", F.coalesce("near", "far")).drop("near", "far")


def stratified(df: DataFrame, strata: list[tuple[str, Column]], key: str, k: int = 25) -> DataFrame:
    """The k least keys of each stratum; strata may overlap."""
    each = df.withColumn("stratum", F.explode(matching(strata)))
    return each.withColumn("_r", F.row_number().over(W.partitionBy("stratum").orderBy(key))).where(F.col("_r") <= k).drop("_r")


def annotate(turns: DataFrame, notes: DataFrame, key: str = "dialogue_id") -> DataFrame:
    """Turns with the annotations that name them."""
    return turns.join(notes, [key, "turn_index"])


def card_gates(cards: DataFrame) -> DataFrame:
    """One row: ids are unique, spans are what the text has at their place, neither a doctor's card nor one with reasons to review may change state."""
    at = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    never = lambda c: F.count_if(F.coalesce(c & F.col("state_change_allowed"), F.lit(False))) == 0
    one = cards.agg(
        (F.count("*") == F.countDistinct("card_id")).alias("unique_ids"),
        (F.count_if(~at.eqNullSafe(F.col("span_text"))) == 0).alias("span_matches"),
        never(F.col("speaker") == "doctor").alias("doctor_never_writes"),
        never(F.size("reasons") > 0).alias("queue_never_writes"),
    )
    tested = F.col("unique_ids") & F.col("span_matches") & F.col("doctor_never_writes") & F.col("queue_never_writes")
    return one.withColumn("status", F.when(tested, "PASS").otherwise("REVIEW"))
