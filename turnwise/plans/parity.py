"""Queries over projections, routing, belief history, gates and evaluation tables, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators import belief, evaluate, evidence, project, quality, teacher
from turnwise.plans.catalog import EVIDENCE_SQL, TURNS_SQL, query, table, turns
from turnwise.plans.catalog import evidence as demo_evidence


@query("""select conv_id as dialogue_id, count(*) as n, string_agg(conv_id || '_t' || lpad(turn::varchar, 3, '0') || '=' || role, ',' order by turn) as annotations from conversations group by 1""")
def label_plane(spark, sf_dir) -> DataFrame:
    """The labels of each dialogue's turns (here the raw role), in order, without any text."""
    t = turns(spark, sf_dir)
    out = project.label_plane(t.select("dialogue_id").distinct(), t, (), ("role",))
    each = F.transform("turn_annotations", lambda x: F.concat(x["turn_id"], F.lit("="), x["role"]))
    return out.select("dialogue_id", F.size("turn_annotations").cast("long").alias("n"), F.array_join(each, ",").alias("annotations"))


@query("""select conv_id || '-' || turn as packet_id, 'c' as target_concept, text as doctor_question, next_text as patient_answer from (select *, lead(role) over w as next_role, lead(turn) over w as next_turn, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn)) where role = 'assistant' and next_role = 'user' and next_turn = turn + 1""")
def compact_packets(spark, sf_dir) -> DataFrame:
    """Question packets cut to their allowed fields; reference columns don't leave."""
    q = evidence.question_answer(turns(spark, sf_dir), "dialogue_id", F.col("role") == "assistant", F.col("role") == "user")
    whole = q.select(F.concat_ws("-", "dialogue_id", "q_turn").alias("packet_id"), F.lit("x").alias("reference_label"), F.struct(F.lit("c").alias("target_concept"), F.col("question").alias("doctor_question"), F.col("answer").alias("patient_answer"), F.lit("secret").alias("gold")).alias("input"))
    return project.compact(project.without_prefix(whole), fields=("target_concept", "doctor_question", "patient_answer"))


@query(f"""with c as (select *, case when speaker = 'patient' and length(text) >= 40 then 'accepted_current_symptom' else 'bounded_review_hold' end as route from ({TURNS_SQL}))
select route, route = 'accepted_current_symptom' as state_change_allowed, count(*) as n from c group by 1, 2 union all select 'proxy_calibrated_nli_authority', true, count(*) from c where route = 'bounded_review_hold' and turn_index % 3 = 0""")
def routing_with_authority(spark, sf_dir) -> DataFrame:
    """Card routes and the sixth, by union: every third turn on hold is authorised."""
    t = turns(spark, sf_dir).withColumn("card_id", F.concat_ws("-", "dialogue_id", "turn_index")).withColumn("route", F.when((F.col("speaker") == "patient") & (F.length("text") >= 40), "accepted_current_symptom").otherwise("bounded_review_hold"))
    given = t.where((F.col("route") == "bounded_review_hold") & (F.col("turn_index") % 3 == 0)).withColumn("authorization_id", F.concat(F.lit("a-"), F.col("card_id")))
    return evidence.routing(t, given).groupBy("route", "state_change_allowed").agg(F.count("*").alias("n"))


_KINDS = "case when turn_index % 2 = 0 then 'dialogue' else 'report' end"


@query(f"""with e as (select dialogue_id, turn_index, concept || '/' || turn_index as id, {_KINDS} as kind from ({EVIDENCE_SQL})), t as ({TURNS_SQL}),
g as (select t.dialogue_id, t.turn_index, count(e.id) as evidence_count, count(*) filter (e.kind = 'dialogue') as a, count(*) filter (e.kind = 'report') as b, md5(coalesce(string_agg(e.id, '|' order by e.turn_index, e.id), '')) as transition_ids_hash from t left join e on e.dialogue_id = t.dialogue_id and e.turn_index <= t.turn_index group by 1, 2),
h as (select dialogue_id, turn_index, count(*) filter (contains(text, '?')) over (partition by dialogue_id order by turn_index) as holds from t)
select g.*  exclude (a, b), concat_ws(',', case when a > 0 then 'dialogue=' || a end, case when b > 0 then 'report=' || b end) as evidence_by_source, holds from g join h using (dialogue_id, turn_index)""")
def belief_history(spark, sf_dir) -> DataFrame:
    """Cumulative evidence by source, ids and holds at each turn."""
    e = demo_evidence(spark, sf_dir).select("dialogue_id", "turn_index", F.concat_ws("/", "concept", "turn_index").alias("transition_id"), F.when(F.col("turn_index") % 2 == 0, "dialogue").otherwise("report").alias("source_kind"))
    t = turns(spark, sf_dir)
    return belief.history(t, e, t.where(F.col("text").contains("?")).select("dialogue_id", "turn_index"))


_FINAL_SQL = """select event_id, user_id % 2 as split, case when value < 10 then 'HOLD_META_DISAGREEMENT' else 'DIRECT_CROSS_MODEL_AGREEMENT' end as label_status, value >= 30 as state_authority from events"""


def _final(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") < 10, teacher.HOLD).otherwise("DIRECT_CROSS_MODEL_AGREEMENT")
    return e.select("event_id", (F.col("user_id") % 2).alias("split"), "event_type", "value", status.alias("label_status"), (F.col("value") >= 30).alias("state_authority"))


_COVERAGE = "select split, count(*) as rows, avg((label_status not like 'HOLD%')::int) as silver_coverage, avg((label_status like 'HOLD%')::int) as hold_rate, avg(state_authority::int) as state_authority_rate, avg((label_status not like 'HOLD%')::int) >= 0.9 as checkpoint_pass"


@query(f"{_COVERAGE} from ({_FINAL_SQL}) group by 1")
def teacher_coverage(spark, sf_dir) -> DataFrame:
    return teacher.coverage(_final(spark, sf_dir), ["split"])


@query(f"""with m as ({_COVERAGE} from ({_FINAL_SQL}) group by 1), a as (select * from m where split = 0), b as (select * from m where split = 1)
select 'silver_coverage' as metric, abs(a.silver_coverage - b.silver_coverage) as delta from a, b union all select 'hold_rate', abs(a.hold_rate - b.hold_rate) from a, b union all select 'state_authority_rate', abs(a.state_authority_rate - b.state_authority_rate) from a, b""")
def split_deltas(spark, sf_dir) -> DataFrame:
    """Absolute differences of the shares between two splits."""
    m = teacher.coverage(_final(spark, sf_dir), ["split"]).withColumn("split", F.when(F.col("split") == 0, "train").otherwise("dev"))
    return evaluate.split_deltas(m, "split", ["silver_coverage", "hold_rate", "state_authority_rate"])


@query("""with f as (select *, value < 10 as held, event_type = 'view' as patient, value >= 30 and event_type = 'view' as authority, case when value < 10 or event_type <> 'view' then 'NONE' else 'CURRENT' end as scope, case when value > 98 then 'HISTORY' when value < 10 or event_type <> 'view' then 'NONE' else 'CURRENT' end as stored, value between 50 and 50.2 as wrong from events)
select count(*) as rows, count(*) filter (not held) as silver_count, count(*) filter (not held and wrong) / greatest(count(*) filter (not held), 1) as invalid_rate, count(*) filter (held and authority) as hold_with_authority, count(*) filter (scope <> stored) as scope_mismatches,
count(*) filter (authority and not patient) as nonpatient_with_authority, 0::bigint as unbound_with_authority, 0::bigint as too_few_views, count(*) filter (not held and wrong) / greatest(count(*) filter (not held), 1) <= 0.005 as schema_and_quotes_valid, true as views_agree, count(*) filter (held and authority) = 0 as hold_has_no_authority,
count(*) filter (scope <> stored) + count(*) filter (authority and not patient) = 0 as scopes_valid, count(*) filter (not held and wrong) / greatest(count(*) filter (not held), 1) <= 0.005 and count(*) filter (held and authority) = 0 and count(*) filter (scope <> stored) + count(*) filter (authority and not patient) = 0 as gate_pass from f""")
def teacher_gate(spark, sf_dir) -> DataFrame:
    """The gate over demo labels: scopes worked out again differ where the stored one is wrong."""
    f = _final(spark, sf_dir)
    patient, held = F.col("event_type") == "view", F.col("value") < 10
    f = f.withColumns({
        "subject": F.when(patient, "patient").otherwise("other"),
        "target_binding": F.lit("DIRECT_TARGET"),
        "temporality": F.lit("current"),
        "existence_effect": F.lit("SET_PRESENT"),
        "facet_effect": F.lit("NO_FACET_UPDATE"),
        "agreement_sources": F.array(F.lit("a"), F.lit("b")),
        "state_authority": F.col("state_authority") & patient,
        "existence_write_scope": F.when(F.col("value") > 98, "HISTORY").when(held | ~patient, "NONE").otherwise("CURRENT"),
        "facet_write_scope": F.lit("NONE"),
    })
    return teacher.gate(f, F.when(F.col("value").between(50, 50.2), F.array(F.lit("answer_quote"))).otherwise(F.array().cast("array<string>")))


@query("""select field, value, count(*) as n from (select 'event_type' as field, '"' || event_type || '"' as value from events union all select 'user_id', user_id::varchar from events) group by 1, 2""")
def json_value_counts(spark, sf_dir) -> DataFrame:
    return evaluate.value_counts(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("""select 'quality' as field, avg((quality = 1)::int - (quality = doc_id % 2)::int) as mean_delta from labels where quality is not null and toxic is not null union all select 'toxic', avg((toxic = 0)::int - (toxic = doc_id % 2)::int) from labels where quality is not null and toxic is not null""")
def field_deltas(spark, sf_dir) -> DataFrame:
    """Two runs over the same rows: one says the parity of the id, the other always the more frequent label."""
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    parity = (F.col("doc_id") % 2).cast("int")
    return evaluate.field_deltas(rows, {"quality": (F.col("quality").cast("int"), parity, F.lit(1)), "toxic": (F.col("toxic").cast("int"), parity, F.lit(0))})


@query("""with g as (select user_id, event_id, event_type as gold from events where value > 20), p as (select user_id, event_id, case when value > 60 then 'view' when value > 30 then event_type end as concept from events)
select count(*) filter (concept = gold) / greatest(count(*), 1) as accuracy, count(*) as evaluable from p join g using (user_id, event_id) where concept is not null""")
def normalisation_accuracy(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cards = e.select("user_id", "event_id", F.lit("Symptom").alias("entity_type"), F.when(F.col("value") > 60, "view").when(F.col("value") > 30, F.col("event_type")).alias("canonical_concept"))
    return evaluate.normalisation(cards, e.where("value > 20").select("user_id", "event_id", F.col("event_type").alias("concept")), ["user_id", "event_id"])


@query("""with s as (select value > 5 as valid, [event_type, 'x'] as gold, case when event_id % 4 = 0 then ['x', 'y'] else ['x', event_type, 'x'] end as pred, case when event_id % 3 = 0 then 'q' else event_type end as quote, event_type from events)
select count(*) as rows, count(*) filter (valid and list_sort(list_distinct(gold)) = list_sort(list_distinct(pred))) / count(*) as facets_exact, count(*) filter (valid and quote = event_type) / count(*) as quotes_exact from s""")
def set_and_quote_exactness(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    gold = F.array(F.col("event_type"), F.lit("x"))
    pred = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"), F.col("event_type"), F.lit("x")))
    quote = F.when(F.col("event_id") % 3 == 0, "q").otherwise(F.col("event_type"))
    return evaluate.exactness(e, F.col("value") > 5, {"facets": (gold, pred)}, {"answer": (F.col("event_type"), quote)})


@query(" union all ".join(f"select '{m}' as measure, {q}::double as q, quantile_cont({x}, {q / 100})::double as value from conversations" for m, x in (("chars", "length(text)"), ("turn", "turn")) for q in (0, 50, 95, 99, 100)))
def length_percentiles(spark, sf_dir) -> DataFrame:
    """Percentiles of several measures in one pass over counted values."""
    c = table(spark, sf_dir, "conversations").select(F.length("text").alias("chars"), "turn")
    out = quality.percentiles(c, ["chars", "turn"])
    return out


@query(f"""select dialogue_id, turn_index, 0::bigint as active_count from (select dialogue_id, -1::bigint as turn_index from ({TURNS_SQL}) group by 1)""")
def initial_snapshots(spark, sf_dir) -> DataFrame:
    """The snapshot before a dialogue's first turn."""
    t = turns(spark, sf_dir)
    none = t.where(F.lit(False)).select("dialogue_id", F.col("turn_index").cast("long").alias("turn_index"), F.lit(0).cast("long").alias("active_count"))
    return belief.with_initial(none, t)
