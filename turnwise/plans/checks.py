"""Queries over look-ups, validators, contracts between tables, transitions, character labels and audits, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.functions import spans, text
from turnwise.functions.vocab import ANNOTATION_FIELDS, PROPOSITION_FIELDS
from turnwise.operators import belief, evaluate, evidence, quality, state, teacher
from turnwise.plans.catalog import TURNS_SQL, query, table, turns
from turnwise.sources import files


@query("""with a as (select event_type as surface, 'c' || min(event_id) as concept from events where event_type <> 'view' group by 1)
select event_id, event_type as surface, concept from events left join a on event_type = surface""")
def alias_lookup(spark, sf_dir) -> DataFrame:
    """Exact look-up of a surface in the alias table; an unknown one has no concept."""
    e = table(spark, sf_dir, "events")
    known = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("surface")).agg(F.concat(F.lit("c"), F.min("event_id")).alias("concept"))
    return evidence.with_concept(e.select("event_id", F.col("event_type").alias("surface")), known)


@query("""select conv_id as dialogue_id, turn as turn_index, conversations.text, user_id, event_type from conversations join events on conv_id = user_id and turn = event_id % 10""")
def turn_annotations(spark, sf_dir) -> DataFrame:
    """Annotations meet the turns that they name; turns without one, and annotations of no turn, go."""
    notes = table(spark, sf_dir, "events").select("user_id", F.col("user_id").alias("dialogue_id"), (F.col("event_id") % 10).alias("turn_index"), "event_type")
    return evidence.annotate(turns(spark, sf_dir).select("dialogue_id", "turn_index", "text"), notes)


_PROPOSED_SQL = """select user_id as packet_id, event_id as ord, event_type as card_id, case when value > 90 then 'nobody' else 'patient' end as subject, case when value < 10 then '' else event_type end as evidence_quote, value / 80 as confidence from events"""
_ANCHOR_SQL = "select distinct c_custkey as packet_id, unnest(['view', 'click', 'error', 'none']) as card_id from customer"


def _propositions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    fixed = [F.lit(values[0]).alias(name) for name, values in PROPOSITION_FIELDS.items() if name != "subject"]
    proposed = e.select(F.col("user_id").alias("packet_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("card_id"), F.when(F.col("value") > 90, "nobody").otherwise("patient").alias("subject"), *fixed, F.when(F.col("value") < 10, "").otherwise(F.col("event_type")).alias("evidence_quote"), F.col("event_type").alias("source_text"), (F.col("value") / 80).alias("confidence"))
    anchors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("packet_id"), F.explode(F.array(*map(F.lit, ("view", "click", "error", "none")))).alias("card_id"))
    return proposed, anchors.distinct()


_CHECKED_SQL = f"""select p.*, a.card_id is null or row_number() over (partition by p.packet_id, p.card_id order by ord) > 1 as unwanted, coalesce(subject = 'patient' and confidence between 0 and 1, false) as fine from ({_PROPOSED_SQL}) p left join ({_ANCHOR_SQL}) a on p.packet_id = a.packet_id and p.card_id = a.card_id"""


@query(f"select packet_id, card_id, ord from ({_CHECKED_SQL}) where not unwanted and fine")
def propositions_valid(spark, sf_dir) -> DataFrame:
    """Proposed rows that pass: the first of an allowed id, with enums, quote and confidence in order."""
    return teacher.proposition_errors(*_propositions(spark, sf_dir))[0].select("packet_id", "card_id", "ord")


@query(f"""select packet_id, case when unwanted then 'invalid_or_duplicate_card_id' else 'invalid_schema:' || card_id end as error, count(*) as n from ({_CHECKED_SQL}) where unwanted or not fine group by 1, 2
union all select packet_id, 'missing_anchor_count:' || count(*), 1 from ({_ANCHOR_SQL}) a where not exists (select 1 from ({_PROPOSED_SQL}) p where p.packet_id = a.packet_id and p.card_id = a.card_id) group by 1""")
def propositions_errors(spark, sf_dir) -> DataFrame:
    errors = teacher.proposition_errors(*_propositions(spark, sf_dir))[1]
    return errors.groupBy("packet_id", "error").agg(F.count("*").alias("n"))


@query("""with a as (select event_id, event_type as f0, value > 50 as hot from events where event_id % 3 <> 0), b as (select event_id, case when value > 70 then 'view' else event_type end as f0, value > 40 as hot from events where event_id % 5 <> 0)
select event_id, a.f0 as first, b.f0 as second from a join b using (event_id) where a.f0 <> b.f0 or a.hot <> b.hot""")
def disputed_signatures(spark, sf_dir) -> DataFrame:
    """Rows that both runs have and whose signatures differ."""
    e = table(spark, sf_dir, "events")
    run = lambda kept, kind, least: e.where(kept).select("event_id", teacher.signature([kind], F.when(F.col("value") > least, F.array(F.lit("hot"))).otherwise(F.array().cast("array<string>"))).alias("signature"))
    out = teacher.disputes(run("event_id % 3 <> 0", F.col("event_type"), 50), run("event_id % 5 <> 0", F.when(F.col("value") > 70, "view").otherwise(F.col("event_type")), 40), "event_id")
    return out.select("event_id", F.get_json_object("a", "$.f0").alias("first"), F.get_json_object("b", "$.f0").alias("second"))


@query("""select count(*) as paired, count(*) filter (a.y <> 1 and b.y = 1) as wins, count(*) filter (a.y = 1 and b.y <> 1) as losses from (select doc_id, quality as y from labels where doc_id % 7 <> 0) a join (select doc_id, toxic as y from labels where doc_id % 3 <> 0) b using (doc_id)""")
def paired_runs(spark, sf_dir) -> DataFrame:
    """Two runs joined on their common keys, then wins and losses of the second."""
    rows = table(spark, sf_dir, "labels")
    both = evaluate.paired(rows.where("doc_id % 7 <> 0").select("doc_id", F.col("quality").alias("y")), rows.where("doc_id % 3 <> 0").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    out = evaluate.paired_table(both, F.col("first.y") == 1, F.col("second.y") == 1)
    return out.select((F.col("wins") + F.col("losses") + F.col("ties_right") + F.col("ties_wrong")).alias("paired"), "wins", "losses")


@query("""select 'orders' as contract, not exists (select o_custkey from orders except all select c_custkey from customer) and not exists (select c_custkey from customer except all select o_custkey from orders) as same_keys union all
select 'labels', not exists (select doc_id from documents except all select doc_id from labels) and not exists (select doc_id from labels except all select doc_id from documents) union all select 'nation', true""")
def key_contracts(spark, sf_dir) -> DataFrame:
    """Whether two tables have the same keys, each as often."""
    t = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("k"))
    pairs = {"orders": (t("orders", "o_custkey"), t("customer", "c_custkey")), "labels": (t("documents", "doc_id"), t("labels", "doc_id")), "nation": (t("nation", "n_nationkey"), t("nation", "n_nationkey"))}
    parts = [quality.same_keys(a, b, "k").select(F.lit(name).alias("contract"), "same_keys") for name, (a, b) in pairs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_STUDENT = ("question_facet", "target_binding", "subject", "temporality", "facet_effect")


@query("""with e as (select event_id % 4 = 0 as bad_subject, event_id % 5 = 0 as bad_time, event_id % 6 = 0 as bad_quote, event_id % 7 = 0 as bad_facet from events)
select error, n from (select 'subject' as error, count(*) filter (bad_subject) as n from e union all select 'temporality', count(*) filter (bad_time) from e union all select 'answer_quote', count(*) filter (bad_quote) from e union all select 'updated_facets', count(*) filter (bad_facet) from e) where n > 0""")
def student_error_histogram(spark, sf_dir) -> DataFrame:
    """Errors of a student's rows (five closed fields, quotes, facets; an empty quote passes), counted by field."""
    fields = {f: ANNOTATION_FIELDS[f] for f in _STUDENT}
    broken = lambda k, bad, good: F.when(F.col("event_id") % k == 0, bad).otherwise(good)
    a = {f: F.lit(values[0]) for f, values in fields.items()}
    a["subject"], a["temporality"] = broken(4, "nobody", a["subject"]), broken(5, F.lit(None), a["temporality"])
    a |= {"question_quote": F.lit(""), "answer_quote": broken(6, "not said", F.col("event_type")), "updated_facets": broken(7, F.array(F.lit("colour")), F.array().cast("array<string>"))}
    rows = table(spark, sf_dir, "events").select(teacher.annotation_errors(a, F.lit(None), F.lit("?"), F.col("event_type"), fields).alias("errors"))
    return evaluate.error_counts(rows, "errors")


_STATES, _OPERATIONS = ("unknown", "present", "absent", "resolved"), ("ASSERT_EXISTENCE", "RECUR", "IMPROVE", "WORSEN", "RETRACT_EXISTENCE", "RESOLVE", "UPDATE_FACET")


@query(f"""select s as state, o as operation, case when o in ('ASSERT_EXISTENCE', 'RECUR', 'IMPROVE', 'WORSEN') then 'present' when o = 'RETRACT_EXISTENCE' then 'absent' when o = 'RESOLVE' then 'resolved' else s end as new_state
from (select unnest({list(_STATES)}) as s) a, (select unnest({list(_OPERATIONS)}) as o) b""")
def transition_table(spark, sf_dir) -> DataFrame:
    """Every operation in every state."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, _STATES))).alias("state")).select("state", F.explode(F.array(*map(F.lit, _OPERATIONS))).alias("operation"))
    return grid.withColumn("new_state", state.transition(F.col("state"), F.col("operation")))


_TOKEN = "case when event_id % 5 = 0 then 'B-Symptom' when event_id % 5 = 1 then 'I-Symptom' when event_id % 5 = 2 then 'I-Drug' else 'O' end"


@query(f"""with t as (select user_id, rn * 3 as s, 1 + event_id % 3 as len, {_TOKEN} as label, value as score from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as rn from events)),
c as (select user_id, s + unnest(range(0, len)) as pos, s, label, score from t),
k as (select *, nullif(substr(label, 3), '') as kind, label like 'B-%' and pos = s as b from c),
m as (select *, case when label = 'O' or b then true else coalesce(lag(kind) over w is distinct from kind or lag(pos) over w <> pos - 1, true) end as starts from k window w as (partition by user_id order by pos)),
i as (select *, sum(starts::int) over (partition by user_id order by pos) as island from m)
select user_id, min(pos) as char_start, max(pos) + 1 as char_end, kind as entity_type, round(avg(score), 6) as confidence from i where label <> 'O' group by user_id, island, kind""")
def char_label_spans(spark, sf_dir) -> DataFrame:
    """Token labels laid on characters, orphans mended, and the spans with their mean score."""
    at = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    tokens = at.select("user_id", ((F.col("rn") - 1) * 3).alias("start"), ((F.col("rn") - 1) * 3 + 1 + F.col("event_id") % 3).alias("end"), F.expr(_TOKEN).alias("label"), F.col("value").alias("score"))
    out = spans.bio_spans(spans.char_labels(tokens, ["user_id"]), ["user_id"], "score")
    return out.select("user_id", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "entity_type", F.round("confidence", 6).alias("confidence"))


@query("""select 'before' as table_name, bool_and(turn - 1 < turn) as no_leak from conversations union all select 'same', bool_and(turn < turn) from conversations union all select 'null', count(*) = 0 from conversations""")
def leak_gate(spark, sf_dir) -> DataFrame:
    """The gate over inputs of the turn before, of the same turn, and without a turn."""
    t = turns(spark, sf_dir).select(F.col("turn_index").alias("target_turn"))
    tested = {"before": t.withColumn("input_turn", F.col("target_turn") - 1), "same": t.withColumn("input_turn", F.col("target_turn")), "null": t.withColumn("input_turn", F.lit(None).cast("int"))}
    parts = [belief.no_leak(df).withColumn("table_name", F.lit(name)) for name, df in tested.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""select dialogue_id, turn_index, len(string_split(trim(text), ' ')) as n, array_to_string(list_sort(list_distinct(string_split(trim(text), ' '))), '、') as words from ({TURNS_SQL})""")
def stripped_words(spark, sf_dir) -> DataFrame:
    """Split after stripping, join again with another mark."""
    words = F.split(text.strip(F.col("text")), " ")
    return turns(spark, sf_dir).select("dialogue_id", "turn_index", F.size(words).cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(words)), "、").alias("words"))


@query("""select 'view' as key, count(*) filter (event_type = 'view') as n from events union all select 'purchase', count(*) filter (event_type = 'purchase') from events union all select 'unheard', 0""")
def counter_map(spark, sf_dir) -> DataFrame:
    """Counts as a map, and look-ups in it with a default."""
    m = quality.as_map(quality.counts(table(spark, sf_dir, "events"), "event_type"))
    asked = F.explode(F.array(*map(F.lit, ("view", "purchase", "unheard"))))
    return m.select(asked.alias("key"), "counts").select("key", F.coalesce(F.try_element_at("counts", F.col("key")), F.lit(0)).alias("n"))


@query("""with e as (select event_id, value / 50 as a, (event_id % 5)::double / 2 as b, 0.5::double as c from events), p as (select *, exp(a) + exp(b) + exp(c) as s from e)
select event_id, round(exp(a) / s, 9) as p0, round(exp(b) / s, 9) as p1, round(exp(c) / s, 9) as p2, case when a >= b and a >= c then 0 when b >= c then 1 else 2 end::bigint as best from p""")
def class_probabilities(spark, sf_dir) -> DataFrame:
    """Softmax of three scores and the first greatest."""
    scores = F.array(F.col("value") / 50, (F.col("event_id") % 5).cast("double") / 2, F.lit(0.5))
    p = table(spark, sf_dir, "events").select("event_id", scores.alias("x")).select("event_id", text.softmax(F.col("x")).alias("p"), text.argmax(F.col("x")).cast("long").alias("best"))
    return p.select("event_id", *(F.round(F.get("p", F.lit(i)), 9).alias(f"p{i}") for i in range(3)), "best")


@query("""select event_id, (event_type = 'view')::int::double as is_view, (event_type = 'click')::int::double as is_click, (event_type = 'error')::int::double as is_error from events""")
def one_hot_features(spark, sf_dir) -> DataFrame:
    kinds = ("view", "click", "error")
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(f"is_{k}") for k, c in zip(kinds, text.one_hot(F.col("event_type"), kinds), strict=True)))


@query("""select count(*) as rows, max(strlen(text)) as longest, count(*) filter (strlen(text) > 300) as over_limit, count(*) filter (strlen(text) > 300) = 0 as passed from conversations""")
def token_audit(spark, sf_dir) -> DataFrame:
    """Lengths against a limit; bytes stand for a tokenizer's count."""
    return evaluate.token_audit(table(spark, sf_dir, "conversations"), F.octet_length("text").cast("long"), 300)


@query("""select event_id, 'system' as role0, 'Say the type.' as content0, 'user' as role1, 'User ' || user_id || ' did what?' as content1, 'assistant' as role2, event_type as content2 from events""")
def training_messages(spark, sf_dir) -> DataFrame:
    """Prompts rendered from columns, as messages."""
    out = evaluate.sft_rows(table(spark, sf_dir, "events"), F.lit("Say the type."), F.format_string("User %d did what?", F.col("user_id")), F.col("event_type"))
    return out.select("event_id", *(F.col("messages")[i][f].alias(f"{f}{i}") for i in range(3) for f in ("role", "content")))


@query("""select event_id, case when event_id % 2 = 0 then 'own' else 'candidate' end as anchor from events where event_id % 2 = 0 or event_id % 3 = 0""")
def anchors_or_candidates(spark, sf_dir) -> DataFrame:
    """Anchors, or else candidates; rows with neither have none."""
    when = lambda k, name: F.when(F.col("event_id") % k == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(evidence.anchors_of(when(2, "own"), when(3, "candidate"))).alias("anchor"))


@query("""with u as (select event_id, user_id % 3 as source_split from events where user_id % 3 = 1) select event_id from u where event_id not in (select event_id from events where event_type = 'view') order by event_id limit 50 offset 20""")
def work_queue(spark, sf_dir) -> DataFrame:
    """One split's rows without output yet, a slice of the queue."""
    e = table(spark, sf_dir, "events").withColumn("source_split", (F.col("user_id") % 3).cast("string"))
    left = files.pending(files.of_split(e, "1"), e.where("event_type = 'view'"), "event_id")
    return files.queue_slice(left, ("event_id",), 20, 50).select("event_id")


@query("""select event_id, 'enum:event_type' as error from events where event_type not in ('view', 'click', 'purchase') union all select event_id, 'required:value' from events where event_id % 50 = 0""")
def table_audit(spark, sf_dir) -> DataFrame:
    """Required fields and closed values: a row for each field that breaks its rule."""
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 50 != 0, F.col("value")))
    return quality.audit_rows(e, "event_id", required=("event_id", "value"), enums={"event_type": ("view", "click", "purchase")})


@query("""with c as (select event_id, 'x ' || event_type as text, event_type from events), g as (select count(*) = count(distinct event_id) as unique_ids, bool_and(substr(text, 3, length(event_type)) = event_type) as span_matches, count(*) filter (event_type = 'error') = 0 as doctor_never_writes, count(*) filter (event_type is null) = 0 as queue_never_writes from c)
select *, case when unique_ids and span_matches and doctor_never_writes and queue_never_writes then 'PASS' else 'REVIEW' end as status from g""")
def card_gates(spark, sf_dir) -> DataFrame:
    """The gates of cards, over cards of which some are a doctor's and yet may write."""
    e = table(spark, sf_dir, "events")
    cards = e.select(F.col("event_id").alias("card_id"), F.concat(F.lit("x "), F.col("event_type")).alias("text"), F.col("event_type").alias("span_text"), F.lit(2).alias("char_start"), (F.length("event_type") + 2).alias("char_end"), F.when(F.col("event_type") == "error", "doctor").otherwise("patient").alias("speaker"), F.lit(True).alias("state_change_allowed"), F.array().cast("array<string>").alias("reasons"))
    return evidence.card_gates(cards)
