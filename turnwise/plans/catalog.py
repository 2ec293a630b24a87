"""Registry of queries: each a function (spark, sf_dir) -> DataFrame, with DuckDB SQL for the same rows where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.text import java
from turnwise.operators.evidence import recode_speaker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as dialogue turns; the assistant stands for the doctor."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dialogue_id"), F.col("turn").alias("turn_index"), recode_speaker(F.col("role")).alias("speaker"), "text", "role")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo evidence: a concept word in a patient's turn, negative where the text has a negation."""
    t = turns(spark, sf_dir)
    concepts = F.array(*map(F.lit, CONCEPTS))
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    found = t.withColumn("concept", F.explode(F.array_intersect(concepts, words)))
    negative = F.lower("text").rlike(java(r"\b(no|not|or)\b"))
    return found.select("dialogue_id", "turn_index", "speaker", "concept", F.lit("patient").alias("subject"), F.lit("existence").alias("facet"), F.when(negative, "negative").otherwise("positive").alias("assertion"))


#: Frequent words of the test text that stand for concepts.
CONCEPTS = ("the", "and", "was", "with", "for")

TURNS_SQL = "select conv_id as dialogue_id, turn as turn_index, case when role = 'assistant' then 'doctor' else 'patient' end as speaker, text, role from conversations"
EVIDENCE_SQL = f"""select dialogue_id, turn_index, speaker, concept, case when regexp_matches(lower(text), '\\b(no|not|or)\\b') then 'negative' else 'positive' end as assertion
from (select *, unnest(list_filter([{', '.join(f"'{c}'" for c in CONCEPTS)}], lambda c: list_contains(string_split_regex(lower(text), '[^a-z]+'), c))) as concept from ({TURNS_SQL}))"""
EVENT_STATE_SQL = "select user_id, event_id, ts, event_type, case when event_type = 'error' then 'negative' else 'positive' end as assertion, row_number() over (partition by user_id order by ts, event_id) as turn_index from events"
