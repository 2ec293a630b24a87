"""A corpus pipeline of five stages; each is a function (spark, docs, sf_dir) -> DataFrame.

Quality classifier (rejected documents go), language ID (texts without a recognisable language go), n-gram Jaccard join (of each
group of near copies the first document stays, ids before none), mixing of sources to target weights (documents repeat or
go), and byte-level BPE. Every stage works on all that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import bpe, classifier, jaccard, langid, mixing
from turnwise.llm.common import materialize, read_table

#: Near copies share 80 % of their five-word shingles or more.
WIDTH, SHARE = 5, 80
_NAME = "turnwise_stage"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go. It learns from the labels of the whole table."""
    model = classifier.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "quality", modulus=5, remainder=0)
    scored = docs.withColumn(_NAME, classifier.scorer(model)("text"))
    return scored.where(F.col(_NAME) >= classifier.THRESHOLD).drop(_NAME)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in whose text no language is found: null, or without a letter."""
    profiles = langid.fit(read_table(spark, sf_dir, "documents"), modulus=4, remainder=2)
    found = docs.withColumn(_NAME, langid.predictor(profiles)("text"))
    return found.where(F.col(f"{_NAME}.lang_pred") != langid.UNKNOWN).drop(_NAME)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document of least id stays, of equal ids that of least text digest; one without an id only if none has one.

    Rows are told apart by id and text: different texts under one id are documents of their own, rows equal in both are one.
    """
    key, root, order = (f"{_NAME}_{x}" for x in ("key", "root", "order"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = jaccard.join(keyed.select(F.col(key).alias("doc_id"), "text"), WIDTH, SHARE).select(F.col("doc_id").alias(key), F.col("component_id").alias(root)).distinct()
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    kept = keyed.select(key, first.alias(order)).join(found, key).groupBy(root).agg(F.min_by(key, order).alias(key)).select(key)
    return keyed.join(materialize(kept), key, "left_semi").dropDuplicates([key]).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole repetitions."""
    return mixing.repeat_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, a row for each repetition."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(docs, ["doc_id"], path, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_copies), ("mixing sources", mixture), ("byte-level BPE", tokens)]

#: SQL can express neither the trained models nor the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
