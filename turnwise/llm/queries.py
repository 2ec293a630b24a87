"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import held_out, read_table
from turnwise.llm.oracles import ORACLE_SQL  # noqa: F401


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import tiff

    stored = read_table(spark, sf_dir, "documents").select("doc_id", tiff.text_encoder(width=576)("text").alias("media"))
    keyed = stored.select("doc_id", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = tiff.read_pages(keyed, "media", ["doc_id", "media_bytes", "media_sha256"])
    size = F.octet_length("samples").cast("long")
    return pages.select(
        "doc_id",
        F.regexp_extract("description", r"n_bytes=(\d+)", 1).cast("long").alias("n_bytes"),
        size.alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import mixing

    out = mixing.mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import toxicity

    docs = read_table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), modulus=4, remainder=2)
    out = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), toxicity.scorer(lexicon)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import jaccard

    return jaccard.join(read_table(spark, sf_dir, "documents"), width=3, share=90)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from turnwise.llm import idcode

    written = idcode.write_ids(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    ids = idcode.read_ids(spark, *written)
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from turnwise.llm import bpe

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(read_table(spark, sf_dir, "documents"), ["doc_id"], path, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import quality_rules

    out = quality_rules.apply_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import warc

    pages = read_table(spark, sf_dir, "pages")
    folder, parts = warc.write_archive(pages)
    out = warc.fetch(spark, folder, parts, pages.select(warc.url_key(F.col("url")).alias("key")), payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import langid

    docs = read_table(spark, sf_dir, "documents")
    profiles = langid.fit(docs, modulus=4, remainder=2)
    out = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), langid.predictor(profiles)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.llm import classifier

    docs = read_table(spark, sf_dir, "documents")
    model = classifier.fit(docs, read_table(spark, sf_dir, "labels"), "quality", modulus=5, remainder=0)
    out = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), classifier.scorer(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= classifier.THRESHOLD).cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_tiff_pages, op2_mix_sources, op3_toxicity, op4_jaccard_join, op5_token_ids, op6_byte_bpe, op7_quality_rules, op8_warc_index, op9_language, op10_quality_classifier)
}
