"""The queries that apply each operator, with production parameters, to its whole table; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontam, langid, mixing, oracles, passages, pii, quality_model, quality_rules, simhash, token_rollup, warc
from gristmill.llm._shared import scratch_path, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.classify(docs, quality_model.fit(docs))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates are inserted under the tokenizer's name and another, then revised by real counts, and the other's are deleted."""
    docs, version = table(spark, sf_dir, "documents"), "byte_bpe_50k"
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "tokens"), each_row=True)
    upsert, draft = F.lit("upsert"), token_rollup.estimated_counts(docs, "quarter_bytes")
    rollup.apply(1, draft.union(token_rollup.estimated_counts(docs, version)).withColumn("op", upsert))
    counts = token_rollup.token_counts(docs, version).withColumn("op", upsert)
    rollup.apply(2, counts)
    rollup.apply(2, counts)  # sent twice: counts once
    rollup.apply(3, draft.withColumn("op", F.lit("delete")))
    rollup.compact()
    return rollup.totals()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_warc": op6_warc,
    "op7_source_mixing": op7_source_mixing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_pii": oracles.OP1,
    "op4_quality_rules": oracles.OP4,
    "op6_warc": oracles.OP6,
    "op7_source_mixing": oracles.OP7,
    "op8_benchmark_decontamination": oracles.OP8,
}
