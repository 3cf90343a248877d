"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, html_extract, language_id, line_dedup, mixing, ngram_model, packing, permutation_index, quality_rules, secret_scan, simhash, suffix_dedup, vector_codes
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.judge(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_groups(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", "text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return d.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def op12_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.score(table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_suffix_dedup, op3_simhash, op4_permutation_index, op5_packing, op6_html_extract, op7_line_dedup, op8_secret_scan, op9_language_id, op10_mixing, op11_vector_codes, op12_ngram_trie, op13_ball_kmeans, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE, "op2_suffix_dedup": suffix_dedup.ORACLE, "op5_packing": packing.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op10_mixing": mixing.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op13_ball_kmeans": ball_kmeans.ORACLE}
