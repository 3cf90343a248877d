"""A corpus pipeline: language ID, line dedup, near-duplicate removal by SimHash, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of docs. run() writes every stage's rows as Parquet to the shared folder and rereads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import language_id, line_dedup, mixing, packing, simhash
from spanweave.llm.common import stage, table

#: A document whose language the model gives less than this share is rejected.
MIN_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is uncertain, go. Labels to learn from are those of docs itself."""
    trees = language_id.train(docs)
    keep = {c: docs[c] for c in docs.columns}
    rows = language_id.predict(docs, trees, keep, docs["text"], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return rows.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents of which nothing else is left. n_chars follows the text, if docs has it."""
    rows = line_dedup.dedup_lines(docs)
    rows = rows.filter((F.col("n_dropped") == 0) | (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def _named(docs: DataFrame) -> DataFrame:
    """docs with doc_id as (no_id, doc_id, text hash): rows with a null or repeated id are told apart by their texts."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")).alias("doc_id"), "text")


def _firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component in groups, which are those of _named(docs)."""
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.xxhash64("doc_id.id").alias("__ih"), F.col("doc_id.th").alias("__th")).distinct()
    # one shuffle of texts serves the join and the choice of one of equal rows
    rows = docs.withColumns({"__ih": F.xxhash64("doc_id"), "__th": F.xxhash64("text")}).join(stage(kept, "kept"), ["__ih", "__th"], "left_semi")
    return rows.dropDuplicates(["__ih", "__th"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles have a Jaccard similarity of at least 0.8, one row stays: that with the
    smallest doc_id (null last), then text hash. Rows with equal ids and different texts are each in the group of their text."""
    return _firsts(docs, simhash.near_copies(_named(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: The stages learn a model and iterate; SQL can't express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
