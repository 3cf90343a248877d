"""Corpora: corpus(text_id long, text string), from lists, frames, TSV files and event tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import settle


class EmptyVocabularyError(ValueError):
    """A corpus without a character has no vocabulary."""


def from_texts(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """An in-memory list; a text's id is its place."""
    return spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")


def from_column(df: DataFrame, text: str, text_id: str | None = None, distinct: bool = True) -> DataFrame:
    """A column as a corpus, empty and null texts left out.

    With text_id, ids are taken from that column and nothing is shuffled: the way for large tables. Without it, the
    (distinct) texts are numbered in their order: dealt by ranges, they are numbered within each and from where those before
    it end.
    """
    d = df.filter(F.length(text) > 0)
    if text_id:
        return d.select(F.col(text_id).cast("long").alias("text_id"), F.col(text).alias("text"))
    d = d.select(F.col(text).alias("text"))
    d = d.distinct() if distinct else d
    return numbered(d, "text").select("text_id", "text")


def numbered(rows: DataFrame, order: str, number: str = "text_id") -> DataFrame:
    """rows with their place in the order of a column, from 0, without gathering them: a row a partition reaches the driver."""
    placed = settle(rows.orderBy(order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    begins, at = [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("k")).orderBy("part").collect():
        begins.append((r.part, at))
        at += r.k
    begin = rows.sparkSession.createDataFrame(begins, "__part long, __begin long")
    placed = placed.withColumn("__part", part).join(F.broadcast(begin), "__part")
    return placed.withColumn(number, F.col("__begin") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__begin", "__m")


def from_tsv(spark: SparkSession, path: str, column: int = 1, header: bool = True) -> DataFrame:
    """One column of a tab-separated file; each line is a text."""
    lines = spark.read.csv(path, sep="\t", header=header, quote="")
    return from_column(lines.select(F.col(lines.columns[column]).alias("text")), "text", distinct=False)


def joined(corpus: DataFrame) -> Column:
    """All texts in order as one, joined by spaces (an aggregate)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_id", "text"))), lambda x: x["text"]), " ")


def non_empty(corpus: DataFrame) -> DataFrame:
    """Texts with a character; an error if none is left."""
    kept = corpus.filter(F.length("text") > 0)
    if kept.isEmpty():
        raise EmptyVocabularyError("the corpus holds no character")
    return kept


def corpus_name(corpus: DataFrame) -> DataFrame:
    """One row: a name that depends on the texts and their order, by an order-free sum of hashes of (id, text)."""
    total = F.coalesce(F.sum(F.xxhash64("text_id", "text").cast("decimal(38,0)")), F.lit(0)).cast("string")
    return corpus.agg(F.lower(F.hex(F.xxhash64(total))).alias("name"), F.count("*").alias("texts"))


def sequences(events: DataFrame, user: str, order: list[str], token: str) -> DataFrame:
    """Token sequences, one for each user: corpus(text_id, tokens)."""
    items = F.array_sort(F.collect_list(F.struct(*order, token)))
    return events.groupBy(F.col(user).cast("long").alias("text_id")).agg(F.transform(items, lambda x: x[token]).alias("tokens"))
