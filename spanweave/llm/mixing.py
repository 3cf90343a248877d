"""Mixing sources to target weights.

Tokens are summed per source; each source gets a target share of the mixture and from it a repetition rate; a document is
emitted floor(rate) times, and once more with a probability equal to the fraction, drawn from a hash of its id and a seed.
Only slim rows (id, source, size) take part in the one join; source totals are pre-aggregated before any shuffle, so a
source with most of the rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, word_count


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """sizes(source, size) -> one row per source: source, source_size, target.

    Sources in code point order, null last, take the weights in turn and share `share` of all sizes in proportion; a target
    stops at `cap` times its source's size, the excess being reshared by weight among the others until none is above. With
    sources in order of cap/weight that is one prefix: the level is the first one that the next source's cap exceeds.
    The windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    most = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("ratio", most / F.col("weight"))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    heft = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / heft)
    by = by.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "source_size", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), most).otherwise(F.col("level") * F.col("weight"))
    return by.select("source", "source_size", target.cast("double").alias("target"))


def draw(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the key: 52 bits, alike on every engine and in every rerun.

    A null key is replaced by the text's digest, so that rows without an id are drawn each on its own.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(text)), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 11,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, copies (0 to cap), taken = size * copies.

    Nulls: a null text has size 0; null sources form one source, last in order; a null id is drawn by its text.
    Rows with equal ids (or no id, and equal texts) share their draw, so repeated rows are taken alike. A source without words has target 0 and its
    documents are not taken. Empty input gives no rows. Further columns of docs are not read.
    """
    slim = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col), seed).alias("__draw")), "mix")
    targets = source_targets(slim, share, cap, weights).withColumnRenamed("source", "__source")
    rows = slim.join(targets, slim["source"].eqNullSafe(targets["__source"]), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(F.col("__draw") < rate - whole, 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).drop("__draw").withColumn("taken", F.col("size") * F.col("copies"))


def emit(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 11,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: every row of docs, unchanged, as often as mix() takes it.

    Rates depend on the source alone and draws on the id alone, so only the small table of sources is joined: texts are
    not shuffled unless that table outgrows the broadcast threshold.
    """
    slim = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = stage(source_targets(slim, share, cap, weights), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias("__sw_source"), rate.alias("__sw_rate"))
    rows = docs.join(targets, docs[source_col].eqNullSafe(targets["__sw_source"]), "left")
    whole = F.floor("__sw_rate")
    copies = whole + F.when(draw(docs[id_col], docs[text_col], seed) < F.col("__sw_rate") - whole, 1).otherwise(0)
    rows = rows.withColumn("__sw_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return rows.select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, text, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (ARRAY[3, 1, 2])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE / weight AS ratio FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
s4 AS (SELECT *, (SELECT level FROM s3 WHERE ratio > level ORDER BY ratio, source_size, level LIMIT 1) AS lev FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN lev IS NULL OR ratio <= lev THEN source_size * 2.0::DOUBLE ELSE lev * weight END AS target FROM s4),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'text:' || md5(text), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
