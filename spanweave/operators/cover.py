"""Child covers: the maximal labelled proper sub-intervals of a labelled string."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import settle
from .whole import labelled_prefixes

#: Wider strings are not listed by their substrings.
NARROW = 64


def inner_intervals(labels: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(parent, offset, child, child_n): labelled proper substrings of each labelled string of two characters or more."""
    p = (labels if parents is None else parents).filter("n > 1").select(F.col("ngram").alias("parent"), "n")
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("offset"))
    p = p.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("offset"))).alias("child_n")).filter("child_n < n")
    p = p.withColumn("child", F.substring("parent", F.col("offset") + 1, F.col("child_n")))
    return p.join(labels.select(F.col("ngram").alias("child")), "child", "left_semi").select("parent", "offset", "child", "child_n")


def maximal(intervals: DataFrame, key: str = "parent") -> DataFrame:
    """Intervals (offset, child_n) that lie in no other of their key: those that end beyond all that start before them.

    One ordered pass per key, in place of an anti-join on ranges.
    """
    end = F.col("offset") + F.col("child_n")
    before = Window.partitionBy(key).orderBy("offset", F.desc("child_n")).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("reach", F.max(end).over(before)).filter(F.col("reach").isNull() | (end > F.col("reach"))).drop("reach")


def text_cover(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text_id, offset, child_n): the maximal labelled proper sub-intervals of each text, of any width.

    They are among the longest labels that start at each position; the text itself, if it is a label, gives way to the next.
    """
    best = labelled_prefixes(texts, labels).join(texts.select("text_id", F.length("text").alias("len")), "text_id")
    size = F.when(F.col("n") == F.col("len"), F.col("shorter")).otherwise(F.col("n"))
    return maximal(best.select("text_id", F.col("pos").alias("offset"), size.alias("child_n")).filter("child_n IS NOT NULL"), "text_id")


def child_cover(labels: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(parent, offset, child, child_n): the maximal labelled proper sub-intervals of labels of two characters or more (of
    parents(ngram, n) alone, if given). Parents of up to NARROW characters are compared by all their substrings, in one join;
    wider ones by what starts at each position."""
    p = (labels if parents is None else parents).filter("n > 1")
    narrow = maximal(inner_intervals(labels, p.filter(F.col("n") <= NARROW)))
    wide = settle(p.filter(F.col("n") > NARROW).select(F.monotonically_increasing_id().alias("text_id"), F.col("ngram").alias("text")), "wide")
    if wide.isEmpty():
        return narrow
    rest = text_cover(wide, labels).join(wide, "text_id")
    return narrow.unionByName(rest.select(F.col("text").alias("parent"), "offset", F.substring("text", F.col("offset") + 1, F.col("child_n")).alias("child"), "child_n"))


def overlaps(cover: DataFrame) -> DataFrame:
    """(parent, a, b): offsets of cover intervals that intersect; neighbours that only touch do not.

    A cover's starts and ends rise together, so an interval's partners are found by equality on the parent and a range.
    """
    a = cover.select("parent", F.col("offset").alias("a"), (F.col("offset") + F.col("child_n")).alias("a_end"))
    b = cover.select("parent", F.col("offset").alias("b"))
    return a.join(b, "parent").filter("a < b AND b < a_end").select("parent", "a", "b")


def ranges(cover: DataFrame) -> DataFrame:
    return cover.select("parent", F.col("offset").alias("start"), (F.col("offset") + F.col("child_n")).alias("end")).distinct()


def hull(cover: DataFrame) -> DataFrame:
    """The least range that holds a parent's cover."""
    return cover.groupBy("parent").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("child_n")).alias("end"))
