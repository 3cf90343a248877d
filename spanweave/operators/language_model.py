"""Queries of the substring language model: probabilities, continuations, backoff, contexts and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity
from .search import substrings


def conditional(vocab: DataFrame) -> DataFrame:
    """v, x, p: P(x | v) = count(x) / count(v) for every proper prefix v of x. Prefixes are cut, then met by equality."""
    x = vocab.filter("n > 1").select(F.col("ngram").alias("x"), F.col("cnt").alias("x_cnt"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    x = x.withColumn("v", F.substring("x", F.lit(1), F.col("k")))
    v = vocab.select(F.col("ngram").alias("v"), F.col("cnt").alias("v_cnt"))
    return x.join(v, "v").select("v", "x", (F.col("x_cnt") / F.col("v_cnt")).alias("p"))


def continuations(vocab: DataFrame, width: int = 1) -> DataFrame:
    """v, w, p: how likely `width` characters w follow v, out of all occurrences of v."""
    x = vocab.filter(F.col("n") > width).select("ngram", "cnt", (F.col("n") - width).alias("k"))
    x = x.select(F.substring("ngram", F.lit(1), F.col("k")).alias("v"), F.substring("ngram", F.col("k") + 1, F.lit(width)).alias("w"), "cnt")
    v = vocab.select(F.col("ngram").alias("v"), F.col("cnt").alias("v_cnt"))
    return x.join(v, "v").select("v", "w", (F.col("cnt") / F.col("v_cnt")).alias("p"))


def most_likely(cont: DataFrame) -> DataFrame:
    """v, w, p: the likeliest continuation of each v, ties to the first in order."""
    best = cont.groupBy("v").agg(F.min(F.struct((-F.col("p")).alias("q"), F.col("w"))).alias("b"))
    return best.select("v", F.col("b.w").alias("w"), (-F.col("b.q")).alias("p"))


def backoff(contexts: DataFrame, cont: DataFrame) -> DataFrame:
    """context, used, w, p: continuations of the longest suffix of each context that has any."""
    c = contexts.filter(F.length("context") > 0)
    c = c.select("context", F.explode(F.sequence(F.lit(1), F.length("context"))).alias("k")).withColumn("v", F.expr("right(context, k)"))
    used = c.join(cont.select("v").distinct(), "v", "left_semi").groupBy("context").agg(F.max("k").alias("k"))
    used = used.select("context", F.expr("right(context, k)").alias("v"))
    return used.join(cont, "v").select("context", F.col("v").alias("used"), "w", "p")


def contexts(vocab: DataFrame, labels: DataFrame) -> DataFrame:
    """node, context: the labels that properly contain a vocabulary entry."""
    inner = substrings(labels).filter("part <> label").select(F.col("part").alias("node"), F.col("label").alias("context"))
    return inner.join(vocab.select(F.col("ngram").alias("node")), "node", "left_semi")


def siblings(edges: DataFrame) -> DataFrame:
    """a, b: different nodes of two characters or more that share a parent, once each way up to a < b."""
    e = edges.filter("child_n > 1").select("parent", "child").distinct()
    return e.select("parent", F.col("child").alias("a")).join(e.select("parent", F.col("child").alias("b")), "parent").filter("a < b").select("a", "b").distinct()


def syntactic(pairs: DataFrame) -> DataFrame:
    """a, b, similarity."""
    return pairs.select("a", "b", similarity(F.col("a"), F.col("b")).alias("similarity"))


def semantic_distance(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, distance: over a's parents, the mean of the least edit distance to a parent of b."""
    up = edges.select("child", "parent").distinct()
    pa, pb = up.select(F.col("child").alias("a"), F.col("parent").alias("pa")), up.select(F.col("child").alias("b"), F.col("parent").alias("pb"))
    d = pairs.join(pa, "a").join(pb, "b").groupBy("a", "b", "pa").agg(F.min(F.levenshtein("pa", "pb")).alias("d"))
    return d.groupBy("a", "b").agg(F.avg("d").alias("distance"))
