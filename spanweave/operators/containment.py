"""The containment graph: vocabulary with roots and leaves, edges to the closest neighbours, degrees, propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ngrams import occurrences
from ..plans.tables import settle


def vocabulary(corpus: DataFrame, max_n: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """vocab(ngram, n, cnt, is_root, is_leaf, first_root, closed) in one aggregation, the only shuffle of n-grams.

    is_root: equal to a whole text. first_root: whole at its first sighting in corpus order (which depends on that order).
    closed: no extension by one character, on either side, has the same count. only(ngram) restricts it to those n-grams.
    """
    occ = occurrences(corpus, max_n)
    occ = occ if only is None else occ.join(only, "ngram", "left_semi")
    occ = occ.withColumn("whole", F.col("prev").isNull() & F.col("next").isNull())
    v = occ.groupBy("ngram").agg(
        F.count("*").alias("cnt"), F.max("whole").alias("is_root"), F.min_by("whole", F.struct("text_id", "pos")).alias("first_root"),
        *[f(c).alias(f"{c}_{f.__name__}") for c in ("prev", "next") for f in (F.count, F.min, F.max)],
    )
    same = lambda c: (F.col(f"{c}_count") == F.col("cnt")) & (F.col(f"{c}_min") == F.col(f"{c}_max"))
    closed = ~F.coalesce(same("next"), F.lit(False)) & ~F.coalesce(same("prev"), F.lit(False))
    n = F.length("ngram")
    return v.select("ngram", n.alias("n"), "cnt", "is_root", (n == 1).alias("is_leaf"), "first_root", closed.alias("closed"))


def edges(vocab: DataFrame) -> DataFrame:
    """containment_edge: prefix and last character, first character and suffix; one pattern for two characters, none for one.

    A projection: each n-gram yields its own two or four rows.
    """
    n, g = F.col("n"), F.col("ngram")
    part = lambda p, i, at, child: F.struct(F.lit(p).alias("pattern_id"), F.lit(i).alias("sub_index"), at.cast("int").alias("offset"), child.alias("child"))
    left = [part(0, 0, F.lit(0), F.substring(g, F.lit(1), n - 1)), part(0, 1, n - 1, F.substring(g, n, F.lit(1)))]
    right = [part(1, 0, F.lit(0), F.substring(g, 1, 1)), part(1, 1, F.lit(1), F.substring(g, F.lit(2), n - 1))]
    cells = F.when(n == 2, F.array(*left)).otherwise(F.array(*left, *right))
    d = vocab.filter("n > 1").select(g.alias("parent"), n.alias("parent_n"), F.explode(cells).alias("x"))
    return d.select("parent", "parent_n", "x.*", F.length("x.child").alias("child_n"))


def bottom_up(edge: DataFrame) -> DataFrame:
    """(child, parent): the parents one character wider than the child."""
    return edge.filter("parent_n = child_n + 1").select("child", "parent").distinct()


def degrees(edge: DataFrame) -> DataFrame:
    """node, parents, children, patterns (distinct counts)."""
    up = edge.groupBy(F.col("child").alias("node")).agg(F.countDistinct("parent").alias("parents"))
    down = edge.groupBy(F.col("parent").alias("node")).agg(F.countDistinct("child").alias("children"), F.countDistinct("pattern_id").alias("patterns"))
    both = up.join(down, "node", "full")
    return both.select("node", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("parents", "children", "patterns")])


def neighbourhood(edge: DataFrame) -> DataFrame:
    """(node, direction, neighbour): distinct parents (up) and children (down) of every node."""
    up = edge.select(F.col("child").alias("node"), F.lit("up").alias("direction"), F.col("parent").alias("neighbour"))
    down = edge.select(F.col("parent").alias("node"), F.lit("down").alias("direction"), F.col("child").alias("neighbour"))
    return up.union(down).distinct()


def by_width(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("n").agg(F.count("*").alias("nodes"), F.sum("cnt").alias("occurrences"))


def widest_first(vocab: DataFrame) -> DataFrame:
    return vocab.orderBy(F.desc("n"), "ngram")


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """The n-grams of a that b has too."""
    return a.join(b.select("ngram"), "ngram", "left_semi")


def edge_offsets(edge: DataFrame) -> DataFrame:
    """(parent, child, offsets): where in the parent the child lies, as a sorted array."""
    return edge.groupBy("parent", "child").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))


def propagated_counts(corpus: DataFrame, edge: DataFrame) -> DataFrame:
    """ngram, n, cnt from the whole texts' places, passed down the edges one width a round, each place kept once."""
    widest = corpus.agg(F.max(F.length("text"))).first()[0] or 0
    roots = corpus.filter(F.length("text") > 0).select(F.col("text").alias("ngram"), "text_id", F.lit(0).alias("pos"))
    cells = settle(edge.select(F.col("parent").alias("ngram"), "child", F.col("offset").alias("shift")).distinct(), "cells")
    level, every = settle(roots.filter(F.length("ngram") == widest), "level"), []
    for n in range(widest, 0, -1):
        every.append(level.groupBy("ngram").agg(F.count("*").alias("cnt")))
        if n > 1:
            down = level.join(cells, "ngram").filter(F.length("child") == n - 1).select(F.col("child").alias("ngram"), "text_id", (F.col("pos") + F.col("shift")).alias("pos"))
            # children that are two or more narrower (single characters) come again one width a round from the others
            level = settle(down.union(roots.filter(F.length("ngram") == n - 1)).distinct(), "level")
    out = every[0]
    for d in every[1:]:
        out = out.union(d)
    return out.select("ngram", F.length("ngram").alias("n"), "cnt")
