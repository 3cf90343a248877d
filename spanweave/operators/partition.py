"""Partition grammars: patterns of children whose concatenation spells the parent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import settle
from .cover import child_cover, inner_intervals, maximal

EDGE = "parent string, pattern_id int, sub_index int, offset int, child string, child_n int"


def partition_static(labels: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """partition_edge of every label of two characters or more (of parents(ngram, n) alone, if given), for labels closed
    under overlap.

    With LP and LS the longest labelled proper prefix and suffix: if they overlap there are two patterns, [LP, rest] and
    [rest, LS]; else the cover tiles the string and is the only pattern.
    """
    inner = inner_intervals(labels, parents)
    n = F.length("parent")
    ends = inner.groupBy("parent").agg(F.max(F.when(F.col("offset") == 0, F.col("child_n"))).alias("lp"), F.max(F.when(F.col("offset") + F.col("child_n") == n, F.col("child_n"))).alias("ls"))
    cell = lambda p, i, at, size: F.struct(F.lit(p).alias("pattern_id"), F.lit(i).alias("sub_index"), at.cast("int").alias("offset"), F.substring("parent", at + 1, size).alias("child"))
    two = F.array(cell(0, 0, F.lit(0), F.col("lp")), cell(0, 1, F.col("lp"), n - F.col("lp")), cell(1, 0, F.lit(0), n - F.col("ls")), cell(1, 1, n - F.col("ls"), F.col("ls")))
    crossed = ends.filter(F.col("lp") + F.col("ls") > n).select("parent", F.explode(two).alias("x")).select("parent", "x.*")
    tiled = maximal(inner).join(ends.filter(F.col("lp") + F.col("ls") <= n).select("parent"), "parent", "left_semi")
    place = F.row_number().over(Window.partitionBy("parent").orderBy("offset")) - 1
    tiled = tiled.select("parent", F.lit(0).alias("pattern_id"), place.alias("sub_index"), "offset", "child")
    return crossed.unionByName(tiled).withColumn("child_n", F.length("child"))


def repartitioned(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """partition_edge of the labels `new` from that of the labels `old`: only labels that came or hold one that came or went are
    partitioned again, all others keep their rows."""
    came = new.select("ngram", "n").join(old.select("ngram"), "ngram", "left_anti")
    went = old.select("ngram", "n").join(new.select("ngram"), "ngram", "left_anti")
    changed = settle(came.union(went), "changed")
    holders = inner_intervals(changed, new).select(F.col("parent").alias("ngram")).distinct()
    again = settle(new.select("ngram", "n").join(holders.union(came.select("ngram")).distinct(), "ngram", "left_semi"), "again")
    stays = edges.join(again.union(changed).select(F.col("ngram").alias("parent")), "parent", "left_anti")
    return stays.select("parent", "pattern_id", "sub_index", "offset", "child", "child_n").unionByName(partition_static(new, again))


def pack_lines(parent: str, cells: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """First-fit lines of (offset, width) cells: a cell joins the line with the last start that ends before it.

    Gaps within, before and after a line's cells are filled, so each line spells the parent.
    """
    lines: list[list[tuple[int, int]]] = []
    for at, width in sorted(cells):
        fits = [line for line in sorted(lines, key=lambda x: -x[-1][0]) if sum(line[-1]) <= at]
        if fits:
            fits[0].append((at, width))
        else:
            lines.append([(at, width)])
    full = []
    for line in lines:
        out, end = [], 0
        for at, width in [*line, (len(parent), 0)]:
            if at > end:
                out.append((end, at - end))
            if width:
                out.append((at, width))
            end = at + width
        full.append(out)
    return full


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    parent = pdf["parent"].iloc[0]
    rows = [(parent, p, i, at, parent[at : at + w], w) for p, line in enumerate(pack_lines(parent, list(zip(pdf["offset"], pdf["child_n"], strict=True)))) for i, (at, w) in enumerate(line)]
    return pd.DataFrame(rows, columns=["parent", "pattern_id", "sub_index", "offset", "child", "child_n"])


def partition_lines(cover: DataFrame) -> DataFrame:
    """partition_edge of covers in general, by first-fit lines. A cover that tiles its parent is one line as it stands; only the
    others are packed, one parent's cover at a time. Both are parted by the one shuffle by parent."""
    inside = Window.partitionBy("parent").orderBy("offset")
    step = F.col("offset") - F.coalesce(F.lag(F.col("offset") + F.col("child_n")).over(inside), F.lit(0))
    d = cover.select("parent", "offset", "child", "child_n", step.alias("step"), (F.row_number().over(inside) - 1).alias("sub_index"))
    every = Window.partitionBy("parent")
    d = d.withColumn("tiles", (F.max(F.abs("step")).over(every) == 0) & (F.sum("child_n").over(every) == F.length("parent")))
    tiled = d.filter("tiles").select("parent", F.lit(0).alias("pattern_id"), "sub_index", "offset", "child", "child_n")
    return tiled.unionByName(d.filter("NOT tiles").select("parent", "offset", "child", "child_n").groupBy("parent").applyInPandas(_pack, EDGE))


@dataclass
class Layers:
    """How far partition_graph() came: its tables are replaced together, when a layer is whole."""

    labels: DataFrame | None = None
    layer: DataFrame | None = None
    done: DataFrame | None = None
    edges: list[DataFrame] = field(default_factory=list)


def partition_graph(labels: DataFrame, check: Callable[[], None] = lambda: None, layers: Layers | None = None) -> tuple[DataFrame, DataFrame]:
    """(partition_edge, labels) from the roots down, layer by layer.

    All nodes of a layer use the labels of its start. Unlabelled children become labels, and so do the maximal strings that
    two or more of them share; every new label is partitioned in a later layer. Children are narrower than their parents, so
    there are at most as many layers as the widest label has characters. check is called before each layer, and may raise; a run
    that ended so, or whose jobs were stopped in a layer, goes on with that layer when it is called with the same `layers`.
    """
    at = layers or Layers()
    if at.layer is None:
        known = settle(labels.select("ngram", "n", "kind"), "labels")
        first = settle(known.filter("kind = 'root' AND n > 1").select("ngram", "n"), "layer")
        at.labels, at.layer, at.done = known, first, first.limit(0)
    while not at.layer.isEmpty():
        check()
        edges = settle(partition_lines(child_cover(at.labels, at.layer)), "lines")
        done = settle(at.done.union(at.layer), "done")
        children = edges.filter("child_n > 1").select(F.col("child").alias("ngram"), F.col("child_n").alias("n")).distinct()
        gaps = settle(children.join(at.labels, "ngram", "left_anti"), "gaps")
        inner = gaps.select(F.col("ngram").alias("parent"), "n", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("offset"))
        inner = inner.select("*", F.explode(F.sequence(F.lit(2), F.col("n") - F.col("offset"))).alias("child_n")).filter("child_n < n")
        inner = inner.withColumn("child", F.substring("parent", F.col("offset") + 1, F.col("child_n")))
        common = inner.groupBy("child").agg(F.countDistinct("parent").alias("k")).filter("k > 1").select("child")
        shared = maximal(inner.join(common, "child", "left_semi")).select(F.col("child").alias("ngram"), F.col("child_n").alias("n")).distinct()
        new = gaps.union(shared.select("ngram", "n")).distinct().join(at.labels, "ngram", "left_anti").withColumn("kind", F.lit("partition"))
        grown = settle(at.labels.unionByName(new), "labels")
        below = settle(children.join(done, "ngram", "left_anti"), "layer")
        at.labels, at.layer, at.done, at.edges = grown, below, done, [*at.edges, edges]
    edges = at.edges[0] if at.edges else partition_lines(child_cover(at.labels, at.layer))
    for e in at.edges[1:]:
        edges = edges.union(e)
    return edges, at.labels


def reconstructed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """roots(text) -> (text, spelled): each root spelled by expanding first patterns down to nodes without one."""
    cells = settle(edges.filter("pattern_id = 0").select(F.col("parent").alias("node"), F.col("offset").alias("shift"), "child"), "cells")
    level, letters = settle(roots.select("text", F.col("text").alias("node"), F.lit(0).alias("at")), "spell"), []
    parents = settle(cells.select("node").distinct(), "parents")
    while not level.isEmpty():
        letters.append(level.join(parents, "node", "left_anti").select("text", "node", "at"))
        level = settle(level.join(cells, "node").select("text", F.col("child").alias("node"), (F.col("at") + F.col("shift")).alias("at")), "spell")
    every = letters[0]
    for x in letters[1:]:
        every = every.union(x)
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]), "")
    return every.groupBy("text").agg(spelled.alias("spelled"))


def rule_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """(parent, bounds, given): the patterns of both edge tables as their inner boundaries, those of `first` before those of
    `second`: a pattern of second that has all boundaries of one of first, and so only cuts its cells further, goes."""
    inner = F.sort_array(F.collect_list(F.when(F.col("offset") > 0, F.col("offset"))))
    bounds = lambda edges: edges.groupBy("parent", "pattern_id").agg(inner.alias("bounds")).select("parent", "bounds").distinct()
    a, b = bounds(first), bounds(second)
    coarser = a.select("parent", F.col("bounds").alias("coarse"))
    b = b.join(coarser, (b["parent"] == coarser["parent"]) & (F.size(F.array_except("coarse", "bounds")) == 0), "left_anti")
    return a.withColumn("given", F.lit("first")).unionByName(b.withColumn("given", F.lit("second")))


def digram_report(edges: DataFrame) -> DataFrame:
    """Pairs of neighbouring children with the number of patterns they occur in."""
    after = F.lead("child").over(Window.partitionBy("parent", "pattern_id").orderBy("sub_index"))
    pairs = edges.select("parent", "pattern_id", F.col("child").alias("left"), after.alias("right")).filter("right IS NOT NULL")
    return pairs.groupBy("left", "right").agg(F.count("*").alias("patterns"))


def split_at(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """splits(parent, at) -> (parent, at, pattern_id, sub_index, inner, perfect): the cell that a position falls into."""
    s = splits.select("parent", "at")
    inner = F.col("at") - F.col("offset")
    hit = edges.join(s, "parent").filter("offset <= at AND at < offset + child_n")
    return hit.select("parent", "at", "pattern_id", "sub_index", inner.alias("inner"), (inner == 0).alias("perfect"))


def inner_splits(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """tops(parent, at) -> (parent, at): the ends of inner partitions, which are runs of two or more whole cells of a pattern within
    one partition that neighbouring splits (or the parent's ends) bound. Such a run recurs in the partition, so it becomes a node."""
    end = F.col("offset") + F.col("child_n")
    cells = edges.join(tops.select("parent", "at"), "parent").groupBy("parent", "pattern_id", "sub_index", "offset", "child_n")
    cells = cells.agg(F.max(F.when(F.col("at") <= F.col("offset"), F.col("at"))).alias("lo"), F.bool_or((F.col("at") > F.col("offset")) & (F.col("at") < end)).alias("cut"))
    runs = cells.filter("NOT cut").groupBy("parent", "pattern_id", F.coalesce("lo", F.lit(0)).alias("lo")).agg(F.min("offset").alias("a"), F.max(end).alias("b"), F.count("*").alias("k"))
    ends = runs.filter("k > 1").select("parent", F.explode(F.array("a", "b")).alias("at")).filter((F.col("at") > 0) & (F.col("at") < F.length("parent"))).distinct()
    return ends.join(tops.select("parent", "at"), ["parent", "at"], "left_anti")


def completed(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """splits(parent, at) -> (parent, at, top): those splits, the inner ones they bring about, and what both ask of the nodes below.

    A split within a cell is a top split of the cell's node. A node's inner splits follow from all its top splits, and nodes
    only hold narrower ones, so recomputing both from the roots down settles after as many rounds as the graph is deep.
    """
    same = lambda a, b: a.join(b, ["parent", "at"], "left_anti").isEmpty() and b.join(a, ["parent", "at"], "left_anti").isEmpty()
    asked = settle(splits.select("parent", F.col("at").cast("int").alias("at")).distinct(), "asked")
    tops, settled = asked, False
    while not settled:
        inner = settle(inner_splits(edges, tops), "inner")
        below = split_at(edges.select("parent", "pattern_id", "sub_index", "offset", "child", "child_n"), tops.union(inner)).filter("NOT perfect")
        below = below.join(edges.select("parent", "pattern_id", "sub_index", "child"), ["parent", "pattern_id", "sub_index"])
        new = settle(asked.union(below.select("child", "inner")).distinct(), "tops")
        tops, settled = new, same(new, tops)
    return tops.withColumn("top", F.lit(True)).union(inner.withColumn("top", F.lit(False)))


def joined_partitions(splits: DataFrame) -> DataFrame:
    """splits(parent, at, top) -> (parent, lo, hi, part): the substrings between two split positions or ends that have to be joined.

    That is so if a top split, one that is asked for from outside, lies on either side of them (or at their end).
    """
    d = splits.groupBy("parent", "at").agg(F.max("top").alias("top"))
    tops = d.filter("top").groupBy("parent").agg(F.min("at").alias("first_top"), F.max("at").alias("last_top"))
    ends = d.select("parent", "at").union(d.select("parent", F.lit(0))).union(d.select("parent", F.length("parent"))).distinct()
    pairs = ends.withColumnRenamed("at", "lo").join(ends.withColumnRenamed("at", "hi"), "parent").filter("lo < hi").join(tops, "parent")
    return pairs.filter("lo >= first_top OR hi <= last_top").select("parent", "lo", "hi", F.substring("parent", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("part"))


def joined_patterns(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """partition_edge rows of the nodes that splits(parent, at, top) bring about, and the new ones of their parents.

    Every range of joined_partitions() is one node, whatever pattern or parent it comes from. A range without a split inside
    keeps its parent's patterns, as far as they lie in it, cells at its ends cut. A wider one has a pattern of two narrower
    nodes for each split inside it, and a parent one for each of its top splits. A pattern is known by where it is cut, so
    patterns that several ranges bring about are one row each.
    """
    splits, edges = settle(splits.select("parent", "at", "top"), "splits"), settle(edges.select("parent", "pattern_id", "offset"), "cells")
    ranges = settle(joined_partitions(splits).distinct(), "ranges")
    cuts = splits.select("parent", "at").distinct()
    inside = ranges.join(cuts, "parent").filter("lo < at AND at < hi")
    wider = inside.select(F.col("part").alias("node"), F.array(F.col("at") - F.col("lo")).alias("bounds"))
    whole = splits.filter("top").select(F.col("parent").alias("node"), F.array("at").alias("bounds"))
    alone = ranges.join(inside.select("parent", "lo", "hi").distinct(), ["parent", "lo", "hi"], "left_anti")
    cells = alone.join(edges.select("parent", "pattern_id", "offset"), "parent")
    own = F.sort_array(F.collect_set(F.when((F.col("offset") > F.col("lo")) & (F.col("offset") < F.col("hi")), F.col("offset") - F.col("lo"))))
    kept = cells.groupBy("parent", "lo", "hi", "part", "pattern_id").agg(own.alias("bounds")).filter(F.size("bounds") > 0).select(F.col("part").alias("node"), "bounds")
    rules = settle(wider.union(whole).union(kept).distinct(), "rules")
    rules = rules.withColumn("pattern_id", F.row_number().over(Window.partitionBy("node").orderBy("bounds")) - 1)
    ends = F.concat(F.array(F.lit(0)), "bounds", F.array(F.length("node")))
    out = rules.select("node", "pattern_id", ends.alias("ends"), F.posexplode(F.slice(ends, 1, F.size("bounds") + 1)).alias("sub_index", "offset"))
    child = F.substring("node", F.col("offset") + 1, F.get("ends", F.col("sub_index") + 1) - F.col("offset"))
    return out.select(F.col("node").alias("parent"), "pattern_id", "sub_index", "offset", child.alias("child"), F.length(child).alias("child_n"))
