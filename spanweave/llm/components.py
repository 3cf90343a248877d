"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, root): each node of an edge with the smallest node of its component.

    Every round rewires neighbours to the smallest one seen, with a groupBy that has partial aggregation and a join that
    can be split; a hub's neighbours are never gathered in one task. Rounds end when no edge changes; there are about
    log(nodes) of them. Each round's edges are a table in the shared folder, so a lost executor costs one round.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the smallest of the neighbours and oneself
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and oneself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = stage(small, "edges")
        seen = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(now)
        now = new
        if mark == seen:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
