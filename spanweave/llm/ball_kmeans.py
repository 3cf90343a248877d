"""Ball k-means: clusters as balls, whose centres and radii tell which centroids a member has to be compared with.

A cluster's ball has its centroid and a radius that no member exceeds. Only centroids within twice the radius can be as near to a
member as its own: the ball's neighbours. A member whose distance d to its own centroid is under half of that to the nearest
neighbour is in the ball's stable core and stays; the others lie in annuli between half the distances to successive
neighbours, and those of the i-th are compared with the i nearest neighbours alone. Distances are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, stage
from .integer_vectors import SUMS, Sums, better, chunks, digest, finite, floors, matrix, own_squares, squares, totals, with_sums


class Balls:
    """Centroids with, for each ball, its neighbours by distance. A radius of None is unknown: all centroids are neighbours."""

    def __init__(self, centroids: np.ndarray, radii: list[int | None]):
        self.centroids = centroids
        gaps = squares(centroids, centroids)
        self.near, self.gaps = [], []
        for a, radius in enumerate(radii):
            others = np.array([j for j in np.argsort(gaps[a], kind="stable").tolist() if j != a and (radius is None or int(gaps[a, j]) <= 4 * radius * radius)], np.int64)
            self.near.append(others)
            self.gaps.append(gaps[a, others])

    def assign(self, x: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(clusters, squared distances, how many distances to other centroids were taken) of rows that were in clusters `old`."""
        index, dist, taken = old.astype(np.int64), own_squares(x, self.centroids[old]), 0
        for a in np.unique(old).tolist():
            rows, near = np.flatnonzero(old == a), self.near[a]
            annulus = np.searchsorted(self.gaps[a], 4 * dist[rows], side="right")  # how many neighbours can be as near; 0: the stable core
            for k in range(1, len(near) + 1):
                ring = rows[annulus == k]
                if len(ring):
                    d, i = dist[ring], index[ring]
                    better(d, i, squares(x[ring], self.centroids[near[:k]]), near[:k])
                    dist[ring], index[ring] = d, i
                    taken += len(ring) * k
        return index, dist, taken


def _up(square: int) -> int:
    """The square root, rounded up."""
    return isqrt(square - 1) + 1 if square > 0 else 0


def _pass(rows: DataFrame, balls: Balls, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(balls)
    k, width = balls.centroids.shape
    wanted = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = shared.value, Sums(k, width)
        for t in chunks(batches):
            x = matrix(t.column("q").combine_chunks(), width)
            cluster, dist, _ = held.assign(x, t.column("cluster").to_numpy().astype(np.int64))
            sums.add(cluster, x, dist)
            out = {name: t.column(name).combine_chunks() for name in ("vec_id", "q")} | {"cluster": pa.array(cluster), "distance": pa.array(dist)}
            yield from with_sums(out, len(x), None, wanted)
        yield from with_sums({}, 0, sums, wanted)

    return rows.mapInArrow(run, schema)


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x). Centroids start as the vectors with the `clusters` smallest SHA-256 (in hex) of seed and
    id; each of `rounds` rounds assigns every vector to its nearest centroid (ties: the smaller number) and makes every centroid
    the floored mean of its vectors, one without any staying; then vectors are assigned once more. distance is the final
    squared distance, summed over the cluster and over all in the other two.

    Sums and largest distances are added up by task, so only `clusters` rows a round pass the driver, and a cluster that holds
    most vectors is no single task. A radius is the largest distance to the last centroid plus the way that it moved, rounded up.
    Nulls: only vectors of exactly `width` components, none null or non-finite, take part. A null id hashes as the empty
    text; equal ids are ordered by vector; repeated rows count each. Fewer vectors than `clusters` make fewer clusters; an
    empty table gives no rows. A component beyond 2^27 is an error. Further columns are not read.
    """
    kept = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].alias("v")).filter(finite(F.col("v"))).filter(F.size("v") == width)
    kept = stage(kept.select("vec_id", floors(F.col("v"), scale).alias("q"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "balls")
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r.q for r in kept.select(h.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()]
    if not first:
        return kept.select("vec_id", "cluster", "distance", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit(digest([])).alias("centroid_sha256"))
    centroids, radii = np.array(first, np.int64), [None] * len(first)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", " + SUMS
    table, inertia = kept.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ") for x in SUMS.split(", "))]), {}
    for k in range(rounds + 1):
        before, table = table if k else kept, stage(_pass(table.filter("cell IS NULL"), Balls(centroids, radii), schema), "balls")
        discard(before)
        if k < rounds:
            moved, radii = centroids.copy(), [0] * len(first)
            for cell, (n, total, most) in totals(table).items():
                moved[cell] = np.array(total, np.int64) // n
                radii[cell] = _up(most) + _up(int(own_squares(moved[cell : cell + 1], centroids[cell : cell + 1])[0]))
            centroids = moved
    each = table.filter("cell IS NULL")
    inertia = {r.cluster: int(r.s) for r in each.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    pick = lambda of, kind: F.element_at(F.array(*[F.lit(of(c)).cast(kind) for c in range(len(first))]), F.col("cluster") + 1)
    return each.select(
        "vec_id", "cluster", "distance", pick(lambda c: inertia.get(c, 0), "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        pick(lambda c: digest(centroids[c].tolist()), "string").alias("centroid_sha256"),
    )


def _oracle(rounds: int = 10, clusters: int = 8) -> str:
    sql = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, q FROM v QUALIFY k < {clusters})"""
    for r in range(rounds + 1):
        sql += f""",
    a{r} AS MATERIALIZED (SELECT vec_id, v.q AS q, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT, k := c.k)) AS m FROM v, c{r} c GROUP BY vec_id, v.q)"""
        if r < rounds:
            sql += f""",
    n{r} AS (SELECT k, list(f ORDER BY i) AS q FROM (SELECT m.k AS k, i, floor(sum(q[i]) / count(*)) AS f FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY m.k, i) GROUP BY k),
    c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n.q, c.q) AS q FROM c{r} c LEFT JOIN n{r} n USING (k))"""
    return sql + f"""
    SELECT vec_id, m.k::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
      sha256(list_aggregate(list_transform(c.q, lambda z: (z::BIGINT)::VARCHAR), 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m.k"""


ORACLE = _oracle()
