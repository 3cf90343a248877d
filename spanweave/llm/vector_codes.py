"""Vector codes: each part of a vector is replaced by the number of its nearest codebook entry.

Codebooks are fitted to all rows by rounds of exact integer k-means. A part's nearest entry is found by exponion search: it starts
at the entry of the round before, a, at distance u. Any entry that is as near lies within 2 * u of a (and, once a nearer one at
distance b is known, within u + b), so only that beginning of a's list of entries, sorted by their distance to a, is scanned, in
annuli that double in size. Distances are exact integers; ties go to the lower entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, stage
from .integer_vectors import SUMS, Sums, better, chunks, digest, finite, floors, lists, matrix, own_squares, squares, totals, with_sums


class Codebook:
    """The entries of one part, each with its list of all entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = squares(entries, entries)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entries, squared distances, how many distances were taken) of the rows of x, searched from the entries `start`."""
        from_start = own_squares(x, self.entries[start])
        index, dist, taken = start.astype(np.int64), from_start.copy(), len(x)
        by = np.argsort(start, kind="stable")
        held, at = np.unique(start[by], return_index=True)
        for a, rows in zip(held.tolist(), np.split(by, at[1:]), strict=True):
            lo, size = 0, 8
            while len(rows) and lo < len(self.entries):
                hi = min(lo + size, len(self.entries))
                among = self.order[a, lo:hi]
                d, i = dist[rows], index[rows]
                better(d, i, squares(x[rows], self.entries[among]), among)
                dist[rows], index[rows] = d, i
                taken += len(rows) * (hi - lo)
                lo, size = hi, size * 2
                if lo < len(self.entries):
                    # the radius in doubles, widened by more than their rounding
                    radius = (np.sqrt(from_start[rows].astype(np.float64)) + np.sqrt(d.astype(np.float64))) ** 2 * (1 + 1e-9) + 1
                    rows = rows[self.gaps[a, lo] <= radius]
        return index, dist, taken


def _assign(rows: DataFrame, books: list[np.ndarray], schema: str, last: bool) -> DataFrame:
    """The rows with new codes and errors; before the last round also, per task, the sums of the parts of each entry."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, width = len(books), books[0].shape[1]
    wanted = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Codebook(b) for b in shared.value]
        sums = Sums(parts * 256, width)
        for t in chunks(batches):
            x, old = matrix(t.column("q").combine_chunks(), parts * width), matrix(t.column("code").combine_chunks(), parts)
            code, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p, book in enumerate(tables):
                piece = x[:, p * width : (p + 1) * width]
                code[:, p], dist, _ = book.nearest(piece, old[:, p])
                error += dist
                if not last:
                    sums.add(p * 256 + code[:, p], piece, dist)
            out = {name: t.column(name).combine_chunks() for name in ("vec_id", "label", "q")} | {"code": lists(code), "error": pa.array(error)}
            yield from with_sums(out, len(x), None, wanted)
        yield from with_sums({}, 0, sums, wanted)

    return rows.mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
             id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code (array<int>, one entry a part), error, label_error, codebooks_sha256.

    Components become floor(scale * x). Each of the `parts` codebooks starts as that part of the `entries` (256 at most)
    rows with the smallest ids (ties by vector; null ids last) and is refitted in `rounds` rounds, an entry becoming the
    floored mean of its parts; one without parts stays. error sums a row's final squared distances, label_error those
    of all rows with its label, null labels together.

    Only the codebooks, parts * entries rows, pass the driver. Each round reads and writes the integer vectors once, with
    their codes, and drops the table before.
    Nulls: vectors null or holding null or non-finite components are dropped, and so are vectors whose length is not the most
    frequent one (ties: the longer) or no multiple of `parts`. Repeated rows count each; fewer rows than `entries` make
    smaller codebooks; an empty table gives no rows. A component beyond 2^27 is an error. Further columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vec_col].alias("v"))
    kept = kept.filter(finite(F.col("v"))).filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    kept = stage(kept.select("vec_id", "label", floors(F.col("v"), scale).alias("q"), F.array_repeat(F.lit(0), parts).alias("code"), F.lit(0).cast("long").alias("error")), "codes")
    most = kept.groupBy(F.size("q").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if most is None:
        return kept.select("vec_id", "label", "code", "error", F.col("error").alias("label_error"), F.lit(digest([])).alias("codebooks_sha256"))
    width = most.w // parts
    rows = kept.filter(F.size("q") == most.w)
    first = np.array([r.q for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()], np.int64)
    books = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", " + SUMS
    null = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ") for x in SUMS.split(", "))]
    table = rows.select("*", *null)
    for k in range(rounds + 1):
        before, table = table if k else kept, stage(_assign(table.filter("cell IS NULL"), books, schema, k == rounds), "codes")
        discard(before)
        if k < rounds:
            for cell, (n, total, _) in totals(table).items():
                books[cell // 256][cell % 256] = np.array(total, np.int64) // n
    sums = stage(table.filter("cell IS NULL").groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    out = table.filter("cell IS NULL").select("vec_id", "label", "code", "error")
    out = out.join(sums.withColumnRenamed("label", "__l"), out["label"].eqNullSafe(F.col("__l")))
    text = digest(v for b in books for v in b.ravel().tolist())
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(text).alias("codebooks_sha256"))


def _oracle(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    sql = f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    w AS (SELECT len(q) // {parts} AS w FROM v LIMIT 1),
    x AS MATERIALIZED (SELECT vec_id, label, p, s, list_inner_product(s, s) AS ss FROM (SELECT vec_id, label, p, q[p * w + 1:p * w + w] AS s FROM v, w, (SELECT unnest(range({parts})) AS p))),
    b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s, ss FROM x QUALIFY e < {entries})"""
    for k in range(rounds + 1):
        sql += f""",
    a{k} AS MATERIALIZED (SELECT vec_id, label, p, s, min(struct_pack(d := (x.ss - 2 * list_inner_product(x.s, b.s) + b.ss)::BIGINT, e := b.e)) AS m
      FROM x JOIN (SELECT p, e, s, ss FROM b{k}) b USING (p) GROUP BY vec_id, label, p, x.s)""".replace("SELECT vec_id, label, p, s,", "SELECT vec_id, label, p, x.s AS s,")
        if k < rounds:
            sql += f""",
    n{k} AS (SELECT p, e, list(f ORDER BY i) AS s FROM (SELECT p, m.e AS e, i, floor(sum(s[i]) / count(*)) AS f FROM a{k}, (SELECT unnest(range(1, w + 1)) AS i FROM w) GROUP BY p, m.e, i) GROUP BY p, e),
    b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.s, b.s) AS s, list_inner_product(coalesce(n.s, b.s), coalesce(n.s, b.s)) AS ss FROM b{k} b LEFT JOIN n{k} n USING (p, e))"""
    return sql + f""",
    r AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(list_aggregate(list_transform(s, lambda z: (z::BIGINT)::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM r"""


ORACLE = _oracle()
