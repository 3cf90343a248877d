"""Packing documents into padded batches with optimal length buckets.

A global histogram of lengths goes through dynamic programming, which places the bucket bounds so that padding is least;
inside each bucket, documents form batches under a token budget. Lengths are counted in words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, word_count


def edge(length: Column) -> Column:
    """The upper edge of a length's histogram bin: lengths below 65,536 have their own bins, then 32,768 bins an octave.

    So the histogram's size on the driver is bounded for any input, and bounds are optimal unless texts have 65,536 words.
    """
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(length)) - 16)).cast("long")
    return F.floor((length + step - 1) / step).cast("long") * step


def place(ident: Column, text: Column) -> Column:
    """Where a row ranks in its bucket: the first 60 bits of the MD5 of its id, or of its text if it has none."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), text, F.lit(""))), 1, 15), 16, 10).cast("long")


def _layer(best: np.ndarray, e: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j from 1 the least best[i] + cost(i + 1, j) over i < j, and the first such i.

    That i never falls as j grows, since later edges weigh the same documents more. So every second j left is searched between
    the i of its neighbours on both sides, all of a round at once.
    """
    n = len(e)
    least, first = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    step = 1 << max(0, (n - 1).bit_length() - 1)
    while step:
        js = np.arange(step, n, 2 * step)
        lo, after = first[js - step], js + step
        hi = np.where(after < n, np.minimum(first[np.minimum(after, n - 1)], js - 1), js - 1)
        width = hi - lo + 1
        start = np.cumsum(width) - width
        group = np.repeat(np.arange(len(js)), width)
        i, j = np.arange(len(group)) - start[group] + lo[group], js[group]
        cand = best[i] + e[j] * (c[j + 1] - c[i + 1]) - (t[j + 1] - t[i + 1])
        if len(js):
            least[js] = np.minimum.reduceat(cand, start)
            hit = np.flatnonzero(cand == least[j])
            first[js] = i[hit[np.unique(group[hit], return_index=True)[1]]]
        step //= 2
    return least, first


def optimal_bounds(edges: list[int], counts: list[int], totals: list[int], n_buckets: int) -> list[int]:
    """The at most n_buckets bounds, each an edge, that minimise the sum of (bound - length).

    cost(i, j) = edges[j] * count(i..j) - total(i..j); best[k][j] = min over i of best[k-1][i] + cost(i+1, j).
    Ties take the earliest i, and the fewest buckets that reach the least padding.
    """
    n = len(edges)
    if not n:
        return []
    e = np.array(edges, np.int64)
    c = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    t = np.concatenate([[0], np.cumsum(np.array(totals, np.int64))])
    best = e * c[1:] - t[1:]
    back, rounds = [np.full(n, -1)], [best[-1]]
    for _ in range(1, min(n_buckets, n)):
        least, first = _layer(best, e, c, t)
        back.append(np.where(least < best, first, -2))  # -2: a bucket less does as well
        best = np.minimum(least, best)
        rounds.append(best[-1])
    k, j, bounds = int(np.argmin(rounds)), n - 1, []
    while j >= 0:
        bounds.append(edges[j])
        while back[k][j] == -2:
            k -= 1
        j = int(back[k][j])
        k -= 1
    return bounds[::-1]


def pack(docs: DataFrame, n_buckets: int = 16, budget: int = 16384, shard_rows: int = 50_000,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_tokens, bucket (from 0), bucket_len (padded length), batch (from 0 in its bucket), slot, padding.

    A batch holds max(1, budget // bucket_len) documents, all batches of a bucket but its last being full; a document longer
    than the budget has a batch of its own. Ranks in a bucket follow a hash of the id, then id, length and text; they are counted
    per (bucket, shard), shards being ranges of that hash, and offset by the shards before, with as many shards as the row count
    needs, so a bucket with most rows is never one task.
    Nulls: a null text has length 0 and lies in the first bucket; a row with a null id is placed by its text. Rows with equal ids and texts get ranks of their own, in any order. Empty input gives no rows. Further columns pass through unchanged.
    """
    names = docs.columns
    h = place(docs[id_col], docs[text_col]).alias("__sw_h")
    rows = docs.select(*[docs[c].alias(f"__sw_{i}") for i, c in enumerate(names)], word_count(docs[text_col]).alias("n_tokens"), h, F.xxhash64(docs[text_col]).alias("__sw_t"))
    slim = stage(rows.select("__sw_h", "n_tokens"), "lengths")
    hist = slim.groupBy("n_tokens").agg(F.count("*").alias("n")).groupBy(edge(F.col("n_tokens")).alias("e")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n_tokens")).alias("s")).orderBy("e").collect()
    bounds = optimal_bounds([r.e for r in hist], [r.n for r in hist], [r.s for r in hist], n_buckets) or [0]
    total = sum(r.n for r in hist)
    shards = max(1, -(-total // shard_rows))
    at = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    shard = F.shiftright(F.shiftright("__sw_h", 28) * F.lit(shards), 32)
    rows = rows.withColumn("bucket", bucket).withColumn("__sw_shard", shard)
    inner = Window.partitionBy("bucket", "__sw_shard").orderBy("__sw_h", f"__sw_{names.index(id_col)}", "n_tokens", "__sw_t")
    sizes = stage(slim.groupBy(bucket.alias("bucket"), shard.alias("__sw_shard")).agg(F.count("*").alias("__sw_n")), "shards")
    before = Window.partitionBy("bucket").orderBy("__sw_shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("bucket").alias("__sw_b"), F.col("__sw_shard").alias("__sw_s"), F.coalesce(F.sum("__sw_n").over(before), F.lit(0)).alias("__sw_before"))
    rows = rows.withColumn("__sw_r", F.row_number().over(inner) - 1)
    rows = rows.join(sizes, (rows["bucket"] == sizes["__sw_b"]) & (rows["__sw_shard"] == sizes["__sw_s"]))
    rank, length = F.col("__sw_before") + F.col("__sw_r"), F.element_at(at, F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(length, F.lit(1)))).cast("long")
    own = {"n_tokens", "bucket", "bucket_len", "batch", "slot", "padding"}
    return rows.select(
        *[F.col(f"__sw_{i}").alias(c) for i, c in enumerate(names) if c not in own],
        "n_tokens", F.col("bucket").cast("int").alias("bucket"), length.alias("bucket_len"),
        F.floor(rank / room).cast("long").alias("batch"), (rank % room).cast("long").alias("slot"), (length - F.col("n_tokens")).alias("padding"),
    )


def _oracle(n_buckets: int = 16, budget: int = 16384) -> str:
    """pack() in DuckDB SQL: the dynamic program holds every pair of edges against each other in each round."""
    rounds = "".join(
        f"""b{k} AS MATERIALIZED (SELECT o.j, least(o.cost, x // 10000000) AS cost, CASE WHEN x // 10000000 < o.cost THEN x % 10000000 ELSE -2 END AS f
  FROM b{k - 1} o LEFT JOIN (SELECT b.j, min((p.cost + b.e * (b.c - a.c) - (b.t - a.t)) * 10000000 + a.j) AS x
    FROM e b JOIN e a ON a.j < b.j JOIN b{k - 1} p ON p.j = a.j GROUP BY b.j) USING (j)),
"""
        for k in range(2, n_buckets + 1)
    )
    every = " UNION ALL ".join(f"SELECT {k} AS k, j, cost, coalesce(f, -2) AS f FROM b{k}" for k in range(1, n_buckets + 1))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(doc_id::VARCHAR, text, '') AS name, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
bins AS (SELECT n_tokens, 1::BIGINT << greatest(0, length(bin(n_tokens)) - 16) AS step FROM d),
hist AS (SELECT (n_tokens + step - 1) // step * step AS e, count(*) AS n, sum(n_tokens) AS s FROM bins GROUP BY 1),
e AS MATERIALIZED (SELECT row_number() OVER w - 1 AS j, e::HUGEINT AS e, (sum(n) OVER w)::HUGEINT AS c, (sum(s) OVER w)::HUGEINT AS t FROM hist WINDOW w AS (ORDER BY e)),
b1 AS MATERIALIZED (SELECT j, e * c - t AS cost, -1::HUGEINT AS f FROM e),
{rounds}back AS MATERIALIZED ({every}),
path AS (SELECT * FROM (SELECT k, j FROM back WHERE j = (SELECT max(j) FROM e) ORDER BY cost, k LIMIT 1)
  UNION ALL SELECT p.k - 1, CASE WHEN f = -2 THEN p.j ELSE f END FROM path p JOIN back USING (k, j) WHERE f <> -1),
bounds AS (SELECT e AS bound, row_number() OVER (ORDER BY e) - 1 AS bucket FROM e WHERE j IN (SELECT j FROM path)),
placed AS (SELECT doc_id, n_tokens, bucket, bound, ('0x' || md5(name)[1:15])::BIGINT AS h
  FROM (SELECT n_tokens, min(bound) AS bound, min(bucket) AS bucket FROM (SELECT DISTINCT n_tokens FROM d) JOIN bounds ON n_tokens <= bound GROUP BY 1) JOIN d USING (n_tokens)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, doc_id, n_tokens) - 1 AS r, greatest(1, {budget} // greatest(1, bound)) AS room FROM placed)
SELECT doc_id, n_tokens, bucket::INTEGER AS bucket, bound::BIGINT AS bucket_len, (r // room)::BIGINT AS batch, (r % room)::BIGINT AS slot, (bound - n_tokens)::BIGINT AS padding FROM ranked
"""


#: op5's rows where ids are unique.
ORACLE = _oracle()
