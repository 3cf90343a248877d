"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots and posted in the inverted files of the first few of them. A query
reads the files of its own nearest pivots only. A file's entries hold their whole order, so the footrule distance of a met pair is
known where it is met: with lists of length k, a shared pivot at places r and s takes 2 * (k - max(r, s)) off the distance
of two disjoint lists. Pairs near enough by footrule are reranked by exact inner products in double precision, each in the
first file where it is met.

How many files a query reads, and the footrule up to which pairs are reranked, are set by measurement: a fixed number of
queries is held against all rows, and both are chosen so that their true neighbours are found at the recall asked for.

Orders are taken where a larger inner product is a smaller angle: rows get one more component that makes their norms equal
(queries get 0 there), and the sample's mean is taken off, so vectors of one narrow cone have different orders too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

OUT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and embedding of rows that take part: no null, non-finite or missing component, and not all zero."""
    v = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good & F.exists("embedding", lambda x: x != 0))


def _pick(rows: np.ndarray, count: int, apart: float = 0.8) -> np.ndarray:
    """`count` rows as unit vectors: the first that are not within cosine `apart` of an earlier one, then the first others."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = (rows / np.where(norms > 0, norms, 1))[norms[:, 0] > 0] if (norms > 0).any() else rows[:1]
    kept: list[int] = []
    for i in range(len(rows)):
        if len(kept) < count and (not kept or (rows[kept] @ rows[i]).max() < apart):
            kept.append(i)
    return rows[kept + np.setdiff1d(np.arange(len(rows)), kept)[: count - len(kept)].tolist()]


class Space:
    """Rows and queries as vectors whose angles order as their inner products do."""

    def __init__(self, sample: np.ndarray):
        self.most, self.mean = np.linalg.norm(sample, axis=1).max(), 0.0
        self.mean = self.rows(sample).mean(axis=0)

    def rows(self, x: np.ndarray) -> np.ndarray:
        n = np.minimum(np.linalg.norm(x, axis=1, keepdims=True), self.most)
        return np.hstack([x, np.sqrt((self.most - n) * (self.most + n))]) - self.mean

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.zeros((len(x), 1))]) - self.mean


def permutations(x: np.ndarray, pivots: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """(rows, k) numbers of the pivots nearest to each row, nearest first, ties to the smaller number (at the last place: to either).

    Taken `block` rows at a time, so that block * pivots products are held, however many rows there are.
    """
    out = np.zeros((len(x), k), np.int16)
    for lo in range(0, len(x), block):
        far = -(x[lo : lo + block] @ pivots.T)
        near = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1) if k < len(pivots) else np.tile(np.arange(len(pivots)), (len(far), 1))
        order = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
        out[lo : lo + block] = np.take_along_axis(near, order, axis=1)
    return out


def weights(perm: np.ndarray, pivots: int, k: int) -> np.ndarray:
    """For each pivot, k less its place in one query's order; negative beyond the first k places, so each place is told apart."""
    out = np.full(pivots, -(1 << 15), np.int32)
    out[perm] = k - np.arange(len(perm))
    return out


def shared(weight: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Half of what the footrule distance of each row's first k places to the query's lacks of that of disjoint lists."""
    return np.minimum(np.maximum(weight[rows[:, :k]], 0), k - np.arange(k, dtype=np.int32)).sum(axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _best(ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` largest scores, ties to the smaller id."""
    if len(score) > 4 * top:
        near = np.flatnonzero(score >= np.partition(score, len(score) - top)[len(score) - top])
        return near[np.lexsort((ids[near], -score[near]))[:top]]
    return np.lexsort((ids, -score))[:top]


class Index:
    """Pivots of one table of vectors of one length, with what its searches need."""

    def __init__(self, good: DataFrame, dim: int, total: int, k: int, posted: int, most_pivots: int):
        self.good, self.dim, self.total = good, dim, total
        count = int(min(most_pivots, max(64, 2 * np.sqrt(total))))
        sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(4 * count).collect()
        sample = np.array([r.embedding for r in sample], np.float64)
        self.space = Space(sample)
        self.pivots = _pick(self.space.rows(sample), count)
        self.k, self.posted = min(k, len(self.pivots)), min(posted, len(self.pivots))

    def calibrate(self, asked: DataFrame, top: int, recall: float, probes: int) -> tuple[int, int]:
        """(files to read, least `shared` of a pair to be reranked) that find `recall` of the true neighbours of `probes` queries.

        The probes are those with the smallest id hashes; every row meets them, a partition at a time, of which each gives its
        own best, so probes * top rows a partition are merged.
        """
        rows = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).collect()
        ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
        space, pivots, k, posted, dim = self.space, self.pivots, self.k, self.posted, self.dim
        perms = permutations(space.queries(x), pivots, len(pivots))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, own = _matrix(batch.column(1), dim).astype(np.float64), batch.column(0).to_numpy()
                perm = permutations(space.rows(v), pivots, max(k, posted))
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for i, (q, p) in enumerate(zip(x, perms, strict=True)):
                    other = np.flatnonzero(own != ids[i])
                    score = (v[other] * q).sum(axis=1)
                    near = other[_best(own[other], score, top)]
                    w = weights(p, len(pivots), k)
                    values = np.full(len(near), i), own[near], (v[near] * q).sum(axis=1), k - w[perm[near, :posted]].max(axis=1), shared(w, perm[near], k)
                    for c, a in zip(cols, values, strict=True):
                        c.append(a)
                q, v_, s, f, w_ = (np.concatenate(c) for c in cols)
                yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(v_.astype(np.int64)), pa.array(s.astype(np.float64)), pa.array(f.astype(np.int32)), pa.array(w_.astype(np.int32))], names=["q", "v", "score", "file", "shared"])

        near = self.good.mapInArrow(run, "q int, v long, score double, file int, shared int")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))
        true = near.withColumn("r", place).filter(F.col("r") <= top).select("file", "shared").collect()
        if not true:
            return len(pivots), 0
        files = np.sort([r.file for r in true])
        loss = (1 - recall) / 2  # half of what may be lost to files that are not read, half to the footrule
        read = int(files[min(len(files) - 1, int(np.ceil((1 - loss) * len(files))))]) + 1
        return read, int(np.sort([r.shared for r in true])[int(loss * len(true))])

    def exact(self, asked: DataFrame, top: int, block: int = 1024) -> DataFrame:
        """query_id, vec_id, score: what each partition of all rows has nearest to the queries, which go round `block` at a time."""
        dim, blocks = self.dim, -(-asked.count() // block)
        asked = stage(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "asked")
        out = asked.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
        for k in range(blocks):
            rows = asked.filter(F.col("block") == k).collect()  # about `block` of them
            ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64).reshape(len(rows), dim)

            def run(batches: Iterator[pa.RecordBatch], ids=ids, x=x) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        v, own = _matrix(batch.column(1), dim).astype(np.float64), batch.column(0).to_numpy()
                        for i, q in zip(ids, x, strict=True):
                            other = np.flatnonzero(own != i)
                            score = (v[other] * q).sum(axis=1)
                            best = _best(own[other], score, top)
                            yield pa.record_batch([pa.array(np.full(len(best), i)), pa.array(own[other][best].astype(np.int64)), pa.array(score[best])], names=["query_id", "vec_id", "score"])

            out = out.unionByName(stage(self.good.mapInArrow(run, "query_id long, vec_id long, score double"), "exact"))
        return out

    def search(self, every: int, top: int, recall: float, probes: int, chunk_rows: int) -> DataFrame:
        space, pivots, k, posted, dim = self.space, self.pivots, self.k, self.posted, self.dim
        kind = {f.name: f.dataType.simpleString() for f in self.good.schema}
        asked = stage(self.good.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
        if asked.isEmpty():
            return asked.sparkSession.createDataFrame([], OUT)
        read, least = self.calibrate(asked, top, recall, probes)

        def post(place, depth: int, files: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        perm = permutations(place(_matrix(batch.column(1), dim).astype(np.float64)), pivots, max(depth, files))
                        yield pa.record_batch([batch.column(0), batch.column(1), _lists(perm[:, :depth]), _lists(perm[:, :files])], names=["vec_id", "embedding", "perm", "files"])

            return run, f"vec_id {kind['vec_id']}, embedding {kind['embedding']}, perm array<short>, files array<short>"

        # a file's entries are dealt to chunks by hash, and its readers go to all of its chunks
        entries = stage(self.good.mapInArrow(*post(space.rows, max(k, posted), posted)), "posted").select("vec_id", "embedding", "perm", F.explode("files").alias("file"))
        sizes = stage(entries.groupBy("file").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks")), "files")
        left = asked.mapInArrow(*post(space.queries, max(k, read), read)).select("vec_id", "embedding", "perm", F.explode("files").alias("file"))
        left = left.join(F.broadcast(sizes), "file")  # at most one row a pivot
        left = left.select("vec_id", "embedding", "perm", "file", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        right = entries.join(F.broadcast(sizes), "file").select("vec_id", "embedding", "perm", "file", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"))
        count = len(pivots)

        def meet(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
            """One chunk of one file: pairs first met here and near enough are reranked; each query gives its best."""
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if queries.num_rows and rows.num_rows:
                file = key[0].as_py()
                ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding"), dim).astype(np.float64)
                perm = _matrix(rows.column("perm"), max(k, posted))
                orders = _matrix(queries.column("perm"), max(k, read))
                asked_x = _matrix(queries.column("embedding"), dim).astype(np.float64)
                for qid, q, order in zip(queries.column("vec_id").to_numpy(), asked_x, orders, strict=True):
                    w = weights(order[: max(k, read)], count, k)
                    files = weights(order[:read], count, k)
                    first = files[perm[:, :posted]].max(axis=1) == files[file]
                    at = np.flatnonzero(first & (ids != qid))
                    at = at[shared(w, perm[at], k) >= least]
                    score = (x[at] * q).sum(axis=1)
                    best = _best(ids[at], score, top)
                    got.append((np.full(len(best), qid), ids[at][best], score[best]))
            q, v, s = (np.concatenate(c) if got else np.zeros(0) for c in (zip(*got, strict=True) if got else ((), (), ())))
            return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(v.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

        found = left.groupBy("file", "chunk").cogroup(right.groupBy("file", "chunk")).applyInArrow(meet, "query_id long, vec_id long, score double")
        found = stage(found, "found")
        # lists that came out short, though candidates are left, are asked again of all rows
        own = self.good.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
        held = asked.select("vec_id").join(own, "vec_id").join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")), "vec_id", "left")
        short = stage(held.filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(top), self.total - F.col("own"))).select("vec_id"), "short")
        if not short.isEmpty():
            found = found.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").unionByName(self.exact(asked.join(short, "vec_id", "left_semi"), top))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 20, top: int = 20, recall: float = 0.97, probes: int = 128, k: int = 24, posted: int = 8,
           most_pivots: int = 8192, chunk_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by `every`, its `top` nearest others found: query_id, rank, vec_id, score.

    Nearness is the largest inner product; ties go to the smaller id. There are 2 * sqrt(rows) pivots, at least 64 and at
    most `most_pivots`, taken among the rows with the smallest id hashes (4 * most_pivots bound what reaches the driver),
    near-equal ones last. Every row is indexed, in the files of its `posted` nearest pivots. `recall` is what the depth of the
    search is set for on `probes` queries, not a promise for the others. A file of more than chunk_rows entries is cut, so a task
    holds chunk_rows vectors and the queries that read the file.
    Nulls: rows with a null id take no part, nor do vectors null, zero or holding null or non-finite components. Vectors of
    each length have an index of their own, as no inner product joins different lengths. Candidates with the query's id are
    its own; other repeated rows count each, and repeated query ids are asked once, with the smallest vector. Empty input
    gives no rows. Further columns are not read.
    """
    good = stage(usable(vectors, id_col, vec_col), "vectors")
    sizes = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    out = vectors.sparkSession.createDataFrame([], OUT)
    for i, s in enumerate(sizes):
        own = good if len(sizes) == 1 else good.filter(F.size("embedding") == s.d)
        found = Index(own, s.d, s.n, k, posted, most_pivots).search(every, top, recall, probes, chunk_rows)
        out = found if i == 0 else out.unionByName(found)
    return out
