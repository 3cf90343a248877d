"""Vectors as integers: which rows take part, their exact distances, and tables of rows with the sums that each task adds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components below this bound have squared distances that fit 64-bit integers; larger ones are an error.
MOST = 1 << 27
#: Components below this one have inner products that double precision holds exactly, up to 512 of them.
NARROW = 1 << 22
#: Rows that a task holds at a time.
CHUNK = 1 << 15


def finite(vec: Column) -> Column:
    """Whether a vector is there and holds no null and no non-finite component."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def floors(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, taken as a double; an error where one is beyond MOST."""
    small = F.forall(vec, lambda x: F.abs(x.cast("double") * scale) < MOST)
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows of x, rows of y): exact squared distances. Narrow values go through one product of doubles, others by rows of y."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < NARROW and x.shape[1] <= 512:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in y], axis=1) if len(y) else np.zeros((len(x), 0), np.int64)


def own_squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The exact squared distance of each row of x to the row of centres beside it."""
    return ((x - centres) ** 2).sum(axis=1)


def better(dist: np.ndarray, index: np.ndarray, near: np.ndarray, among: np.ndarray) -> None:
    """Puts into (dist, index) what of `near`, the distances to entries `among`, is less, or equal at a smaller index."""
    least = near.min(axis=1)
    first = np.where(near == least[:, None], among, np.iinfo(np.int64).max).min(axis=1)
    wins = (least < dist) | ((least == dist) & (first < index))
    dist[wins], index[wins] = least[wins], first[wins]


def chunks(batches: Iterable[pa.RecordBatch], rows: int = CHUNK) -> Iterator[pa.Table]:
    """The batches of a task, gathered to about `rows` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Sums:
    """Counts, componentwise sums and largest distances of the rows that a task gives to each cell."""

    def __init__(self, cells: int, width: int):
        self.n, self.total, self.most = np.zeros(cells, np.int64), np.zeros((cells, width), np.int64), np.zeros(cells, np.int64)

    def add(self, cell: np.ndarray, x: np.ndarray, dist: np.ndarray) -> None:
        if not len(cell):
            return
        order = np.argsort(cell, kind="stable")
        held, at = np.unique(cell[order], return_index=True)
        self.n += np.bincount(cell, minlength=len(self.n))
        self.total[held] += np.add.reduceat(x[order], at, axis=0)
        np.maximum.at(self.most, cell, dist)


SUMS = "cell int, n long, total array<bigint>, most long"


def with_sums(rows: dict[str, pa.Array], length: int, sums: Sums | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One batch of rows, or, given sums, one of the cells that hold a row; the other columns are null."""
    if sums is not None:
        at = np.flatnonzero(sums.n)
        rows, length = {"cell": pa.array(at.astype(np.int32)), "n": pa.array(sums.n[at]), "total": lists(sums.total[at]), "most": pa.array(sums.most[at])}, len(at)
    if length:
        yield pa.record_batch([rows[f.name].cast(f.type) if f.name in rows else pa.nulls(length, f.type) for f in schema], schema=schema)


def totals(table: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """cell -> (count, sums, largest distance), added up over the tasks. As many rows as there are cells reach the driver."""
    each = table.filter("cell IS NOT NULL").select("cell", "n", "most", F.posexplode("total").alias("at", "t"))
    each = each.groupBy("cell", "at").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.max("most").alias("most"))
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in each.orderBy("cell", "at").collect():
        out.setdefault(r.cell, (r.n, [], r.most))[1].append(r.t)
    return out


def digest(values: Iterable[int]) -> str:
    """The SHA-256 of decimal integers joined by commas, in lower-case hex."""
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()

