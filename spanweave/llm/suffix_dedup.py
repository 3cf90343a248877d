"""Exact substring deduplication over shard suffix arrays.

A string of `length` bytes that occurs anywhere else is removed wherever it occurs. Each such string (a window) is keyed by
its minimiser, the least hash of a k-byte substring in it; equal windows have equal keys, so all occurrences of a window
come to one key. Runs of windows with the same key form spans (each window lies in exactly one), and only hashes of spans
are shuffled at first:

* a key seen once has no repeated window;
* a span whose whole content occurs twice is repeated throughout;
* other spans that share a key differ somewhere. One text of each distinct one goes to a shard, those that share neither half of
  a window around the minimiser are left out, and the shard's suffix array
  (induced sorting) and permuted common prefixes tell which of its windows repeat.

Copies thus collapse before any text moves. A key with more distinct spans than a shard should hold has its windows counted
by hash, with partial aggregation, so no key is a task's burden.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import utf8
from .common import discard, stage
from .induced_sorting import repeated_starts

K, PIECE = 32, 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverses modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))  # type: ignore[return-value]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h


class Hashes:
    """Hashes of any substrings of one piece, from prefix sums."""

    powers: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray):
        n = len(data)
        if Hashes.powers is None or len(Hashes.powers[0]) <= n:
            Hashes.powers = _powers(max(n + 1, PIECE + 4096))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hashes.powers[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * Hashes.powers[1][start])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, from block-wise prefix and suffix minima."""
    x = np.concatenate([h, np.full(-len(h) % width, ~np.uint64(0))]).reshape(-1, width)
    head, tail = np.minimum.accumulate(x, axis=1).ravel(), np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def spans(data: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, content hash, lo, hi) of a text's spans: the windows that start in lo..hi - length have their minimiser at one
    place, and key is its hash. Hashes are compared by their upper 43 bits, ties going to the leftmost, so that equal
    windows choose alike; a window that recurs nearby, in overlap with itself, comes to two spans."""
    out: list[tuple[np.ndarray, ...]] = []
    place = np.uint64((1 << 21) - 1)
    for base in range(0, len(data) - length + 1, PIECE):
        part = data[base : base + PIECE + length - 1]
        hashes = Hashes(part)
        at = np.arange(len(part) - k + 1)
        h = hashes.of(at, at + k)
        least = _least((h & ~place) | at.astype(np.uint64), length - k + 1)
        lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        hi = np.concatenate([lo[1:], [len(least)]]) - 1 + length
        out.append((h[(least[lo] & place).astype(np.int64)], hashes.of(lo, hi), lo + base, hi + base))
    return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((),) * 4))  # type: ignore[return-value]


def _reclaim(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of plans that are done with."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _emit_spans(length: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            own, parts = [], []
            for i in np.flatnonzero(np.diff(at) >= length).tolist():
                got = spans(data[at[i] : at[i + 1]], length)
                own.append(np.full(len(got[0]), i))
                parts.append(got)
            if parts:
                rows = pa.array(np.concatenate(own))
                key, content, lo, hi = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), _signed(key), _signed(content), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["doc", "h", "key", "content", "lo", "hi"])

    return run, f"doc {kind}, h long, key long, content long, lo long, hi long"


def _packed(docs: DataFrame, kind: str) -> DataFrame:
    """doc, h and the text as compressed bytes: what a join of texts shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, at = utf8(batch.column(2))
            texts = [squeeze.compress(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc", "h", "z"])

    return docs.mapInArrow(run, f"doc {kind}, h long, z binary")


def _unpack(z: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)


def _cut_texts(rows: DataFrame, kind: str) -> DataFrame:
    """doc, h, z, parts -> a row for each part: the unit it belongs to, its key, place and bytes."""
    names = ["doc", "h", "unit", "key", "lo", "hi", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, h, z, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = _unpack(z)
                for p in parts:
                    for c, v in zip(cols, (doc, h, p["unit"], p["key"], p["lo"], p["hi"], text[p["lo"] : p["hi"]].tobytes()), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, batch.column(i).type if i < 2 else pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(cols)], names=names)

    return rows.select("doc", "h", "z", "parts").mapInArrow(run, f"doc {kind}, h long, unit long, key long, lo long, hi long, part binary")


def _runs(flags: np.ndarray, lo: int, length: int) -> list[tuple[int, int]]:
    """The byte ranges that the flagged window starts cover, from lo."""
    step = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(lo + a, lo + b - 1 + length) for a, b in zip(step[::2].tolist(), step[1::2].tolist(), strict=True)]


def candidates(parts: list[np.ndarray], keys: list[int], length: int, k: int = K) -> np.ndarray:
    """Which parts may share a window with another one of their key; the others have no repeated window.

    All windows of a part hold its minimiser, the k bytes that hash to its key. Two equal windows agree in `length` - k bytes around
    it, so in at least half of these on its left or on its right. Keys with a part that holds its minimiser twice are kept whole.
    """
    half, size = (length - k) // 2, np.array([len(p) for p in parts])
    if half < 1 or not len(parts):
        return np.ones(len(parts), bool)
    data, end, key = np.concatenate(parts), np.cumsum(size), np.array(keys, np.int64).view(np.uint64)
    hashes, begin, owner = Hashes(data), end - size, np.repeat(np.arange(len(parts)), size)
    at = np.arange(len(data) - k + 1)
    at = at[at + k <= end[owner[at]]]
    at = at[hashes.of(at, at + k) == key[owner[at]]]
    sure = np.bincount(owner[at], minlength=len(parts)) == 1
    keep = np.isin(key, key[~sure])
    at = at[sure[owner[at]]]
    for lo in (at - half, at + k):
        ok = (lo >= begin[owner[at]]) & (lo + half <= end[owner[at]])
        some = owner[at[ok]]
        pair = _mixed(key[some] ^ _mixed(hashes.of(lo[ok], lo[ok] + half)))  # equal pairs of unlike parts only keep more
        by = np.argsort(pair)
        same = pair[by[1:]] == pair[by[:-1]]
        keep[some[by[1:][same]]] = keep[some[by[:-1][same]]] = True
    return keep


def _sort_shards(length: int, kind: str):
    """Rows sorted by unit -> the repeated ranges of each unit's parts."""
    names = ["doc", "h", "lo", "hi"]

    def solve(rows: list[tuple]) -> tuple[list[list], ...]:
        cols: tuple[list[list], ...] = ([], [], [], [])
        parts = [np.frombuffer(r[3], np.uint8) for r in rows]
        keep = np.flatnonzero(candidates(parts, [r[4] for r in rows], length)).tolist()
        rows, parts = [rows[i] for i in keep], [parts[i] for i in keep]
        if len(parts) < 2:
            return cols
        for (doc, h, lo, *_), flags in zip(rows, repeated_starts(parts, length), strict=True):
            for a, b in _runs(flags, lo, length):
                for c, v in zip(cols, (doc, h, a, b), strict=True):
                    c.append(v)
        return cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        types = None

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(solve(rows), types, strict=True)], names=names)

        for batch in batches:
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64()]
            for u, *row in zip(*(batch.column(c).to_pylist() for c in ("unit", "doc", "h", "lo", "part", "key")), strict=True):
                if u != unit and rows:
                    yield flush()
                    rows = []
                unit = u
                rows.append(tuple(row))
        if rows:
            yield flush()

    return run, f"doc {kind}, h long, lo long, hi long"


def _window_hashes(length: int, kind: str):
    names = ["doc", "h", "key", "window", "lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (lo, part) in enumerate(zip(batch.column("lo").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                data = np.frombuffer(part, np.uint8)
                at = np.arange(len(data) - length + 1)
                rows = pa.array(np.full(len(at), i))
                yield pa.record_batch([*(batch.column(c).take(rows) for c in ("doc", "h", "key")), _signed(Hashes(data).of(at, at + length)), pa.array(at + lo, pa.int64())], names=names)

    return run, f"doc {kind}, h long, key long, window long, lo long"


def _repeated(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The rows whose keys counted(keys, n) has with n > 1; total is the sum of n.

    Keys of more than a 4,096th of all rows are at most 4,095, so they are broadcast and their rows stay where they are.
    """
    most = max(4096, total // 4096)
    hot = F.broadcast(counted.filter(F.col("n") > most).select(*keys))
    cold = counted.filter(F.col("n").between(2, most)).select(*keys)
    return rows.join(hot, keys, "left_semi").unionByName(rows.join(hot, keys, "left_anti").join(cold, keys, "left_semi"))


def repeated_ranges(docs: DataFrame, length: int, shard_bytes: int = 1 << 20, hot_spans: int = 2048) -> DataFrame:
    """docs(doc, h, t) -> doc, h, ranges: the repeated byte ranges of each (doc, h) that has any, in any order."""
    kind = docs.schema["doc"].dataType.simpleString()
    every = stage(docs.mapInArrow(*_emit_spans(length, kind)), "spans")
    keys = stage(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "keys")
    shared = stage(every.join(keys, "key", "left_semi"), "shared")
    discard(every)
    _reclaim(docs)
    first = F.min(F.struct("doc", "h", "lo", "hi")).alias("at")
    distinct = stage(shared.groupBy("key", "content").agg(F.count("*").alias("n"), first), "distinct")
    total = distinct.agg(F.sum("n").alias("s")).first().s or 0
    whole = _repeated(shared, distinct, ["key", "content"], total).select("doc", "h", "lo", "hi")
    open_keys = distinct.groupBy("key").agg(F.count("*").alias("forms"), F.min("n").alias("least")).filter("forms > 1 AND least = 1").select("key", "forms")
    unsure = stage(distinct.select("key", "at").join(open_keys, "key"), "unsure")
    size = unsure.agg(F.sum(F.col("at.hi") - F.col("at.lo")).alias("s")).first().s or 0
    shards = max(1, -(-size // shard_bytes))
    unit = F.when(F.col("forms") > hot_spans, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))).cast("long")
    wanted = unsure.groupBy(F.col("at.doc").alias("wdoc"), F.col("at.h").alias("wh")).agg(F.collect_list(F.struct(unit.alias("unit"), F.col("key"), F.col("at.lo"), F.col("at.hi"))).alias("parts"))
    packed = _packed(docs, kind)
    # rows with equal ids and texts would give the same parts twice
    holders = packed.join(wanted, packed["doc"].eqNullSafe(wanted["wdoc"]) & (packed["h"] == wanted["wh"])).dropDuplicates(["doc", "h"])
    parts = stage(_cut_texts(holders, kind), "parts")
    _reclaim(docs)
    sharded = parts.filter("unit >= 0").repartition("unit").sortWithinPartitions("unit").mapInArrow(*_sort_shards(length, kind))
    windows = parts.filter("unit < 0").mapInArrow(*_window_hashes(length, kind))
    twice = stage(windows.groupBy("key", "window").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    most = twice.agg(F.sum("n").alias("s")).first().s or 0
    hot = _repeated(windows, twice, ["key", "window"], most).select("doc", "h", "lo", (F.col("lo") + length).alias("hi"))
    found = stage(whole.unionByName(sharded).unionByName(hot), "ranges")
    discard(parts)
    _reclaim(docs)
    return found.groupBy("doc", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def _merged(ranges: list[dict]) -> np.ndarray:
    """Disjoint maximal ranges, sorted, of ranges that may overlap or touch."""
    r = np.array(sorted((x["lo"], x["hi"]) for x in ranges), np.int64).reshape(-1, 2)
    if not len(r):
        return r
    reach = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([r[at, 0], reach[np.concatenate([at[1:] - 1, [len(r) - 1]])]], axis=1)


def dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of [start, end) byte ranges), and with
    texts=True kept (binary): the remaining bytes concatenated, which may split a character.

    Every byte covered by a string of `length` bytes that also starts elsewhere, in any row, is removed; strings are judged
    on the input. Nulls: a null text is empty; null ids count as one id. Repeated rows are occurrences of their own, so they
    lose all that is long enough. Empty input gives no rows. Further columns are not read. Equality of whole spans rests on
    two 64-bit hashes of different strings; windows within shards are compared byte by byte.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("h"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    found = repeated_ranges(d, length).select(F.col("doc").alias("fdoc"), F.col("h").alias("fh"), "ranges")
    packed = _packed(d, kind)
    rows = packed.join(found, packed["doc"].eqNullSafe(found["fdoc"]) & (packed["h"] == found["fh"]), "left").select("doc", "z", "ranges")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", *(["kept"] if texts else [])]
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for z, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, gone = _unpack(z).tobytes(), _merged(ranges or []).tolist()
                at, kept = 0, []
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                row = (len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in gone], rest)
                for c, v in zip(cols, row, strict=False):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pairs, pa.binary()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=False)]], names=names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>"
    return rows.mapInArrow(run, schema + (", kept binary" if texts else ""))


#: The same in DuckDB SQL at 200 bytes: every window of every text is compared by its bytes' MD5, then islands are cut.
ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, i, md5_number(b[i + 1:i + 200]) AS h FROM (SELECT rid, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT rid, i FROM w SEMI JOIN twice USING (h)),
marked AS (SELECT rid, i, CASE WHEN i <= 200 + lag(i) OVER (PARTITION BY rid ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM s),
island AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM marked),
run AS MATERIALIZED (SELECT rid, min(i) AS lo, max(i) + 200 AS hi FROM island GROUP BY rid, k),
kept AS (SELECT rid, lag(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS lo, lo AS hi FROM run UNION ALL SELECT d.rid, coalesce(max(hi), 0), any_value(octet_length(b)) FROM d LEFT JOIN run USING (rid) GROUP BY d.rid),
rest AS (SELECT rid, sha256(unhex(string_agg(hex(b[lo + 1:hi]), '' ORDER BY lo))) AS kept_sha256 FROM kept JOIN d USING (rid) GROUP BY rid),
sums AS (SELECT rid, count(*) AS n_spans, sum(hi - lo) AS n_removed FROM run GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256 FROM d JOIN rest USING (rid) LEFT JOIN sums USING (rid)
"""
