"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are 64-bit majority votes over shingle hashes. Distinct fingerprints are dealt to the buckets of several
permuted keys, chosen so that every pair within the radius agrees on a whole key (the pigeonhole principle), and compared in
each bucket by bit planes: plane i of 64 lanes is one machine word, distances of many lanes are counted at once by
carry-save counters, and a block is abandoned once all of its lanes exceed the radius. A bucket emits only a spanning forest
of its links, and components are found by star rounds.

near_groups() links fingerprints within a radius. near_copies() links texts by the similarity of their shingles, which no small
radius reaches: there min-hash bands and the rarest shingles make the buckets, the bit-sliced comparison at a wide radius sorts
out what is not alike, and exact similarity decides the rest.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import utf8
from .common import discard, stage
from .components import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of each run of `shingle` words with A-Z lowered, repeats included; fewer words are one run."""
    found = _WORD.findall(text.translate(_LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    row = b" ".join(found)
    if len(found) <= shingle:
        return np.array([xxhash.xxh64_intdigest(row, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    h, view = xxhash.xxh64_intdigest, memoryview(row)
    return np.array([h(view[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it; no hash at all gives zero."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def planes_of(x: np.ndarray) -> np.ndarray:
    """64-bit numbers -> (64, words): bit i of number j is bit j % 64 of word j // 64 in row i."""
    n = -(-len(x) // 64) * 64
    bits = np.unpackbits(np.concatenate([x, np.zeros(n - len(x), np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(plane, rows: int, words: int, radius: int) -> np.ndarray:
    """(rows, words) whose bits tell which lanes have at most radius bits set among 64 planes.

    plane(i, alive) gives plane i of the rows still alive. Carry-save counting: the counters hold each lane's count, a bit
    each, as far as the radius needs, and `over` those that passed it for good. After every 8 planes, rows (blocks of lanes)
    all of whose lanes are over are abandoned.
    """
    alive = np.arange(rows)
    counters = [np.zeros((rows, words), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over, out = np.zeros((rows, words), np.uint64), np.zeros((rows, words), np.uint64)
    for i in range(64):
        x = plane(i, alive)
        for c in counters:
            carry = c & x
            c ^= x
            x = carry
        over |= x
        if i % 8 == 7:
            over |= _above(counters, radius)
            live = (~over).any(axis=1)
            if not live.all():
                alive, over = alive[live], over[live]
                counters = [c[live] for c in counters]
                if not len(alive):
                    return out
    out[alive] = ~over
    return out


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int, block: int = 16) -> np.ndarray:
    """For each pair of fingerprints (a[i], b[i]), whether it lies within the radius; 64 * block pairs are abandoned at once."""
    planes = planes_of(a ^ b)
    rows = -(-planes.shape[1] // block)
    planes = np.pad(planes, ((0, 0), (0, rows * block - planes.shape[1]))).reshape(64, rows, block)
    hit = within(lambda i, alive: planes[i, alive], rows, block, radius)
    return lanes(hit.reshape(1, -1), len(a))[0]


def rows_within(queries: np.ndarray, planes: np.ndarray, radius: int, n: int) -> np.ndarray:
    """Boolean (queries, n): which of the n lanes each query is near to."""
    flip = np.where((queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), ~np.uint64(0), np.uint64(0))
    return lanes(within(lambda i, alive: planes[i][None, :] ^ flip[i, alive][:, None], len(queries), planes.shape[1], radius), n)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, given from its lowest bit, exceeds the radius, by comparison from the highest bit."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    return above


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """(rows, words) -> boolean (rows, n)."""
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def bucket_links(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as positions, of the links within one bucket's fingerprints.

    Query rows are compared against all lanes, 64 a word; rows already in one tree with everything are not asked again.
    """
    n, planes, forest, out = len(x), planes_of(x), _Forest(len(x)), []
    step = max(1, min(256, 1 << 21 >> max(6, n.bit_length())))
    for lo in range(0, n, step):
        q = x[lo : lo + step]
        hit = rows_within(q, planes, radius, n)
        root = np.fromiter(map(forest.find, range(n)), np.int64, n)
        for r in range(len(q)):
            to = np.flatnonzero(hit[r])
            to = to[to != lo + r]
            if len(to):  # one link to each tree that the row touches
                for j in to[np.unique(root[to], return_index=True)[1]].tolist():
                    if forest.link(lo + r, j):
                        out.append((lo + r, j))
        # links among lanes of one old tree are implied
    return out


def _compare(radius: int, small: int = 32):
    """Sorted rows (bucket, chunk pair, fp) -> links (a, b). Small buckets share planes; a large one has its own."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(g: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]).any(axis=1)]))
        size = np.diff(np.concatenate([cut, [len(x)]]))
        a, b = [], []
        for s in range(2, small + 1):
            first = cut[size == s]
            if len(first):
                i, j = np.triu_indices(s, 1)
                a.append((first[:, None] + i).ravel())
                b.append((first[:, None] + j).ravel())
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            for k in range(0, len(a), 1 << 18):
                i, j = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
                hit = pairs_within(x[i], x[j], radius)
                if hit.any():
                    yield pa.record_batch([x[i[hit]].view(np.int64), x[j[hit]].view(np.int64)], schema=schema)
        for lo, s in zip(cut[size > small].tolist(), size[size > small].tolist(), strict=True):
            own = x[lo : lo + s]
            if found := bucket_links(own, radius):
                i, j = np.array(found).T
                yield pa.record_batch([own[i].view(np.int64), own[j].view(np.int64)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "pair")], axis=1)
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            last = np.flatnonzero((g != g[-1]).any(axis=1))
            end = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
            if held and (end or (held[-1][0][0] != g[0]).any()):
                if end == 0:
                    yield from links(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held = []
                else:
                    held.append((g[:end], x[:end]))
                    yield from links(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held = []
            elif end:
                yield from links(g[:end], x[:end])
            held.append((g[end:], x[end:]))
        if held:
            yield from links(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return run


def _keys(free: int, radius: int) -> list[int]:
    """Masks of `free` of free+radius blocks of the 64 bits: a pair within the radius agrees on one mask at least."""
    n = free + radius
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(n)]
    return [sum(c) for c in itertools.combinations(blocks, free)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, radius: int = 4, bucket_rows: int = 256, chunk_rows: int = 4096) -> DataFrame:
    """fps(fp long, distinct) -> links (a, b) that connect exactly the fingerprints within the radius.

    Keys get longer as the table grows, so that evenly spread fingerprints come to at most bucket_rows a bucket; the result is
    the same for any key length. A bucket of over chunk_rows is cut into chunks by hash, and each pair of chunks is a task's
    unit, so a hot bucket is compared whole yet in bounded pieces.
    """
    total, free = fps.count(), 1
    while free < 6 and total / 2 ** (64 * free // (free + radius)) > bucket_rows:
        free += 1
    masks = _keys(free, radius)
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("t", "key"))
    hot = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > chunk_rows)
    hot = stage(hot.select("t", "key", F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks")), "hot")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (F.least(j, own).cast("long") * F.lit(1 << 31) + F.greatest(j, own)))
    rows = rows.join(hot, ["t", "key"], "left")
    rows = rows.select("t", "key", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)).alias("pair"), "fp")
    rows = rows.select(F.col("t").cast("long").alias("t"), "key", "pair", "fp").repartition("t", "key", "pair").sortWithinPartitions("t", "key", "pair", "fp")
    return rows.mapInArrow(_compare(radius), "a long, b long")


def near_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (long, the fingerprint's bits), component_id: the smallest doc_id that links reach from it.

    Equal fingerprints are one node, so groups of copies cost nothing beyond their count. Nulls: a null or wordless text has
    fingerprint zero and is linked like any other; a row with a null id links others, and takes null only if its whole
    component has no id. Repeated rows repeat. Empty input gives no rows. Further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            fps = np.fromiter((fingerprint(shingle_hashes(data[a:b].tobytes(), shingle)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = stage(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("t")).mapInArrow(run, f"doc_id {kind}, fp long"), "fps")
    fps = stage(slim.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = fingerprint_links(fps.select("fp"), radius)
    roots = components(links)
    root = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    root = stage(root, "roots")
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    return slim.join(named, slim["fp"] == named["__fp"]).select("doc_id", "fp", "component_id")


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """For each band, a hash of its number and its `rows` min-hashes, as signed 64-bit numbers."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, bands * rows, 1), dtype=np.uint64)
    a = 2 * a + np.uint64(1)
    least = np.full(bands * rows, ~np.uint64(0))
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, k : k + 2048] * a + b).min(axis=1))
    return [xxhash.xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) - (1 << 63) for i in range(bands)]


def _within_radius(radius: int):
    """Pairs (a, b, fa, fb) whose fingerprints lie within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fa, fb = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fa", "fb"))
            if batch.num_rows:
                yield batch.filter(pa.array(pairs_within(fa, fb, radius))).select(["a", "b"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) whose sets have a Jaccard similarity of at least `least`."""
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("n") / (F.size("sa") + F.size("sb") - F.col("n")) >= least).select("a", "b")


def rare_prefixes(sets: DataFrame, least: float) -> DataFrame:
    """sets(node, fp, s) -> node, fp, n (size), own (shingles no other set has), keys: the rest of its rarest shingles, each
    (x, place), as far as two sets of that similarity must have one in common: the n - ceil(least * n) + 1 rarest. place is
    the shingle's rank in its set, from 1, by frequency and then hash."""
    tokens = sets.select("node", F.explode("s").alias("x"))
    shared = tokens.groupBy("x").agg(F.count("*").alias("k")).filter("k > 1")
    ranked = tokens.join(shared, "x").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("rest"))
    d = sets.select("node", "fp", F.size("s").cast("long").alias("n")).join(ranked, "node", "left")
    d = d.withColumn("own", F.col("n") - F.coalesce(F.size("rest"), F.lit(0)))
    length = (F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1 - F.col("own")).cast("int")
    keys = F.transform(F.slice("rest", F.lit(1), F.greatest(length, F.lit(0))), lambda r, i: F.struct(r["x"].alias("x"), (F.col("own") + i + 1).alias("place")))
    return d.select("node", "fp", "n", "own", keys.alias("keys"))


def similar_links(bands: DataFrame, prefixes: DataFrame, sets: DataFrame, least: float, radius: int) -> DataFrame:
    """bands(key, node) and rare_prefixes() -> node, root: components of all pairs that share a band and are similar enough.

    First, one pivot of each band's bucket is held against its other members: the one with the fewest shingles of its own, to
    which copies made from it link. Then the rare shingles make the buckets, and a growing number of pivots of each (256 at
    first, which is all of most buckets) is held against its other members outside the pivot's component, until every two
    members are connected or were compared. Two sets
    share no more than what follows their first common shingle in either, so pairs that cannot be similar are not formed:
    texts that have a common stock but differ elsewhere meet in no bucket, and copies are one component before they could.
    """
    facts = prefixes.select("node", "fp", "n", "own")
    live = bands.select("key", "node").join(facts, "node").select("key", "node", "fp", "n", "own", F.lit(1).cast("long").alias("place"), F.col("node").alias("c"))
    later = prefixes.select("node", "fp", "n", "own", F.explode("keys").alias("x")).select(F.col("x.x").alias("key"), "node", "fp", "n", "own", "x.place")
    links, roots, pivots, first = None, bands.sparkSession.createDataFrame([], "node long, root long"), 1, True
    while True:
        open_ = live.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
        live = stage(live.join(open_, "key", "left_semi"), "live")
        if live.isEmpty() and not first:
            return roots
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("own") / F.col("n"), "node"))
        pivot = stage(live.withColumn("r", place).filter(F.col("r") <= pivots).drop("r"), "pivots")
        left = pivot.select("key", F.struct("node", "fp").alias("p"), F.col("c").alias("pc"), F.col("n").alias("pn"), F.col("place").alias("pplace"))
        right = live.select("key", F.struct("node", "fp").alias("q"), "c", "n", "place")
        most = 1 + F.least(F.col("pn") - F.col("pplace"), F.col("n") - F.col("place"))
        met = left.join(right, (left["key"] == right["key"]) & (F.col("pc") != F.col("c")) & (most * (1 + least) >= least * (F.col("pn") + F.col("n")) - 1e-6))
        met = met.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()
        pairs = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.fp").alias("fa"), F.col("y.fp").alias("fb"))
        pairs = stage(pairs.mapInArrow(_within_radius(radius), "a long, b long"), "pairs")
        found = stage(_similar(pairs, sets, least), "found")
        if not found.isEmpty():
            links = stage(found if links is None else links.unionByName(found), "links")
            roots = components(links)
        rest = later if first else live.drop("c").join(pivot.select("key", "node"), ["key", "node"], "left_anti")
        rest = rest.join(roots, "node", "left").select("key", "node", "fp", "n", "own", "place", F.coalesce("root", "node").alias("c"))
        live, pivots, first = stage(rest, "rest"), 256 if first else 16 * pivots, False
        discard(pairs)
        discard(pivot)


def near_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5, radius: int = 28, bands: int = 24, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, component_id: the smallest doc_id that pairs of at least `least` Jaccard similarity reach from it.

    A pair of similarity s shares a bucket with probability 1 - (1 - s^rows)^bands: 0.99993 at 0.8, 0.999999 at 0.85; radius
    bits leave room for texts of few shingles, whose votes are close. Pairs below `least` are never linked. Nulls: null and
    wordless texts are alike; a row with a null id links others, and takes null only if its whole component has no id.
    Repeated rows repeat. Empty input gives no rows. Further columns are not read.
    """

    def every(column: pa.Array) -> Iterator[np.ndarray]:
        data, at = utf8(column)
        return (shingle_hashes(data[a:b].tobytes(), shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    def distinct(hashes: np.ndarray) -> np.ndarray:
        return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = np.zeros(batch.num_rows, np.uint64), []
            for i, hashes in enumerate(every(batch.column(2))):
                fps[i] = fingerprint(hashes)
                keys.append(band_keys(distinct(hashes), bands, rows))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "keys"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct(hashes).view(np.int64) for hashes in every(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["node", "fp", "s"])

    node: Column = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("doc_id"), node.alias("node"), docs[text_col].alias("t"))
    slim = stage(slim.mapInArrow(sign, f"doc_id {kind}, node long, fp long, keys array<long>"), "signs")
    keyed = slim.select("node", "fp", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    found = stage(keyed.join(shared, "key", "left_semi").select("key", "node", "fp"), "bands")
    texts = docs.select(node.alias("node"), docs[text_col].alias("t")).join(found.select("node", "fp").distinct(), "node").dropDuplicates(["node"])
    sets = stage(texts.select("node", "fp", "t").mapInArrow(gather, "node long, fp long, s array<long>"), "sets")
    roots = similar_links(found, stage(rare_prefixes(sets, least), "prefixes"), sets, least, radius)
    named = slim.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    named = stage(named, "roots")
    return named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")
