"""Vector codes and ball k-means against plain loops over Python integers, and their odd rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import ball_kmeans, integer_vectors, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def _rows(seed: int, count: int, width: int, spread: float = 1.0):
    r = random.Random(seed)
    return [(i * 3 % 1009 if i % 50 else i, [r.gauss((i % 5) * spread, 1) for _ in range(width)], r.choice([None, 1, 2])) for i in range(count)]


def _ints(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


def _d(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _means(members):
    return [sum(c) // len(members) for c in zip(*members, strict=True)]


def slow_codes(rows, parts, entries, rounds):
    kept = sorted((i, _ints(v), lab) for i, v, lab in rows)
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((_d(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            to = [near(v, p)[1] for _, v, _ in kept]
            books[p] = [_means([cut(v, p) for (_, v, _), t in zip(kept, to, strict=True) if t == k]) if k in to else e for k, e in enumerate(books[p])]
    return {i: ([near(v, p)[1] for p in range(parts)], sum(near(v, p)[0] for p in range(parts)), lab) for i, v, lab in kept}, books


def test_codes_against_loops(spark):
    rows = _rows(1, 90, 8, 2.0)
    got = {r.vec_id: r for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=2, entries=16, rounds=3).collect()}
    want, books = slow_codes(rows, 2, 16, 3)
    assert {k: (r.code, r.error) for k, r in got.items()} == {k: (c, e) for k, (c, e, _) in want.items()}
    sums: dict = {}
    for _, e, lab in want.values():
        sums[lab] = sums.get(lab, 0) + e
    assert all(r.label_error == sums[r.label] for r in got.values())
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(text.encode()).hexdigest()}


@pytest.mark.parametrize("most", [50, 1 << 26])
def test_exponion_search_is_exact_from_any_start(most):
    r = np.random.default_rng(most)
    entries = np.concatenate([r.integers(-most, most, (60, 5)), np.zeros((3, 5), np.int64)])  # equal entries: the lower wins
    x = np.concatenate([r.integers(-most, most, (300, 5)), entries, np.zeros((5, 5), np.int64)])
    book = vector_codes.Codebook(entries)
    index, dist, _ = book.nearest(x, r.integers(0, len(entries), len(x)))
    for row, i, d in zip(x.tolist(), index.tolist(), dist.tolist(), strict=True):
        assert (d, i) == min((_d(row, e), k) for k, e in enumerate(entries.tolist()))


def test_exponion_search_scans_less_from_a_near_start():
    r = np.random.default_rng(0)
    entries = r.integers(-100000, 100000, (256, 4))
    x = np.repeat(entries, 20, axis=0) + r.integers(-500, 500, (256 * 20, 4))
    near, _, few = vector_codes.Codebook(entries).nearest(x, np.repeat(np.arange(256), 20))
    far, _, many = vector_codes.Codebook(entries).nearest(x, np.zeros(len(x), np.int64))
    assert (near == far).all() and few * 4 < many


def test_codes_of_odd_rows(spark):
    good = [(None, [1.0, 2.0, 3.0, 4.0], None), (5, [1.0, 2.0, 3.0, 4.0], 7), (5, [1.0, 2.0, 3.0, 4.0], 7), (2, [-0.0001, 0.0, 0.0, 9.0], None)]
    bad = [(1, None, 1), (3, [], 1), (4, [1.0, None, 1.0, 1.0], 1), (6, [math.nan, 1.0, 1.0, 1.0], 1), (7, [math.inf, 1.0, 1.0, 1.0], 1), (8, [1.0] * 8, 1), (9, [1.0] * 3, 1)]
    d = spark.createDataFrame(good + bad, SCHEMA).withColumn("code", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("error", F.lit(2))
    got = vector_codes.compress(d).select("vec_id", "label", "code", "error", "label_error").collect()
    assert len(got) == 4
    assert {r.vec_id: (r.error, r.label_error) for r in got} == {None: (0, 0), 5: (0, 0), 2: (0, 0)}
    assert {r.vec_id: r.code for r in got} == {2: [0] * 4, 5: [1] * 4, None: [1] * 4}
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 4, 1)], SCHEMA)).collect()


def slow_clusters(rows, k, rounds, width):
    kept = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), _ints(v), i) for i, v, _ in rows if len(v) == width)
    cents = [v for _, v, _ in kept[:k]]
    near = lambda v: min((_d(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        to = [near(v)[1] for _, v, _ in kept]
        cents = [_means([v for (_, v, _), t in zip(kept, to, strict=True) if t == j]) if j in to else c for j, c in enumerate(cents)]
    return {i: near(v)[::-1] for _, v, i in kept}, cents


@pytest.mark.parametrize("spread", [0.0, 6.0])
def test_balls_against_loops(spark, spread):
    rows = _rows(2, 120, 6, spread)
    got = ball_kmeans.cluster(spark.createDataFrame(rows, SCHEMA).repartition(4), clusters=5, rounds=6, width=6).collect()
    want, cents = slow_clusters(rows, 5, 6, 6)
    assert {r.vec_id: (r.cluster, r.distance) for r in got} == want
    assert {r.inertia for r in got} == {sum(d for _, d in want.values())}
    for r in got:
        assert r.cluster_inertia == sum(d for c, d in want.values() if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_ball_assignment_is_exact_and_leaves_the_stable_core_alone():
    r = np.random.default_rng(3)
    cents = r.integers(-3000, 3000, (8, 4))
    x = np.concatenate([cents.repeat(50, axis=0) + r.integers(-400, 400, (400, 4)), (cents[:4] + cents[4:]) // 2])
    old = np.concatenate([np.arange(8).repeat(50), np.arange(4)])
    radii = [int(np.sqrt(integer_vectors.own_squares(x[old == k], cents[old[old == k]]).max())) + 1 for k in range(8)]
    index, dist, taken = ball_kmeans.Balls(cents, radii).assign(x, old)
    for row, i, d in zip(x.tolist(), index.tolist(), dist.tolist(), strict=True):
        assert (d, i) == min((_d(row, c), k) for k, c in enumerate(cents.tolist()))
    assert taken < len(x) * 2  # of 7 others each
    wide, _, every = ball_kmeans.Balls(cents, [None] * 8).assign(x, np.zeros(len(x), np.int64))
    assert (wide == index).all() and every > taken


def test_balls_of_odd_rows(spark):
    v = [1.0] * 64
    rows = [(1, v, 0), (1, v, 0), (None, [2.0] * 64, 0), (2, None, 0), (3, [1.0] * 63, 0), (4, [*v[:63], None], 0), (5, [*v[:63], math.nan], 0), (6, [*v[:63], -math.inf], 0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("q", F.lit("x")).withColumn("cluster", F.lit(77)).withColumn("distance", F.lit(1))
    got = ball_kmeans.cluster(d).collect()
    assert sorted((str(r.vec_id), r.distance, r.inertia) for r in got) == [("1", 0, 0), ("1", 0, 0), ("None", 0, 0)]
    assert len({r.cluster for r in got}) == 2 and len({r.cluster for r in got if r.vec_id == 1}) == 1
    assert ball_kmeans.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
