"""The trigram model against plain dictionaries, its levels against sorted arrays, and its odd rows."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import ngram_model
from spanweave.llm.ngram_trie import EliasFano, Trie, build, value

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def slow_scores(rows):
    """The model's definition, with dictionaries: id -> [(tokens, known, base, score)]."""
    texts = [(i, [*WORD.findall(_lower(t or "")), "\0end"]) for i, t in rows]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in texts:
        if not _held(i):
            one.update(w)
            s = ["", "", *w]
            two.update(zip(s[1:], s[2:], strict=False))
            three.update(zip(s, s[1:], s[2:], strict=False))
    n2, t2, n3, t3 = (collections.Counter() for _ in range(4))
    for (b, _), k in two.items():
        n2[b] += k
        t2[b] += 1
    for (a, b, _), k in three.items():
        n3[a, b] += k
        t3[a, b] += 1
    total, distinct = sum(one.values()), len(one)

    def p1(c):
        return (one[c] + 0.5) / (total + 0.5 * (distinct + 1))

    def p2(b, c):
        return (two[b, c] + t2[b] * p1(c)) / (n2[b] + t2[b]) if n2[b] else p1(c)

    def p3(a, b, c):
        return (three[a, b, c] + t3[a, b] * p2(b, c)) / (n3[a, b] + t3[a, b]) if n3[a, b] else p2(b, c)

    out = collections.defaultdict(list)
    for i, w in texts:
        s = ["", "", *w]
        out[i].append((len(w), sum(one[c] > 0 for c in w), sum(math.log10(p1(c)) for c in w), sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:], strict=False))))
    return out, total


def _rows():
    r = random.Random(4)
    word = lambda: r.choice(["the"] * 6 + ["Cat", "sat", "ON", "été", "日本", "x9", f"n{r.randrange(60)}"])
    rows = [(i, " ".join(word() for _ in range(r.randrange(1, 90)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "the cat"), (None, "the cat"), (103, "solo"), (104, "the " * 300), (104, rows[3][1]), (105, "a" * 5000 + "\x0bÉtÉ\x00z"), (106, "\x1f\x85  the")]
    return rows


def _check(got, rows, slack):
    want, total = slow_scores(rows)
    assert {r.train_tokens for r in got} == {total} and len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.score))
        assert r.held_out == _held(r.doc_id)
    assert set(by) == set(want)
    for i, each in by.items():
        for a, b in zip(sorted(each), sorted(want[i]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-8)
            assert abs(a[3] - b[3]) <= slack * b[0]


# one shard and batch; many of both; and contexts split by the words that follow
@pytest.mark.parametrize(("batch", "shard"), [(1 << 20, 1 << 19), (64, 150), (16, 20)])
def test_scores_against_dictionaries(spark, batch, shard):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("batch", F.lit(1)).repartition(3)
    _check(ngram_model.score(docs, batch_tokens=batch, shard_tokens=shard).collect(), rows, 0.0012)


def test_split_contexts_are_added_up(spark):
    rows = [(i, " ".join(f"the {'the ' * (k % 2)}w{(i * 7 + k) % 50}" for k in range(40))) for i in range(30)]
    _check(ngram_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), batch_tokens=128, shard_tokens=50).collect(), rows, 0.0012)


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = ngram_model.score(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert s.s > s.b


def test_scores_without_rows_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert ngram_model.score(spark.createDataFrame([], schema)).count() == 0
    held = [i for i in range(60) if _held(i)][:3]
    got = ngram_model.score(spark.createDataFrame([(i, "a b") for i in held], schema)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3


@pytest.mark.parametrize(("n", "most"), [(1, 1), (5, 10), (1000, 1 << 50), (1000, 1200), (40000, 1 << 21)])
def test_elias_fano(n, most):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, most, n))
    e = EliasFano(EliasFano.arrays(v))
    assert (e.access(np.arange(n)) == v).all()
    x = np.concatenate([r.integers(0, most + 5, 2000), v, v + 1])
    place, same = e.successor(x)
    assert (place == np.searchsorted(v, x)).all() and (same == np.isin(x, v)).all()


def test_trie_finds_what_it_holds_and_nothing_else():
    r = np.random.default_rng(1)
    key = np.unique(r.integers(0, 1 << 40, 500).repeat(40) << 20 | r.integers(0, 300, 20000))
    ctx, word = key >> 20, key & ((1 << 20) - 1)
    count = r.integers(1, 9, len(key))
    levels, keys, total, kinds = build(ctx, word, count, np.zeros(len(key), bool))
    assert len(levels) < 8 * len(key)
    ask = np.concatenate([keys, keys[:-1] + 1])
    own = r.integers(0, len(ask), 30000)
    words = r.integers(0, 302, 30000)
    code, weight = Trie(levels).find(ask, own, words)
    held = dict(zip(key.tolist(), (count / (total + kinds)[np.searchsorted(keys, ctx)]).tolist(), strict=True))
    want = np.array([held.get(int(ask[o]) << 20 | int(w), 0) for o, w in zip(own, words, strict=True)])
    there = want > 0
    assert ((code > 0) == there).all() and np.abs(np.log10(value(code[there]) / want[there])).max() <= 0.00051
    lam = dict(zip(keys.tolist(), (kinds / (total + kinds)).tolist(), strict=True))
    assert np.abs(np.log10(value(weight)) - np.log10([lam.get(k, 1.0) for k in ask.tolist()])).max() <= 0.00051
