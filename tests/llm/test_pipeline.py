"""The pipeline's stages, each against what it should keep of its own input."""

import collections
import random
import re

import corpus_pipeline
from spanweave.llm import simhash


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        out = corpus_pipeline.stage(stage(spark, docs, sf), name)
        after = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
        assert set(after) <= set(before)
        if name != "packing":
            assert out.columns == columns
        if name == "near_dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
            assert set(after) == set(groups.values()) and max(after.values()) == 1
        elif name == "packing":
            assert after == before
        elif name in ("language_id", "line_dedup"):
            assert len(after) > 0.9 * len(before)
        docs = out


def test_run_matches_the_query(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0


def test_near_dedup_judges_rows_by_component(spark):
    rows = [(None, f"clean text {i} " + " ".join(f"w{i}x{k}" for k in range(40)), "en", "s", 1) for i in range(20)]
    rows += [(7, rows[0][1], "en", "s", 1), (8, rows[1][1], "en", "s", 1), (8, "other " + " ".join(f"q{k}" for k in range(40)), "en", "s", 1), (9, rows[1][1], "en", "s", 1), (9, rows[1][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.text, r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(t, None) for _, t, *_ in rows[2:20]] + [(rows[0][1], 7), (rows[1][1], 8), (rows[22][1], 8)], key=str)


def _sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {" ".join(w[i : i + 5]).lower() for i in range(max(1, len(w) - 4))}


def _near(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def _edited(rng):
    """Short and medium texts, each with copies of one to four changed words, and a chain of a text's copies of copies."""
    texts = []
    for n in (6, 24, 30, 60, 120, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(base))
            for k in (1, 2, 3, 4):
                copy = list(base)
                for at in rng.sample(range(n), k):
                    copy[at] = f"c{rng.randrange(10**6)}"
                texts.append(" ".join(copy))
    for _ in range(12):
        base[rng.randrange(300)] = base[rng.randrange(300)] = "new"
        texts.append(" ".join(base).upper())
    return [*texts, None, "", " ", "one", "One"]


def test_near_copies_match_brute_force(spark):
    texts = _edited(random.Random(11))
    sets, up = [_sets(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if up[a] != up[b] and _near(sets[a], sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = [lo if x == hi else x for x in up]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == dict(enumerate(up))
    assert len(set(up)) < len(up) - 24


def test_no_near_copy_passes_the_pipeline(spark):
    texts = [t for t in _edited(random.Random(12)) if t and len(t) > 5]
    out = docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if "dedup" in name and name != "line_dedup":
            out = corpus_pipeline.stage(stage(spark, out, ""), name)
    kept = [_sets(r.text) for r in out.collect()]
    assert out.columns == docs.columns and not any(_near(kept[a], kept[b]) for a in range(len(kept)) for b in range(a))
    assert all(any(_near(_sets(t), k) for k in kept) for t in texts[:120:5])  # no group is lost
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def _noun(i):
    return "".join(chr(97 + int(c)) for c in str(1000 + i))


def _docs_of_lines(spark, lines):
    rows = [(i, f"{_noun(i)} was here\n{line}\n{_noun(i)} went off", "en", "s", 0) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_line_dedup_keeps_different_lines_with_one_opening(spark):
    lines = [f"It is a {_noun(i)}" for i in range(15)] + [f"He said that {_noun(i)} {_noun(i + 50)} {_noun(i + 90)}" for i in range(15)]
    lines += [f"Read all our terms and {_noun(i)} here today" for i in range(15)]
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, _docs_of_lines(spark, lines), "").collect()}
    assert [i for i, line in enumerate(lines) if line in kept[i]] == list(range(30))


def test_line_dedup_drops_short_boilerplate(spark):
    lines = ["All rights reserved."] * 12 + ["}"] * 12 + ["7 - 9"] * 12 + [f"Only {_noun(i)}" for i in range(12)] + ["Rarely seen"] * 9
    kept = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.drop_lines(spark, _docs_of_lines(spark, lines), "").collect()}
    assert [i for i, line in enumerate(lines) if line in kept[i]] == list(range(12, len(lines)))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows and ids, and an empty table, through every stage."""
    words = lambda n, k: " ".join(f"the house {_noun(n + i)} and {_noun(k + i)}" for i in range(30))
    rows = [(i, words(7 * i, 11 * i), "en", f"s{i % 2}", 1) for i in range(30)]
    rows += [(None, words(3000, 4000), None, None, None), (None, words(5000, 6000), None, None, None), (3, words(7000, 8000), "en", "s0", 1), rows[4], rows[4], (50, None, None, None, None), (51, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = docs.filter("length(text) > 0")
    for name, function in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(function(spark, kept, ""), name)
        assert corpus_pipeline.stage(function(spark, docs, ""), name).count() >= out.count() - 2, name
        assert function(spark, docs.limit(0), "").count() == 0, name
        had, has = (collections.Counter((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()) for d in (kept, out))
        assert set(has) == set(had) or name == "mixing" and set(has) <= set(had), name  # all of these are clean
        if name == "near_dedup":
            assert max(has.values()) == 1
        elif name != "mixing":
            assert has == had, name


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
