"""Golden labels, structural invariants, and brute-force models on small corpora."""

import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators import containment, cover, labels, language_model, partition, search
from spanweave.plans.parse import Cancelled, Stage, parse_corpus
from spanweave.sources.corpus import EmptyVocabularyError, from_texts, joined, corpus_name
from spanweave.sources.graphs import pattern_graph
from spanweave.sources.storage import ImageStore, NotFoundError

#: Required values of the specification: four sentences and their labels.
MOPS = ["ottos mops trotzt", "otto: fort mops fort", "ottos mops hopst fort", "otto: soso"]
MOPS_FREQUENCY = {"ot", "s ", "so", "os", "t ", "ops", "otto", " mops ", "otto: ", " fort", "ottos mops "}
MOPS_WRAPPERS = {
    " fort ", " fort mops ", " fort mops fort", " mops fort", "ops ", "ops fort", "os ", "os mops ", "oso", "otto: fort", "otto: fort ", "otto: fort mops ", "ottos", "ottos ",
    "s fort", "s mops ", "sos", "soso", "t fort", "t mops ", "t mops fort",
}


def kinds(spark, texts):
    c = from_texts(spark, texts)
    out = {}
    for r in labels.all_labels(c, containment.vocabulary(c)).collect():
        out.setdefault(r.kind, set()).add(r.ngram)
    return out


def test_golden_small(spark):
    got = kinds(spark, ["abab", "abcabc", "babc"])
    assert got["frequency"] == {"ab", "abc", "bab"} and "wrapper" not in got
    assert got["root"] == {"abab", "abcabc", "babc"} and got["leaf"] == set("abc")


def test_golden_sentences(spark):
    got = kinds(spark, MOPS)
    assert got["frequency"] == MOPS_FREQUENCY
    assert got["wrapper"] == MOPS_WRAPPERS


@pytest.mark.parametrize(("texts", "expected"), [(["aabbaabbaa"], {"aa", "aabbaa"}), (["aaaa"], {"aa", "aaa"}), (["abc", "bcd"], {"bc"}), (["xyz"], set()), (["é😀é😀", "a"], {"é😀"})])
def test_frequency(spark, texts, expected):
    assert kinds(spark, texts).get("frequency", set()) == expected


def naive_closed(texts):
    count = {}
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                count[t[i:j]] = count.get(t[i:j], 0) + 1
    chars = {c for t in texts for c in t}
    return {s for s, n in count.items() if len(s) > 1 and s not in texts and all(count.get(s + c) != n and count.get(c + s) != n for c in chars)}, count


def test_random_corpora_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 4))]
        closed, count = naive_closed(texts)
        c = from_texts(spark, texts)
        v = containment.vocabulary(c)
        assert {r.ngram: r.cnt for r in v.collect()} == count
        assert {r.ngram for r in labels.frequency_labels(v).collect()} == closed
        assert {r.ngram: r.cnt for r in containment.propagated_counts(c, containment.edges(v)).collect()} == count


def test_bounded_ngrams_cross_chunks(spark):
    from spanweave.functions import ngrams

    text = "".join(random.Random(5).choice("abc\n😀") for _ in range(9000))
    got = {r.ngram: r.cnt for r in ngrams.counts(from_texts(spark, [text, ""]), 3).collect()}
    want = {}
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            want[text[i : i + n]] = want.get(text[i : i + n], 0) + 1
    assert got == want
    rows = ngrams.occurrences(from_texts(spark, [text]), 2).collect()
    assert all(text[r.pos : r.pos + r.n] == r.ngram and (r.prev or "") == text[r.pos - 1 : r.pos] * (r.pos > 0) and (r.next or "") == text[r.pos + r.n : r.pos + r.n + 1] for r in rows)


def test_patterns_spell_their_parents(spark):
    out = parse_corpus(from_texts(spark, MOPS))
    assert out.stage == Stage.FINISHED
    for edges in (out.containment, out.graph, partition.partition_static(out.labels.filter("kind <> 'partition'"))):
        spelled = edges.groupBy("parent", "pattern_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub_index", "child"))), lambda x: x["child"]), "").alias("s"))
        assert spelled.filter("s <> parent").isEmpty()
    assert {r.text: r.spelled for r in partition.reconstructed(out.graph, out.corpus.select("text")).collect()} == {t: t for t in MOPS}
    assert out.containment.groupBy("parent").agg(F.countDistinct("pattern_id").alias("k")).filter("k > 2").isEmpty()


def test_line_packing():
    for line in partition.pack_lines("abcdef", [(0, 3), (2, 2), (4, 2)]):
        assert "".join("abcdef"[a : a + w] for a, w in line) == "abcdef"
    assert partition.pack_lines("abcdef", [(0, 3), (2, 2), (4, 2)]) == [[(0, 3), (3, 3)], [(0, 2), (2, 2), (4, 2)]]  # the last cell joins the line whose last cell starts latest


def test_cover_and_overlaps(spark):
    lab = spark.createDataFrame([("abcd", 4, "root"), ("abc", 3, "frequency"), ("bcd", 3, "frequency"), ("bc", 2, "frequency"), *[(c, 1, "leaf") for c in "abcd"]], "ngram string, n int, kind string")
    got = {(r.parent, r.offset, r.child) for r in cover.child_cover(lab).collect()}
    assert {g for g in got if g[0] == "abcd"} == {("abcd", 0, "abc"), ("abcd", 1, "bcd")}
    assert [tuple(r) for r in cover.overlaps(cover.child_cover(lab)).filter("parent = 'abcd'").collect()] == [("abcd", 0, 1)]


def test_continuations(spark):
    v = containment.vocabulary(from_texts(spark, ["ottos", "otto:", "ottos", "otto:", "otzt"]))
    got = {(r.v, r.w): r.p for r in language_model.continuations(v, 2).collect()}
    assert got["ot", "to"] == pytest.approx(4 / 5) and got["ot", "zt"] == pytest.approx(1 / 5)


def test_search_and_insert(spark):
    c = from_texts(spark, ["aabb", "bbaa"])
    v = containment.vocabulary(c)
    lab = labels.all_labels(c, v)
    q = spark.createDataFrame([("bbx",), ("zz",)], "query string")
    assert [tuple(r) for r in search.largest_prefix(q, v).collect()] == [("bbx", "bb", 2, "x")]
    assert {tuple(r) for r in search.blocks(q, v.filter("is_leaf")).collect()} == {("bbx", 0, 2, True), ("bbx", 2, 1, False), ("zz", 0, 2, False)}
    grown = search.inserted(c, lab, spark.createDataFrame([("abab",), ("",)], "text string"))
    assert "abab" in {r.ngram for r in grown.collect()} and grown.count() >= lab.count()


def test_insertion_equals_a_fresh_parse(spark):
    rng = random.Random(9)
    cases = [(["xab", "zyx", "xyb"], ["xaby", "zabw", "qxabq"]), (["aabb", "bbaa"], ["abab", "aabb", "bb"]), (["hello", "world"], ["held", "word", "low"]), (["a", "b", "c"], ["abc"])]
    cases += [(["".join(rng.choice("ab") for _ in range(rng.randrange(2, 8))) for _ in range(3)], ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(2)]) for _ in range(2)]
    for old, new in cases:
        old = sorted(set(old))
        c = from_texts(spark, old)
        lab = labels.all_labels(c, containment.vocabulary(c))
        got = {(r.ngram, r.kind) for r in search.inserted(c, lab, spark.createDataFrame([(t,) for t in new], "text string")).collect()}
        assert got == {(g, k) for k, v in kinds(spark, sorted({*old, *new})).items() for g in v}, (old, new)


def test_failed_stage_is_resumed(spark, monkeypatch):
    out = parse_corpus(from_texts(spark, MOPS), until=Stage.CONTAINMENT)
    with monkeypatch.context() as m:
        m.setattr(labels, "base_labels", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            parse_corpus(out.corpus, resume=out)
    assert out.stage == Stage.CONTAINMENT
    assert parse_corpus(out.corpus, until=Stage.WRAPPERS, resume=out).labels.filter("kind = 'wrapper'").count() == len(MOPS_WRAPPERS)


def test_streams_replay_and_restart(spark, tmp_path):
    from spanweave.streaming.incremental import StreamingCounts

    frame = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    want = {r.ngram: r.cnt for r in containment.vocabulary(from_texts(spark, ["abc", "bcd", "cde"])).collect()}
    s = StreamingCounts(spark, root=f"file://{tmp_path}/s")
    s.merge(frame("abc"), 0)
    s.merge(frame("abc"), 0)
    s.merge(frame("bcd", "abc"), 1)
    again = StreamingCounts(spark, root=f"file://{tmp_path}/s")
    again.merge(frame("bcd", "abc"), 1)
    again.merge(frame("cde", None, ""), 2)
    assert {r.ngram: r.cnt for r in again.counts().collect()} == want
    assert StreamingCounts(spark, root=f"file://{tmp_path}/none").counts().count() == 0


def test_token_counts(spark):
    from spanweave.functions import ngrams

    tokens = [[str(random.Random(i).randrange(9)) for _ in range(n)] for i, n in enumerate((0, 1, 2, 255, 256, 257, 900))]
    want = {}
    for w in tokens:
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                want[tuple(w[i : i + n])] = want.get(tuple(w[i : i + n]), 0) + 1
    assert {tuple(r.gram): r.cnt for r in ngrams.token_counts(spark.createDataFrame([(w,) for w in tokens], "tokens array<string>"), 3).collect()} == want


def test_tsv(spark, tmp_path):
    from spanweave.sources.corpus import from_tsv

    (tmp_path / "t.tsv").write_text('id\ttext\n1\tab "c\n2\té😀\n3\t\n')
    assert {r.text for r in from_tsv(spark, f"file://{tmp_path}/t.tsv").collect()} == {'ab "c', "é😀"}


def test_trace(spark):
    found = spark.createDataFrame([("bcx", "bc", "abcd"), ("q", "q", "q")], "query string, match string, root string")
    assert {tuple(r) for r in search.trace(found).collect()} == {
        ("bcx", "b", "bc", "up", 0), ("bcx", "bc", "abc", "up", 0), ("bcx", "bc", "bcd", "up", 0), ("bcx", "abc", "abcd", "up", 1), ("bcx", "bcd", "abcd", "up", 0),
        ("bcx", "abcd", "abc", "down", -1), ("bcx", "abc", "c", "down", 1),
    }


def test_inner_splits(spark):
    # required values: the worked example of two rules that are split at 3 and 10
    rules = ["a,bcd,ef,gh,ijk,lm,no".split(","), "ab,cde,fg,hi,jkl,mn,o".split(",")]
    text = "".join(rules[0])
    cells = [(text, p, i, sum(map(len, r[:i])), c, len(c)) for p, r in enumerate(rules) for i, c in enumerate(r)]
    edges = spark.createDataFrame([*cells, ("jkl", 0, 0, 0, "j", 1), ("jkl", 0, 1, 1, "k", 1), ("jkl", 0, 2, 2, "l", 1)], partition.EDGE)
    got = partition.completed(edges, spark.createDataFrame([(text, 3), (text, 10)], "parent string, at int")).collect()
    assert sorted(r.at for r in got if r.parent == text) == [3, 4, 5, 8, 9, 10, 11, 12]
    assert {(r.at, r.top) for r in got if r.parent == "jkl"} == {(1, True), (2, True)} and {(r.at, r.top) for r in got if r.parent == "bcd"} == {(2, True)}


def test_joined_partitions(spark):
    splits = [("abcdefghijklmno", at, at in (3, 10)) for at in (3, 4, 5, 8, 9, 10, 11, 12)]
    got = {(r.lo, r.hi): r.part for r in partition.joined_partitions(spark.createDataFrame(splits, "parent string, at int, top boolean")).collect()}
    assert got[0, 3] == "abc" and got[5, 8] == "fgh" and got[3, 15] == "defghijklmno"
    assert (0, 12) not in got and (0, 15) not in got and len(got) == 45 - 3  # those from 0 to 11, 12 and 15 span both top splits


def test_empty_corpora(spark):
    for texts in ([], ["", ""]):
        with pytest.raises(EmptyVocabularyError):
            parse_corpus(from_texts(spark, texts))
    with pytest.raises(Cancelled):
        parse_corpus(from_texts(spark, ["ab"]), cancelled=lambda: True)


def test_names_grammars_and_store(spark, tmp_path):
    c = from_texts(spark, ["b", "a"])
    assert c.agg(joined(c).alias("t")).first().t == "b a"
    assert corpus_name(c).first() != corpus_name(from_texts(spark, ["a", "b"])).first()
    assert len({corpus_name(from_texts(spark, [f"{k}{i}" for i in range(200)])).first().name for k in "abc"}) == 3 and corpus_name(c.limit(0)).count() == 1
    assert pattern_graph(spark, {"abc": [["ab", "c"], ["a", "bc"]]}).count() == 4
    with pytest.raises(ValueError):
        pattern_graph(spark, {"abc": [["a", "c"]]})
    store = ImageStore(spark, f"file://{tmp_path}")
    assert store.through("k", lambda: {"corpus": c})["corpus"].count() == 2 and store.exists("k")
    with pytest.raises(Exception):
        store.store("half", {"corpus": c, "broken": c.select(F.raise_error(F.lit("no")).alias("x"))})
    assert not store.exists("half")
    store.store("k", {"corpus": c.limit(1)})
    assert store.load("k")["corpus"].count() == 1
    store.remove("k")
    with pytest.raises(NotFoundError):
        store.load("k")


def test_rule_union_prefers_the_first(spark):
    first = pattern_graph(spark, {"efgh": [["e", "fgh"]]})
    second = pattern_graph(spark, {"efgh": [["ef", "gh"], ["e", "fg", "h"]]})
    assert {(tuple(r.bounds), r.given) for r in partition.rule_union(first, second).collect()} == {((1,), "first"), ((2,), "second")}


def test_utf8_files(spark, tmp_path):
    from spanweave.sources.graphs import utf8_files

    (tmp_path / "good.txt").write_bytes("é😀\nb\n".encode())
    (tmp_path / "bad.txt").write_bytes(b"a\n\xff\xfe\n\xc3\n")
    got = {r.file.rpartition("/")[2]: (r.lines, r.invalid) for r in utf8_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"good.txt": (2, 0), "bad.txt": (3, 2)}


def test_widest_and_most_frequent_come_first(spark):
    from spanweave.functions import ngrams

    v = containment.vocabulary(from_texts(spark, ["abab", "b"]))
    assert [r.n for r in containment.widest_first(v).collect()] == [4, 3, 3, 2, 2, 1, 1]
    assert [r.ngram for r in ngrams.most_frequent_first(v).collect()][:3] == ["b", "a", "ab"]
    assert {r.ngram for r in containment.shared(v, containment.vocabulary(from_texts(spark, ["bab"]))).collect()} == {"a", "b", "ab", "ba", "bab"}
