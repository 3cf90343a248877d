"""Operators on texts of any width, reading, joining, streams, postings and tokens, against brute force."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from spanweave.functions import ngrams, tokens
from spanweave.operators import containment, cover, labels, partition, search, whole
from spanweave.plans.parse import Cancelled, Parsed, Stage, parse_corpus, run_tagged, stop_tagged
from spanweave.plans.tables import settle
from spanweave.sources.corpus import from_column, from_texts
from spanweave.sources.storage import DeserializeError, ImageStore, SerializeError, UnavailableError, bucketed
from spanweave.streaming.incremental import StreamingLabels


def naive_closed(texts):
    """Strings of two characters or more that occur twice or more, with counts, and different neighbours on both sides."""
    seen = {}
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 2, len(t) + 1):
                e = seen.setdefault(t[i:j], [0, set(), set()])
                e[0] += 1
                e[1].add(t[i - 1] if i else None)
                e[2].add(t[j] if j < len(t) else None)
    return {s: n for s, (n, a, b) in seen.items() if n > 1 and all(None in x or len(x) > 1 for x in (a, b))}


def _texts(rng, letters, count=5, most=60):
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, most))) for _ in range(count)]
    return [*texts, texts[0] + "x" + texts[1], texts[0] * 3, "a" * 40, "zz" + texts[2][1:] + "q", texts[3]]


# from long seeds, with short ones (all levels), and with groups so small that all keys are counted by aggregation
@pytest.mark.parametrize(("letters", "seed", "group"), [("abcdé😀", 6, 1 << 16), ("ab\0", 1, 1 << 16), ("ab", 1, 3)])
def test_closed_strings_of_any_width(spark, letters, seed, group):
    texts = _texts(random.Random(seed), letters)
    got = whole.repeated_closed(from_texts(spark, texts), seed, group).collect()
    assert {r.ngram: r.cnt for r in got} == naive_closed(texts) and len(got) == len({r.ngram for r in got})
    assert all(r.n == len(r.ngram) for r in got)


def test_closed_strings_up_to_a_width(spark):
    texts = _texts(random.Random(3), "abc")
    want = {s: n for s, n in naive_closed(texts).items() if len(s) <= 9}
    assert {r.ngram: r.cnt for r in whole.repeated_closed(from_texts(spark, texts), 4, widest=9).collect()} == want


def test_more_tokens_than_characters(spark):
    """Numbers beyond the last character, as of documents with more distinct words than there are characters."""
    texts = _texts(random.Random(4), "abc", 4, 30)
    number = {c: 1_500_000 + k for k, c in enumerate("abcqxz")}
    rows = spark.createDataFrame([(i, [number[c] for c in t]) for i, t in enumerate(texts)], "text_id long, text array<int>")
    want = {tuple(number[c] for c in s): n for s, n in naive_closed(texts).items()}
    assert {tuple(r.ngram): r.cnt for r in whole.repeated_closed(rows, 2).collect()} == want
    symbols = spark.createDataFrame([(c, n) for c, n in number.items()], "token string, number int")
    assert {r.ngram for r in tokens.decoded(whole.repeated_closed(rows, 2), symbols, "ngram", "").collect()} == set(naive_closed(texts))


def test_text_labels_are_the_base_labels(spark):
    texts = ["ottos mops trotzt", "otto: fort mops fort", "ottos mops hopst fort", "otto: soso", "o"]
    c = from_texts(spark, texts)
    want = {tuple(r) for r in labels.base_labels(containment.vocabulary(c)).collect()}
    assert {tuple(r) for r in whole.text_labels(c, seed=2).collect()} == want


@pytest.mark.parametrize("group", [1 << 16, 10])
def test_labelled_prefixes(spark, group):
    rng = random.Random(2)
    texts = _texts(rng, "abc", 4, 90)
    known = {t[i : i + rng.choice([1, 2, 3, 5, 9, 17, 40, 70])] for t in texts for i in rng.choices(range(len(t)), k=12)} | set(texts[:3])
    lab = spark.createDataFrame([(x, len(x)) for x in sorted(known)], "ngram string, n int")
    want = {(i, p): [n for n in range(len(t) - p, 0, -1) if t[p : p + n] in known] for i, t in enumerate(texts) for p in range(len(t))}
    got = whole.labelled_prefixes(from_texts(spark, texts), lab, group=group).collect()
    assert {(r.text_id, r.pos): (r.n, r.shorter) for r in got} == {k: (v[0], v[1] if len(v) > 1 else None) for k, v in want.items() if v}
    every = whole.labelled_prefixes(from_texts(spark, texts), lab, every=True, group=group).collect()
    assert sorted((r.text_id, r.pos, r.n) for r in every) == sorted((*k, n) for k, v in want.items() for n in v)


def test_wide_parents_have_the_same_cover(spark, monkeypatch):
    texts = [t for t in _texts(random.Random(5), "abc", 4, 50) if len(t) > 1]
    c = from_texts(spark, sorted(set(texts)))
    lab = labels.base_labels(containment.vocabulary(c))
    narrow = {tuple(r) for r in cover.child_cover(lab).collect()}
    monkeypatch.setattr(cover, "NARROW", 3)
    assert {tuple(r) for r in cover.child_cover(lab).select("parent", "offset", "child", "child_n").collect()} == {tuple(r) for r in cover.maximal(cover.inner_intervals(lab)).select("parent", "offset", "child", "child_n").collect()}
    assert narrow


def test_lookup_in_a_long_text(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(300)] + ["ab" * 200]
    text = "".join(rng.choice(words) for _ in range(5000))[:29600] + "ab" * 200
    known = spark.createDataFrame([(w, len(w)) for w in sorted(set(words))], "ngram string, n int")
    began = time.time()
    got = {r.offset: r.child_n for r in search.longest_labels(spark.createDataFrame([(text,)], "query string"), known).collect()}
    took = time.time() - began
    held, want = set(words), {}
    for p in range(len(text)):
        for n in (400, *range(11, 0, -1)):
            if text[p : p + n] in held and len(text) - p >= n:
                want[p] = n
                break
    assert got == want and took < 60


def test_tilings_spell_their_texts(spark):
    texts = [t for t in sorted(set(_texts(random.Random(8), "abcd"))) if t]
    c = from_texts(spark, texts)
    tops, rules = whole.text_grammar(c, whole.text_labels(c, seed=2))
    assert {r.text_id: r.spelled for r in whole.joined_cells(tops, "text_id").collect()} == {i: t for i, t in enumerate(texts) if len(t) > 1}
    assert all(r.parent == r.spelled for r in whole.joined_cells(rules).collect())
    parents = {r.parent for r in rules.select("parent").distinct().collect()}
    children = {r.child for r in tops.select("child").union(rules.select("child")).filter("length(child) > 1").distinct().collect()}
    assert children <= parents and not children & {t for t in texts if len(t) > 1 and texts.count(t) == 1 and all(t not in u for u in texts if u != t)}


@pytest.mark.parametrize(("letters", "piece"), [("abé😀", 1 << 21), ("ab\0", 50), ("".join(map(chr, range(300, 700))), 200)])
def test_tilings_against_brute_force_without_a_row_for_each_position(spark, monkeypatch, letters, piece):
    rng = random.Random(piece)
    texts = [t for t in _texts(rng, letters, 4, 90) if t]
    texts += ["".join(rng.choice(texts[:3]) for _ in range(30))]
    known = {t[i : i + rng.choice([1, 2, 3, 5, 6, 15, 16, 17, 40, 64, 70])] for t in texts for i in rng.choices(range(len(t)), k=12)} | {*texts[:3], "a?", "?b" * 40}
    held = []

    def settled(df, name):
        out = settle(df, name)
        held.append((out.count(), name))
        return out

    monkeypatch.setattr(whole, "settle", settled)
    got = {}
    for r in sorted(whole.tiled(from_texts(spark, texts), spark.createDataFrame([(x,) for x in sorted(known)], "ngram string"), piece).collect()):
        assert r.sub_index == len(got.setdefault(r.text_id, [])) and r.child_n == len(r.child)
        got[r.text_id].append((r.offset, r.child))
    want = {}
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) > 1:
            n = max([n for n in range(1, len(t) - at + 1) if n < len(t) and t[at : at + n] in known], default=1)
            want.setdefault(i, []).append((at, t[at : at + n]))
            at += n
    assert got == want
    assert held and (piece < 1 << 21 or max(held)[0] < sum(map(len, texts)) / 4)


def test_bounded_parse_has_a_grammar_of_whole_texts(spark):
    rng = random.Random(3)
    words = ["ottos", "mops", "hopst", "fort", "trotzt", "soso", "und", "wieder"]
    texts = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(12)] + ["o", "ot"]
    out = parse_corpus(from_texts(spark, texts), max_n=8)
    assert {r.ngram for r in out.labels.filter("kind = 'root'").collect()} == set(texts)
    assert all(r.n <= 8 for r in out.labels.filter("kind <> 'root'").collect())
    spelled = {r.parent: r.spelled for r in whole.joined_cells(out.graph).collect()}
    assert all(k == v for k, v in spelled.items()) and {t for t in texts if len(t) > 1} <= set(spelled)
    assert {r.child for r in out.graph.filter("child_n > 1").select("child").distinct().collect()} <= set(spelled)


def test_a_running_layer_is_cancelled_and_resumed(spark):
    asked = []

    def stop():
        asked.append(1)
        return len(asked) > 4  # four stages ask before they run, then the first layer

    out = parse_corpus(from_texts(spark, ["abab", "babab", "aabb"]), until=Stage.WRAPPERS)
    with pytest.raises(Cancelled):
        parse_corpus(out.corpus, resume=out, cancelled=stop)
    assert out.stage == Stage.WRAPPERS and out.graph is None
    assert parse_corpus(out.corpus, resume=out).graph.count() > 0


def test_layers_that_are_whole_are_kept(spark, monkeypatch):
    texts = ["abcabdabc", "babcabab", "aabbdcab"]
    want = parse_corpus(from_texts(spark, texts))
    assert want.steps["vocab"] == want.vocab.count() and want.steps["labels"] > 0
    made, cover = [], partition.child_cover

    def slow_cover(known, layer):
        made.append(sorted(r.ngram for r in layer.collect()))
        if len(made) == 2:  # a job that only a stop from outside ends
            for after in (1, 4, 8):  # the job may not have begun yet
                threading.Timer(after, stop_tagged, [spark, "layers"]).start()
            spark.range(8, numPartitions=4).filter("length(java_method('java.lang.Thread', 'sleep', id * 0 + 5000)) >= 0").collect()
        return cover(known, layer)

    monkeypatch.setattr(partition, "child_cover", slow_cover)
    mine = Parsed(from_texts(spark, texts))
    with pytest.raises(Exception, match="(?i)cancel|interrupt"):
        run_tagged(spark, "layers", lambda: parse_corpus(mine.corpus, resume=mine).graph)
    assert len(made) == 2
    assert mine.stage == Stage.WRAPPERS and mine.graph is None and len(mine.layers.edges) == 1
    parse_corpus(mine.corpus, resume=mine)
    assert made[1] == made[2] and made.count(made[0]) == 1  # the layer that was stopped runs again, that before it does not
    assert sorted(map(tuple, mine.graph.collect())) == sorted(map(tuple, want.graph.collect()))


def slow_wrappers(intervals):
    """All intervals that overlapping ones merge into, with what they are made of."""
    found = set(intervals)
    while True:
        more = {(s, e2) for s, e in found for s2, e2 in intervals if s < s2 < e < e2} - found
        if not more:
            return found
        found |= more


def test_wrapper_ranges(spark):
    rng = random.Random(6)
    every = {k: {(s := rng.randrange(30), s + rng.randrange(2, 6 + k)) for _ in range(3 * k)} for k in range(1, 9)}
    rows = [(k, s, e) for k, v in every.items() for s, e in v]
    got = labels.wrapper_ranges(spark.createDataFrame(rows, "text_id long, s int, e int")).collect()
    assert {(r.text_id, r.s, e) for r in got for e in range(r.lo, r.hi + 1)} == {(k, s, e) for k, v in every.items() for s, e in slow_wrappers(v)}


def test_joined_patterns_spell_their_parents(spark):
    c = from_texts(spark, ["ottos mops trotzt", "otto: fort mops fort", "ottos mops hopst fort", "otto: soso"])
    g = settle(partition.partition_static(settle(labels.all_labels(c, settle(containment.vocabulary(c), "vocab")), "labels")), "grammar")
    splits = g.filter("offset > 0").select("parent", F.col("offset").alias("at"), F.lit(False).alias("top"))
    splits = splits.union(g.select("parent", F.floor(F.length("parent") / 3).cast("int"), F.lit(True)).distinct().filter(F.length("parent") > 5))
    new = partition.joined_patterns(g, splits)
    spelled = {}
    for r in sorted(new.collect(), key=lambda r: (r.parent, r.pattern_id, r.sub_index)):
        s = spelled.setdefault((r.parent, r.pattern_id), "")
        assert len(s) == r.offset and r.child_n == len(r.child)
        spelled[r.parent, r.pattern_id] = s + r.child
    assert spelled and all(k[0] == s for k, s in spelled.items())
    # every part is a node: it has a pattern, or is one of the grammar's, or a single character
    known = {k[0] for k in spelled} | {r.parent for r in g.select("parent").distinct().collect()} | {r.child for r in g.select("child").distinct().collect()}
    wanted = {r.part for r in partition.joined_partitions(splits).select("part").distinct().collect()}
    assert {r.child for r in new.select("child").distinct().collect()} <= wanted | known


def slow_read(queries, known):
    known = set(known) | {c for q in queries for c in q}
    while True:
        chains, new = {}, set()
        for q in queries:
            best = {p: max(n for n in range(1, len(q) - p + 1) if q[p : p + n] in known) for p in range(len(q))}
            cells, reach, out = [(p, p + n) for p, n in sorted(best.items())], -1, []
            for s, e in cells:
                if e <= reach:
                    continue
                if out and s < reach:
                    out[-1] = (out[-1][0], e, out[-1][2] + 1)
                else:
                    out.append((s, e, 1))
                reach = e
            chains[q] = [(s, e) for s, e, _ in out]
            new |= {q[s:e] for s, e, k in out if k > 1}
        if new <= known:
            return chains, known
        known |= new


def test_reading_by_induction(spark):
    rng = random.Random(12)
    text = lambda k: "".join(rng.choice("abcd") for _ in range(k))
    for _ in range(2):
        queries = sorted({text(rng.randrange(1, 30)) for _ in range(8)} | {"xyz", "a" * 70})
        known = sorted({text(rng.randrange(1, 5)) for _ in range(12)})
        chains, labels_after = slow_read(queries, known)
        lab = spark.createDataFrame([(k, len(k), "frequency") for k in known], "ngram string, n int, kind string")
        for parts in (1, 5):
            rules, after = search.read_sequences(spark.createDataFrame([(q,) for q in queries], "query string").repartition(parts), lab)
            got = {}
            for r in sorted(rules.collect(), key=lambda r: (r.query, r.sub_index)):
                got.setdefault(r.query, []).append((r.offset, r.offset + r.child_n))
                assert r.child == r.query[r.offset : r.offset + r.child_n]
            assert got == chains
            assert {r.ngram for r in after.collect()} == labels_after | set(queries)


def test_labels_of_a_stream(spark, tmp_path):
    rng = random.Random(4)
    parts = [[f"{rng.choice(['ab', 'ba', 'abc'])}{rng.choice(['xab', 'yab', 'bab'])}{k}" for k in range(4 * i, 4 * i + 4)] for i in range(5)]
    parts[3].append(parts[0][0])  # seen before
    for i, texts in enumerate(parts):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert len([f for f in os.listdir(tmp_path / "in") if f.startswith("part")]) == 5
    s = StreamingLabels(spark, root=f"file://{tmp_path}/s")
    s.run(spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"))
    assert [p["rows"] for p in s.progress] and sorted(p["rows"] for p in s.progress) == [4, 4, 4, 4, 5] and len(s.batches()) == 5
    assert sum(p["texts"] for p in s.progress) == 20 and all(p["ngrams"] == spark.read.parquet(f"{s.root}/summary/{p['batch']}").count() for p in s.progress)
    every = sorted({t for p in parts for t in p})
    want = {tuple(r) for r in labels.base_labels(containment.vocabulary(from_texts(spark, every))).collect()}
    assert {tuple(r) for r in s.labels().collect()} == want
    # a batch holds its own n-grams only
    k = s.batches()[-1]
    own = {r.text for r in spark.read.parquet(f"{s.root}/texts/{k}").collect()}
    assert {r.ngram for r in spark.read.parquet(f"{s.root}/summary/{k}").collect()} == {t[i:j] for t in own for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    s.compact()
    assert s.batches() == [k] and {tuple(r) for r in s.labels().collect()} == want
    again = StreamingLabels(spark, root=s.root)
    again.merge(spark.createDataFrame([(every[0],), ("new",)], "text string"), k + 1)
    both = {tuple(r) for r in labels.base_labels(containment.vocabulary(from_texts(spark, [*every, "new"]))).collect()}
    assert {tuple(r) for r in again.labels().collect()} == both


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_postings(spark, block):
    texts = ["abab", "b", "", "bab", "aab", "abab"]
    index = ngrams.postings(from_texts(spark, texts), block_texts=block)
    want = sorted((t[i:j], k, i) for k, t in enumerate(texts) for i in range(len(t)) for j in range(i + 1, len(t) + 1))
    found = ngrams.located(index, index.select("ngram"), block_texts=block)
    assert sorted((r.ngram, r.text_id, r.pos) for r in found.collect()) == want
    assert max(r.cnt for r in index.collect()) <= block * 4


def test_tokens_as_characters(spark):
    rows = [(1, ["a", "new york", "", "a"]), (2, ["b", None, "a"]), (3, []), (4, [str(k) for k in range(70000)])]
    d = spark.createDataFrame(rows, "text_id long, tokens array<string>")
    symbols = tokens.alphabet(d)
    got = {r.text_id: r.text for r in tokens.encoded(d, symbols).collect()}
    assert len(got[1]) == 4 and got[1][0] == got[1][3] and got[2][1] == got[1][0] and len(set(got[4])) == 70000
    assert {r.text_id: r.text for r in tokens.decoded(tokens.encoded(d, symbols), symbols, "text", "|").collect()} == {1: "a|new york||a", 2: "b|a", 4: "|".join(rows[3][1])}


def test_counts_by_widest_ngrams(spark):
    texts = ["abcabc", "a", "", "éabé"]
    for least, most in ((1, 3), (2, 2), (2, 5)):
        want = {}
        for t in texts:
            for i in range(len(t)):
                for j in range(i + least, min(len(t), i + most) + 1):
                    want[t[i:j]] = want.get(t[i:j], 0) + 1
        assert {r.ngram: r.cnt for r in ngrams.counts(from_texts(spark, texts), most, least).collect()} == want


def test_joined_token_grams_are_dealt_once(spark):
    rng = random.Random(7)
    rows = [[rng.choice(["a", "b", "ab", "é😀"]) for _ in range(k)] for k in (0, 1, 2, 3, 700)] + [["a", None, "b"], [None]]
    for most in (1, 2, 4):
        want = {}
        for w in rows:
            w = [x for x in w if x]
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + most) + 1):
                    want[tuple(w[i:j])] = want.get(tuple(w[i:j]), 0) + 1
        d = ngrams.token_counts(spark.createDataFrame([(w,) for w in rows], "tokens array<string>"), most, between="--")
        got = d.collect()
        assert {tuple(r.gram.split("--")): r.cnt for r in got} == want and all(r.n == len(r.gram.split("--")) for r in got)
        assert d._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString().count("Exchange hashpartitioning") == 1


def test_numbers_follow_the_order(spark):
    texts = [f"{(k * 7919) % 1000:03}" for k in range(1000)] + ["000", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(7)
    assert sorted(tuple(r) for r in from_column(rows, "t").collect()) == [(k, f"{k:03}") for k in range(1000)]
    assert from_column(rows.filter("t IS NULL"), "t").count() == 0


def test_kinds_of_storage_errors(spark, tmp_path):
    store = ImageStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(SerializeError):
        store.store("k", {"vocab": spark.sql("SELECT INTERVAL 1 MONTH + INTERVAL 0 MONTH AS i, parse_json('1') IS NULL AS j, make_interval(1) AS m")})
    assert not store.exists("k")
    (tmp_path / "s" / "bad" / "vocab").mkdir(parents=True)
    (tmp_path / "s" / "bad" / "vocab" / "x.parquet").write_text("no table")
    with pytest.raises(DeserializeError):
        store.load("bad")
    with pytest.raises(UnavailableError):
        ImageStore(spark, "nosuchscheme://host/x").exists("k")


def test_bucketed_images_join_without_an_exchange(spark):
    c = from_texts(spark, ["abab", "babc", "abcabc"])
    vocab = containment.vocabulary(c)
    names = [f"spanweave_test_{k}_{os.getpid()}" for k in ("vocab", "labels", "edges")]
    try:
        v, lab = bucketed(vocab, names[0], buckets=4), bucketed(labels.base_labels(vocab), names[1], buckets=4)
        e = bucketed(containment.edges(vocab).withColumnRenamed("child", "ngram"), names[2], buckets=4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for joined in (v.join(lab, "ngram", "left_semi"), e.join(lab, "ngram"), v.groupBy("ngram").count()):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and joined.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_graphs_from_tables(spark):
    from spanweave.sources import graphs

    rules = [(p, k, c) for p, patterns in graphs.EXAMPLES[2].items() for k, c in enumerate(patterns)]
    schema = "parent string, pattern_id int, cells array<string>"
    got = graphs.from_table(spark.createDataFrame([*rules, (None, 0, ["a"]), ("b", 0, None), ("cd", 0, ["c", "", "d"])], schema)).collect()
    assert sorted(map(tuple, got)) == sorted([*map(tuple, graphs.example(spark, 2).collect()), ("cd", 0, 0, 0, "c", 1), ("cd", 0, 1, 1, "d", 1)])
    with pytest.raises(Exception, match="does not spell"):
        graphs.from_table(spark.createDataFrame([("ab", 0, ["a"])], schema)).collect()


def slow_graph(known):
    """The layered partition graph by its definition: (rows, labels) from the labels with their kinds."""
    labels_now, done, rows = set(known), set(), set()
    layer = {g for g, kind in known.items() if kind == "root" and len(g) > 1}
    while layer:
        children = set()
        for p in layer:
            held = [(i, j) for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and p[i:j] in labels_now]
            top = [x for x in held if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in held)]
            lines = []
            for i, j in sorted(top):
                open_lines = [line for line in lines if line[-1][1] <= i]
                if open_lines:
                    max(open_lines, key=lambda line: line[-1][0]).append((i, j))
                else:
                    lines.append([(i, j)])
            for k, line in enumerate(lines):
                ends = [0, *(x for cell in line for x in cell), len(p)]
                cells = [(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < b]
                rows |= {(p, k, m, a, p[a:b], b - a) for m, (a, b) in enumerate(cells)}
                children |= {p[a:b] for a, b in cells if b - a > 1}
        gaps = children - labels_now
        inner = {g: {g[i:j] for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g)} for g in gaps}
        common = {s for g in gaps for s in inner[g] if sum(s in inner[h] for h in gaps) > 1}
        shared = set()
        for g in gaps:
            own = [(i, j) for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and g[i:j] in common]
            shared |= {g[i:j] for i, j in own if not any((x, y) != (i, j) and x <= i and j <= y for x, y in own)}
        labels_now |= gaps | shared
        done |= layer
        layer = children - done
    return rows, labels_now


@pytest.mark.parametrize("seed", [1, 2])
def test_layered_graph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = sorted({"".join(rng.choice("abcd"[: 2 + seed]) for _ in range(rng.randrange(4, 13))) for _ in range(6)})
    # labels that are not closed under overlap, so that lines have gaps
    known = {c: "leaf" for t in texts for c in t} | {t[i : i + rng.randrange(2, 5)]: "frequency" for t in texts for i in rng.choices(range(len(t) - 3), k=3)} | dict.fromkeys(texts, "root")
    graph, after = partition.partition_graph(spark.createDataFrame([(g, len(g), k) for g, k in sorted(known.items())], "ngram string, n int, kind string"))
    rows, labels_after = slow_graph(known)
    assert {(r.parent, r.pattern_id, r.sub_index, r.offset, r.child, r.child_n) for r in graph.collect()} == rows
    assert {r.ngram for r in after.collect()} == labels_after and any(r[1] > 0 for r in rows)
