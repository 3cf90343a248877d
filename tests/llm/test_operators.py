"""Each operator against a brute-force version on a small table of plain and odd rows."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanweave.llm import html_extract, induced_sorting, language_id, line_dedup, mixing, packing, permutation_index, quality_rules, registry, secret_scan, simhash, suffix_dedup
from spanweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, n_tokens string"


def _text(rng, n):
    return " ".join(rng.choice(["the", "cat", "sat", "Dog", "été", "x9", "on", "mat", "日本"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    base = [_text(rng, 120) for _ in range(12)]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s0"), (21, base[0], None, None), (21, base[0], None, None), (None, base[1], "fr", None)]
    rows += [(30, None, None, "s1"), (31, "", "en", "s1"), (32, " \t\n", "en", "s1"), (33, "one", "en", None), (34, "a" * 700, "en", "s2"), (35, (base[3] + "\n") * 3, "fr", "s2")]
    rows += [(36, "x" + base[4][50:400] + " tail " + base[5][100:390], "en", "s3"), (37, base[6].replace("cat", "cow", 1), "fr", "s3"), (38, _text(rng, 30000), "en", "s3")]
    return [(*r, 7, 8, "k", "n") for r in rows]


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).repartition(3)


def test_quality_rules(frame, docs):
    got = collections.Counter(tuple(r)[:7] for r in quality_rules.judge(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = collections.Counter()
    for i, t, *_ in docs:
        w, t = WORD.findall(t or ""), t or ""
        seen, covered = collections.defaultdict(list), set()
        for k in range(len(w) - 4):
            seen[tuple(w[k : k + 5])].append(k)
        for v in seen.values():
            if len(v) > 1:
                for k in v:
                    covered.update(range(k, k + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert got == want


def test_host_verdict(spark):
    bad = [("bad", True)] * 40 + [("good", False)] * 200 + [("tiny", True)] + [(None, True)] * 5
    got = {r.host: r.host_ok for r in quality_rules.host_verdicts(spark.createDataFrame(bad, "host string, failed boolean")).collect()}
    assert got == {"bad": False, "good": True, "tiny": True}
    many = spark.range(1000 * 200).select((F.col("id") % 1000).cast("string").alias("host"), (F.floor(F.col("id") / 1000) % 10 == 0).alias("failed"))
    small = spark.createDataFrame([("small", True)] * 50 + [("mixed", i % 4 > 0) for i in range(20)], "host string, failed boolean")
    assert [r.host for r in quality_rules.host_verdicts(many.union(small)).filter("NOT host_ok").collect()] == ["small"]


def _equal_to_sql(frame, got, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [tuple(r) for r in frame.select("doc_id", "text", "lang", "source").collect()])
    want = con.sql(sql)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in want.columns)) for r in got.collect())


def test_quality_rules_reject_a_host(spark, frame):
    bad = spark.createDataFrame([(1000 + i, "a b c" if i % 9 else _text(random.Random(i), 40), "en", "bad") for i in range(60)], "doc_id long, text string, lang string, source string")
    both = frame.select("doc_id", "text", "lang", "source").union(bad)
    got = quality_rules.judge(both)
    assert got.filter("NOT kept AND NOT base_failed").count() > 0
    _equal_to_sql(both, got, quality_rules.ORACLE)


def test_suffix_dedup(frame, docs):
    length, count, out = 200, collections.Counter(), collections.Counter()
    texts = [(i, (t or "").encode()) for i, t, *_ in docs]
    for _, b in texts:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    for i, b in texts:
        gone = np.zeros(len(b) + 2, np.int8)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = 1
        rest = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out[i, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(rest).hexdigest()] += 1
    got = suffix_dedup.dedup(frame, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == out


def test_suffix_dedup_hot_keys(frame):
    d = frame.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("t"))
    merged = lambda rows: {(r.doc, r.h): suffix_dedup._merged(r.ranges).tolist() for r in rows}
    assert merged(suffix_dedup.repeated_ranges(d, 200, hot_spans=0).collect()) == merged(suffix_dedup.repeated_ranges(d, 200).collect())


def test_rows_of_hot_keys(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 5000, 0).otherwise(F.floor(F.col("id") / 2)).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(-1, -1)], "k long, id long"))
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = sorted(r.id for r in suffix_dedup._repeated(rows, counted, ["k"], 9001).collect())
    assert got == list(range(9000))


def test_suffix_arrays():
    rng = random.Random(2)
    for trial in range(150):
        size = rng.choice([1, 2, 3, 250])
        strings = [np.array([rng.randrange(size) for _ in range(rng.randrange(0, 25))], np.uint8) for _ in range(rng.randrange(1, 5))]
        array, text, ends = induced_sorting.suffix_array(strings)
        starts = [e - len(v) for e, v in zip(ends, strings, strict=True)]
        suffixes = sorted(([int(x) + 1000 for x in v[o:]] + [i], s + o) for i, (s, v) in enumerate(zip(starts, strings, strict=True)) for o in range(len(v) + 1))
        assert [p for _, p in suffixes] == array.tolist(), trial
        _, plcp = induced_sorting.common_prefixes(array, text, ends)
        for (a, _), (b, p) in zip(suffixes, suffixes[1:], strict=False):
            assert plcp[p] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_ranks_of_names():
    rng = random.Random(3)
    for _ in range(300):
        names = np.unique([rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(1, 60))], return_inverse=True)[1]
        assert induced_sorting.rank_names(names).tolist() == sorted(range(len(names)), key=lambda k: names[k:].tolist())
    down = np.arange(3000)[::-1] // 2  # one run, whose names recur in pairs
    assert induced_sorting.rank_names(down).tolist() == sorted(range(len(down)), key=lambda k: down[k:].tolist())


def slow_fingerprint(text):
    w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in WORD.findall(text or "")]
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(frame, docs):
    fps = [(i, slow_fingerprint(t)) for i, t, *_ in docs]
    up = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 4:
                up = [up[b] if x == up[a] else x for x in up]
    least = {r: min((i for (i, _), u in zip(fps, up, strict=True) if u == r and i is not None), default=None) for r in up}
    want = collections.Counter((i, f, least[u]) for (i, f), u in zip(fps, up, strict=True))
    got = simhash.near_groups(frame).collect()
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_bit_sliced_links(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = [base]
    for _ in range(60):
        x.append(base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)))
    x = np.unique(np.concatenate(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    assert (simhash.rows_within(x[:50], simhash.planes_of(x), 4, len(x)) == near[:50]).all()
    i, j = rng.integers(0, len(x), (2, 5000))
    for radius in (0, 4, 7, 8, 28, 63, 64):
        assert (simhash.pairs_within(x[i], x[j], radius) == (np.bitwise_count(x[i] ^ x[j]) <= radius)).all()
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for chunk in (4096, 16):  # the small chunk cuts every bucket into pairs of chunks
        roots = {r.node: r.root for r in components(simhash.fingerprint_links(fps, 4, bucket_rows=4, chunk_rows=chunk)).collect()}
        groups = collections.defaultdict(set)
        for v, g in zip(x.view(np.int64).tolist(), label.tolist(), strict=True):
            groups[g].add(roots.get(v, v))
        assert all(len(s) == 1 for s in groups.values()) and len({min(s) for s in groups.values()}) == len(groups)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (8, 9)], "a long, b long")
    assert {r.node: r.root for r in components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert components(e.limit(0)).count() == 0


def test_permutation_index(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] + [1.0] * 15, 1), (1060, [None] + [1.0] * 15, 1), (1080, [1.0, 2.0], 1), (1081, [1.0, 2.0], 1), (1082, [1.0, -1.0], 1), (None, rows[5][1], 1)]
    f = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in permutation_index.search(f, chunk_rows=30).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.pop(1080) == [(1081, 5.0), (1082, -1.0)]  # vectors of another length are held against each other
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, near in got.items():
        s = x @ x[q]
        best = sorted((-s[i], i) for i in range(900) if i != q)[:20]
        hits += len({i for _, i in best} & {i for i, _ in near})
        assert near == sorted(near, key=lambda r: (-r[1], r[0])) and all(abs(s[i] - v) < 1e-9 for i, v in near) and len(near) == 20
    assert hits / (20 * len(got)) >= 0.9
    assert permutation_index.search(f.limit(0)).count() == 0


def test_short_lists_are_filled_up(spark):
    rng = np.random.default_rng(15)
    for ids in ([20 * k for k in range(15)], [*range(30)], [0, 20, 20, 20, 7]):
        x = rng.normal(size=(len(ids), 8)).astype(np.float32)
        got = permutation_index.search(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")).collect()
        by = collections.Counter(r.query_id for r in got)
        assert by == {q: min(20, sum(i != q for i in ids)) for q in ids if q % 20 == 0 and any(i != q for i in ids)}
        if len(set(ids)) == len(ids):
            for q in by:
                near = sorted(((x[ids.index(q)].astype(float) * v.astype(float)).sum(), -i) for i, v in zip(ids, x, strict=True) if i != q)[::-1][:20]
                if len(ids) <= 21:
                    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [-i for _, i in near]


def test_pivot_orders_in_blocks():
    rng = np.random.default_rng(3)
    x, p = rng.normal(size=(1300, 6)), rng.normal(size=(90, 6))
    for k in (1, 7, 90):
        assert (permutation_index.permutations(x, p, k, 512) == np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :k]).all()


def test_permutation_index_of_clusters_and_cones(spark):
    """Recall where raw orders tell nothing: one narrow cone, of unit and of raw vectors, clusters in it, and equal vectors."""
    rng = np.random.default_rng(16)
    unit = lambda y: y / np.linalg.norm(y, axis=1, keepdims=True)
    offset = np.eye(24)[0] * 40
    raw = [rng.normal(size=(3000, 64)) + mean for mean in (0, 1.5, 3)]
    clusters = rng.normal(size=(20, 24))[rng.integers(0, 20, 1600)] + 0.2 * rng.normal(size=(1600, 24))
    for x in (unit(rng.normal(size=(1600, 24)) + offset), rng.normal(size=(1600, 24)) + offset, clusters, unit(clusters + offset), np.ones((900, 3)), *raw):
        got = collections.defaultdict(set)
        for r in permutation_index.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
            got[r.query_id].add(r.vec_id)
        score, hits = x @ x[::20].T, 0
        for j, q in enumerate(range(0, len(x), 20)):
            hits += len(set([i for i in np.lexsort((np.arange(len(x)), -score[:, j])) if i != q][:20]) & got[q])
        assert hits / (20 * len(got)) >= 0.9


def test_optimal_buckets(frame, docs):
    import itertools

    rng = random.Random(7)
    for _ in range(30):
        edges = sorted(rng.sample(range(1, 60), rng.randrange(1, 8)))
        counts = [rng.randrange(1, 9) for _ in edges]
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= e) - e) for e, c in zip(edges, counts, strict=True))
        for k in (1, 2, 3):
            best = min(cost((*c, edges[-1])) for n in range(min(k, len(edges))) for c in itertools.combinations(edges[:-1], n))
            got = packing.optimal_bounds(edges, counts, [e * c for e, c in zip(edges, counts, strict=True)], k)
            assert len(got) <= k and cost(got) == best
    rows = packing.pack(frame, n_buckets=3, budget=400, shard_rows=4).collect()
    assert len(rows) == len(docs) and rows[0].asDict().keys() >= {"doc_id", "text", "h", "key", "n_tokens", "batch"}
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens == len(WORD.findall(r.text or "")) and r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), members in batches.items():
        room = max(1, 400 // max(1, members[0].bucket_len))
        assert sorted(r.slot for r in members) == list(range(len(members))) and len(members) <= room
        assert len(members) == room or (bucket, batch + 1) not in batches


def test_packing_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(packing.ORACLE)
    got = registry.op5_packing(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns and collections.Counter(map(tuple, got.collect())) == collections.Counter(want.fetchall())


def test_length_bins(spark):
    lengths = [0, 1, 1025, 65535, 65536, 65537, 131071, 131073, 10**6 + 1]
    rows = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", packing.edge(F.col("n")).alias("e")).collect()
    assert {r.n: r.e for r in rows} == {n: -(-n // (1 << max(0, n.bit_length() - 16))) * (1 << max(0, n.bit_length() - 16)) for n in lengths}


def test_html_extract(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/x">menu</a></nav><!-- ad --><div class="ad">buy</div>
    <article><h1>Title &amp; more</h1><p><b>First<br><p>a&nbsp; b <i>c</i>d &lt;x&gt;</p><div class="comments">no</div><form>f</form><p>Last &am</p></article><aside>s</aside><footer>&copy; f</footer>"""
    bare = "<body><div class='menu'>m</div><div><p>Only  text</p> tail</div><p"
    rows = [(1, "http://A.example/1", page), (2, None, page), (3, "http://a.example/2", None), (4, "http://b.example/", bare), (4, "http://b.example/", bare), (None, "x", "")]
    rows += [(100 + i, f"http://c.example/{i}", f"<body><div>Subscribe to us</div><div>story {i} goes on</div></body>") for i in range(15)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == got[2].text == "Title & more First a b cd <x> Last &am"
    assert got[3].text == "" and got[4].text == "Only text tail" and got[None].n_chars == 0
    assert all(got[100 + i].text == f"story {i} goes on" for i in range(15))  # the host's template text is gone


def slow_lines(texts, least=10):
    """Kept lines of each text: log groups, documents and recurrence by their definitions."""
    mask = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(line))
    lines = [[mask(x) for x in (t or "").split("\n")] for t in texts]
    good = lambda m: any(c.isalpha() for w in m if w != "<*>" for c in w)
    holders = collections.defaultdict(set)
    for t, ms in zip(texts, lines, strict=True):
        for m in ms:
            if good(m):
                holders[m].add(t)
    origin = []
    for t, ms in zip(texts, lines, strict=True):
        shared = [m for m in ms if good(m) and len(holders[m]) > 1]
        first = min((hashlib.md5(" ".join(m).encode()).hexdigest()[:8] for m in shared), default="")
        origin.append(("line", first) if shared and sum(map(len, shared)) >= 0.95 * sum(map(len, ms)) else ("text", t))
    docs, leaves, places = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(int)
    for o, ms in zip(origin, lines, strict=True):
        for m in ms:
            if good(m):
                docs[m].add(o)
                leaves[len(m), m[:3]].add(m)
    for (size, _), ms in leaves.items():
        for m in ms:
            for i in range(3, size):
                places[size, m[:3], i, m[i]] += len(docs[m])
    found = collections.defaultdict(set)

    def template(m):
        held = tuple((i, m[i]) for i in range(3, len(m)) if places[len(m), m[:3], i, m[i]] >= least)
        return (len(m), m[:3], held) if len(m) > 3 and len(held) >= 0.7 * (len(m) - 3) else m

    for m, o in docs.items():
        found[template(m)] |= o
    return ["\n".join(x for x, m in zip(t.split("\n"), ms, strict=True) if not (good(m) and len(found[template(m)]) >= least)) if t is not None else None for t, ms in zip(texts, lines, strict=True)]


def _name(i):
    return "".join(chr(97 + int(c)) for c in str(1000 + i))


def line_cases():
    """name -> (texts, whether the marked lines, those with "mark", go)."""
    own = lambda i: f"{_name(i)} {_name(i + 3000)} was here\n{_name(i + 5000)} went off to {_name(i + 7000)}"
    block = ["mark licence one two", "mark you may copy this freely", "mark no warranty at all", "mark end of licence"]
    rng = random.Random(4)
    near = "\n".join(f"mark {_text(rng, 9)}" for _ in range(12)).split("\n")
    return {
        "a block in many documents": ([own(i) + "\n" + "\n".join(block) + "\n" + own(i + 400) for i in range(20)], True),
        "a licence of most words": ([f"{_name(i)} " * (own_words - 1) + "end\n" + "\n".join(x + f" {x[5:]}" * 4 for x in block) for own_words in (5, 10, 40) for i in range(1000 * own_words, 1000 * own_words + 20)], True),
        "a chorus in one document": (["\n".join(f"{_name(i)}\nmark sing it again" for i in range(15)) + "\n" + own(20)], False),
        "too few documents": ([own(i) + "\nmark only nine of these" for i in range(9)], False),
        "copies": (["\n".join(near)] * 40, False),
        "near copies": (["\n".join(x if k != i % 12 else f"{_name(i)} {_name(i + 9000)}" for k, x in enumerate(near)) for i in range(40)], False),
        "two groups of a leaf": ([own(i) + f"\nmark a user {_name(i)} signed in from home with success\nmark a user {_name(i)} was denied by the second rule" for i in range(24)], True),
        "one opening": ([own(i) + f"\nmark said that {_name(i)} {_name(i + 50)} {_name(i + 90)}" for i in range(24)], False),
        "short lines": ([own(i) + "\nmark reserved." for i in range(12)], True),
        "numbers": ([own(i) + f"\nmark page {i} of {2 * i}" for i in range(12)], True),
        "rules": ([own(i) + "\n}\n7 - 9" for i in range(12)], False),
    }


def test_line_dedup_cases(spark):
    for name, (texts, gone) in line_cases().items():
        kept = [r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
        assert kept == slow_lines(texts), name
        assert [t.count("mark") for t in kept] == ([0] * len(texts) if gone else [t.count("mark") for t in texts]), name


def test_line_dedup(spark):
    import duckdb

    rng = random.Random(8)
    texts = [t for v, _ in line_cases().values() for t in v]
    texts += ["\n".join(f"The {rng.choice('abc')} of {rng.choice(['x', 'y'])} {'is' if rng.random() < 0.8 else 'was'} {rng.choice(['in', 'out', 'up'])} {rng.randrange(3)}" for _ in range(6)) for _ in range(60)]
    texts += [None, "", "short", "\r\n\t  é\x0b été  \n", "word " * 50000 + "\n" + "line\n" * 3000]
    rows = [(i, t, 5, 6, "h", "l") for i, t in enumerate(texts)] + [(None, texts[0], 5, 6, "h", "l"), (3, texts[3], 5, 6, "h", "l")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, line int, h string, leaf string"))
    assert set(out.columns) == {"doc_id", "text", "n_lines", "n_dropped", "line", "h", "leaf"}
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    want = slow_lines([r[1] for r in rows])
    assert [(i, t) for i, t, *_ in got] == sorted([(r[0], t) for r, t in zip(rows, want, strict=True)], key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert got == sorted([(r[0], r[3], r[1], r[2]) for r in con.sql(line_dedup.ORACLE).fetchall()], key=str)


def test_secret_scan(spark):
    key = "kJ8s0dQ2mZx7Vb4Lw9Tr1Yp6"
    texts = ["", f"auth header: Bearer {key} done", "password = hunter22 token: ab", 'API_KEY: "abc/def+12="', "AKIA" + "A1" * 8 + " AKIAshort", "é deadbeef" + "0123456789abcdef" * 2, "the secret is plain_identifier_name_long_name", None, "toKEN=secret=abcdef"]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].spans == f"novel:20:{20 + len(key)}" and got[1].n_novel == 1 and got[1].base_sha256 == got[0].base_sha256
    assert got[2].spans == "assign:0:19" and got[3].spans == "assign:0:21" and got[4].spans == "access:0:20"
    assert got[5].spans == "hex:2:42" and got[6].spans == "" and got[7].spans == "" and got[8].spans == "assign:0:19"


def slow_secrets(text, novelty):
    """Added spans by their definition: every maximal run, every cut at a sensitive word, every token."""
    base, taken = [(a, b) for a, _, b in secret_scan.base_spans(text, text.lower())], set()
    for a, b in base:
        taken |= set(range(a, b))
    good = re.compile(r"[A-Za-z0-9+/_=~.-]+")
    words = [m.span() for m in re.finditer("|".join(sorted(map(re.escape, secret_scan.CONTEXT), key=len, reverse=True)), text, re.ASCII | re.IGNORECASE)]
    inside, out = set(), []
    for a, b in words:
        inside |= set(range(a, b))
    for run in good.finditer(text):
        if run.end() - run.start() < 16:
            continue
        marks = [i for i in range(run.start(), run.end()) if i not in inside]
        pieces, at = [], run.start()
        for a, b in [*[w for w in words if run.start() <= w[0] < run.end()], (run.end(), run.end())]:
            pieces.append((at, a))
            at = b
        assert sum(max(0, b - a) for a, b in pieces) == len(marks)
        for a, b in pieces:
            before = [e for _, e in words if e <= a]
            if b - a < 16 or not before or a - before[-1] >= 64 or "\n" in text[before[-1] : a]:
                continue
            tokens = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^/_=~.-]+", text[a:b])]
            for groups in [[tokens]] + [[[t] for t in tokens]] * (len(tokens) > 1):
                hits = []
                for g in groups:
                    if not g:
                        continue
                    x, y = g[0][0], g[-1][1]
                    both = lambda t: any(c.isdigit() for c in t) and any(c.isalpha() for c in t)
                    camel = lambda t: t.isalpha() and len(t) == sum(map(len, h := re.findall(r"[A-Z][a-z]*|^[a-z]+", t))) and any(map(str.isupper, t)) and all(len(x) > 2 or x.islower() for x in h)
                    telling = sum(q - p for p, q in g if both(text[p:q]) or q - p >= 20 and not camel(text[p:q]))
                    if y - x >= 16 and 2 * telling > y - x and not taken & set(range(x, y)) and novelty.novel(text, x, y):
                        hits.append((x, 3, y))
                if hits:
                    out += hits
                    break
    return out


def test_secrets_match_brute_force():
    rng, novelty = random.Random(13), secret_scan.Novelty()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n=24: "".join(rng.choice(letters) for _ in range(n))
    parts = [lambda: rng.choice(secret_scan.CONTEXT), lambda: rng.choice("_/.-= :\n+"), key, lambda: key(40), lambda: "session_manager", lambda: "password = ", lambda: "the", lambda: "a" * 20, lambda: "é"]
    found = 0
    for _ in range(300):
        text = "".join(rng.choice(parts)() + rng.choice(["", "_", " ", "\n"]) for _ in range(rng.randrange(1, 14)))
        base, more = secret_scan.scan_text(text, novelty)
        assert more == sorted(slow_secrets(text, novelty)), text
        found += len(more)
    assert found > 50
    late = [secret_scan.scan_text(f"password_{key()}_token_session_manager_for_all_of_the_users_here", novelty)[1] for _ in range(100)]
    assert sum(map(bool, late)) >= 95
    alphabets = {"lower": letters[:26], "letters": letters[:52], "digits": letters[52:], "all": letters}
    for name, alphabet in alphabets.items():
        for context in ("export secret ", "`the password is `", "client_id: "):
            hits = 0
            for _ in range(100):
                secret = "".join(rng.choice(alphabet) for _ in range(24))
                base, more = secret_scan.scan_text(f"{context}{secret} and more", novelty)  # 24 digits are of the base kind hex
                hits += [(a, b) for a, _, b in base + more] == [(len(context), len(context) + 24)]
            assert hits >= 95, (name, context, hits)
    words = "site articles guide trip walk user profile settings account page view index contact product category review gallery".split()
    for name in ("_".join(rng.choice(words) for _ in range(4)) for _ in range(100)):
        camel = "".join(w.title() for w in name.split("_"))
        assert not secret_scan.scan_text(f"client_id: {name} token {camel} password 20240131120000", novelty)[1]
    slugs = [secret_scan.scan_text(f"see token https/site/articles/{rng.choice('abc')}-{rng.choice(['trip', 'walk'])}-{rng.randrange(2000, 2030)}-guide", novelty)[1] for _ in range(100)]
    assert not any(slugs)


def test_secret_scan_long_runs(spark):
    novelty, key = secret_scan.Novelty(), "q7Zk29fLmX0vB4tRw8YpN3sD"
    assert secret_scan.scan_text("client_id token_pwd_" + key, novelty)[1] == [(20, 3, 44)]
    assert secret_scan.scan_text("token " * 20000 + "client_id " + key, novelty)[1] == [(120010, 3, 120010 + len(key))]
    began = time.process_time()
    assert secret_scan.scan_text("pwd " + "token/" * 50000, novelty) == ([], [])
    assert secret_scan.scan_text("pwd " + "ab1/" * 200000, novelty)[1] == []
    assert time.process_time() - began < 10
    odd = spark.createDataFrame([(1, "x", "s")], "doc_id long, t string, spans string").withColumn("text", F.expr("cast(X'746f6b656e3d6162ff' as string)"))
    assert secret_scan.scan(odd).collect()[0].n_assign == 0 and simhash.near_groups(odd).count() == 1 and simhash.near_copies(odd).count() == 1


def slow_bits(texts, text):
    """Estimator C by the definition, one byte at a time."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(4)]
    joined = b"".join(language_id.START + t for t in texts)
    for o in range(4):
        for i in range(o, len(joined)):
            counts[o][joined[i - o : i]][joined[i]] += 1
    data, total = language_id.START + text, 0.0
    for i in range(3, len(data)):
        for o in (3, 2, 1, 0, -1):
            c = counts[o].get(data[i - o : i]) if o >= 0 else None
            if o < 0:
                total += 8
            elif c:
                t, d = sum(c.values()), len(c)
                if data[i] in c:
                    total -= np.log2(c[data[i]] / (t + d))
                    break
                total -= np.log2(d / (t + d))
    return total


def test_context_trees():
    texts = {"a": [b"abracadabra", "été".encode()], "b": [b"hello world", b""]}
    trees = language_id.ContextTrees(texts)
    probes = [b"abra", b"", b"world hello", "zété\n".encode(), b"a" * 50]
    data, at = np.frombuffer(b"".join(probes), np.uint8), np.cumsum([0, *map(len, probes)])
    for piece in (1 << 20, 7):
        got = trees.bits(data, at, piece)
        for i, p in enumerate(probes):
            assert got[i] == pytest.approx([slow_bits(texts[k], p) for k in "ab"], rel=1e-5, abs=1e-4)


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", None), (9003, "123 !?", "de"), (None, "the and of", None)], "doc_id long, text string, lang string")
    rows = language_id.identify(d.select("doc_id", "text", "lang").union(odd)).join(d.select(F.col("doc_id").alias("i"), "lang"), F.col("doc_id") == F.col("i"), "left").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and all(r.lang_pred == "und" for r in rows if r.doc_id in (9001, 9002, 9003))
    assert {r.lang_pred for r in language_id.identify(odd.filter("lang IS NULL")).collect()} == {"und"}


def test_mixing(frame, docs):
    rows = mixing.mix(frame).collect()
    size = collections.Counter()
    for _, t, _, s, *_ in docs:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # reshare until no target is above twice its source's size
        level = (1.5 * sum(size.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken in (0, r.size, 2 * r.size)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(frame).collect()))
    assert mixing.emit(frame).groupBy("doc_id").count().count() <= len({r.doc_id for r in rows if r.copies})
    _equal_to_sql(frame, mixing.mix(frame), mixing.ORACLE)


def test_mixing_without_ids(spark):
    d = spark.createDataFrame([(None, f"{i} " * 100, None, "a") for i in range(500)] + [(i, "x " * 100, None, "b") for i in range(500)], "doc_id long, text string, lang string, source string")
    for r in mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert 0.9 < r.taken / r.target < 1.1
    assert 300 < mixing.emit(d).filter("source = 'a'").select("text").distinct().count()


@pytest.mark.parametrize("run", [quality_rules.judge, suffix_dedup.dedup, simhash.near_groups, simhash.near_copies, packing.pack, line_dedup.dedup_lines, secret_scan.scan, language_id.identify, mixing.mix, mixing.emit])
def test_empty_tables(frame, run):
    assert run(frame.limit(0)).count() == 0


def test_suffix_dedup_leaves_out_parts_without_repeats():
    """Parts that share no half of a window around their minimiser are not sorted; all with a repeated window are."""
    import random

    from spanweave.llm import suffix_dedup

    rng = random.Random(7)
    k, length = suffix_dedup.K, 200
    core = rng.randbytes(k)
    common = rng.randbytes(500)
    own = lambda left, right: rng.randbytes(168 - left) + common[250 - left : 250] + core + common[250 : 250 + right] + rng.randbytes(168 - right)
    parts = [np.frombuffer(p, np.uint8) for p in (own(0, 0), own(168, 0), own(168, 0), own(40, 40), own(90, 90), own(0, 168), own(100, 20))]
    key = int(suffix_dedup.Hashes(np.frombuffer(core, np.uint8)).of(np.array([0]), np.array([k])).view(np.int64)[0])
    keep = suffix_dedup.candidates(parts, [key] * len(parts), length)
    assert not keep[0] and not keep[3]
    assert all(keep[i] for i, flags in enumerate(suffix_dedup.repeated_starts(parts, length)) if flags[: len(parts[i]) - length + 1].any())
    twice = [np.frombuffer(core + core + rng.randbytes(200), np.uint8), parts[0]]
    assert suffix_dedup.candidates(twice, [key, key], length).all()
