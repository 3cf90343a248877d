"""Template deduction against a brute-force version, and extraction from odd pages."""

import collections
import html.parser
import random
import time

import pytest
from pyspark.sql import functions as F

from spanweave.llm import html_extract

SCHEMA = "page_id long, url string, html string, text string, n_chars string, host string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", "n", "h") for i, u, h in rows], SCHEMA)


def texts(spark, rows, **more):
    return {r.page_id: r.text for r in html_extract.extract(frame(spark, rows), **more).collect()}


class Tokens(html.parser.HTMLParser):
    """Elements and texts with the chain of elements that they are in, of well-formed pages."""

    def __init__(self, source):
        super().__init__()
        self.chain, self.seen = (), []
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.chain += (tag + "".join("." + v for k, v in attrs if k == "class"),)
        self.seen.append(("element", self.chain))

    def handle_endtag(self, tag):
        self.chain = self.chain[:-1]

    def handle_data(self, data):
        if data.strip():
            self.seen.append((" ".join(data.split()), self.chain))


def brute_template(pages, min_pages=10, least=0.1, text_least=0.8):
    """(valid elements, valid texts) of one host's pages, by whole vectors and by every pair of tokens."""
    pages = [Tokens(p).seen for p in sorted(set(pages))]
    vectors = {t: tuple(p.count(t) for p in pages) for p in pages for t in p}
    on = {t: sum(map(bool, v)) for t, v in vectors.items()}
    most = max(n for t, n in on.items() if t[0] == "element")
    kept = {t for t in vectors if (on[t] >= least * most if t[0] == "element" else on[t] >= max(min_pages, text_least * most))}
    classes = collections.defaultdict(set)
    for t in kept:
        classes[vectors[t]].add(t)
    good = {}
    for v, members in classes.items():
        orders, nested = set(), True
        for p in pages:
            seq = [t for t in p if t in members]
            if not seq:
                continue
            first = list(dict.fromkeys(seq))
            orders.add(tuple(first) if seq == first * (len(seq) // len(first)) else None)
        good[v] = len(orders) == 1 and None not in orders and nested
    for p in pages:  # rounds as (class, places)
        rounds = []
        for v, members in classes.items():
            at = [i for i, t in enumerate(p) if t in members]
            rounds += [(v, at[i : i + len(members)]) for i in range(0, len(at), len(members))]
        for v, at in rounds:
            for w, other in rounds:
                if w != v and good[w] is not None and other[0] < at[0] and any(at[0] < x < at[-1] for x in other):
                    good[v] = False
    elements = {t for t in kept if t[0] == "element"}
    return elements, {t for t in kept if t[0] != "element" and good[vectors[t]] and len(classes[vectors[t]]) > 1}


def page(rng, i, swap=False):
    body = "".join(f"<p>{rng.choice(['once', 'again', 'story'])} {i} {rng.random()}</p>" for _ in range(rng.randrange(1, 5)))
    items = "".join(f"<li><a>{rng.choice('xyz')}{i}</a></li>" for _ in range(rng.randrange(1, 4)))
    blocks = ["<div class='one'>Read more</div>", "<div class='two'>Sign in</div>"]
    return f"<html><body><ul class='links'>{items}</ul><div class='text'><h1>T {i}</h1>{body}<div class='note'>Share this story</div></div>{''.join(blocks[::-1] if swap else blocks)}</body></html>"


@pytest.mark.parametrize("swaps", [0, 3])
def test_templates_match_brute_force(spark, swaps):
    rng = random.Random(21 + swaps)
    pages = [page(rng, i, i < swaps) for i in range(14)]
    pages += pages[:2]
    elements, static = brute_template(pages)
    rows = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = html_extract.templates(rows).collect()[0]
    place = lambda chain: 0 if not chain else html_extract._hash(chain[-1], place(chain[:-1]))
    assert set(got.frames) == {place(chain) for _, chain in elements}
    assert set(got.texts or ()) == {html_extract.text_key(place(chain), t) for t, chain in static}
    assert bool(swaps) != bool(static)  # tokens that change places make no class
    content = texts(spark, [(i, "http://h/", p) for i, p in enumerate(pages)])
    for i, p in enumerate(pages):
        seen = [t for t, chain in Tokens(p).seen if "div.text" in chain and t != "element" and (t, chain) not in static]
        assert content[i] == " ".join(seen)


def test_the_template_decides(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "http://h/", page(rng, i)) for i in range(12)]
    assert all(texts(spark, rows).values())
    none = lambda pages, *_: pages.select("host", *[F.array().cast("array<long>").alias(c) for c in ("frames", "content", "texts")]).distinct()
    monkeypatch.setattr(html_extract, "templates", none)
    assert not any(texts(spark, rows).values())


def test_odd_markup(spark):
    cases = {
        "<article><p>it</p><p data-x=don't>body</p><p>it's</p></article>": "it body it's",
        '<p class="x>Hello world</p>': "Hello world",
        '<article><p>a</p><section class="search-results-analysis">b</section><div id="social-science">c</div></article>': "a b c",
        "<article>a<svg/>b<script>x</script><style>y</style><textarea>z</textarea>c<br>d</article>": "a b c d",
        "a < b &lt;i&gt; &amp;amp; &#233;<p": "a < b <i> &amp; é",
        "</div></p>plain<b>er</b> text": "plainer text",
        "<ul><li>one<li>two<ul><li>three</ul></ul>": "one two three",
        "<main><nav>m</nav><p>x<div class='ad'>no</div>y</main><footer>f</footer>": "x y",
        "<!-- open": "", "": "", "   ": "",
    }
    got = texts(spark, [(i, None, h) for i, h in enumerate(cases)] + [(99, "http://x/", None)])
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == ""


def test_long_and_deep_pages():
    began = time.process_time()
    page = html_extract.Page("<div>" * 20000 + "x" + "</div>" * 20000 + "<p>" * 20000 + "</span>" * 20000 + "<p>" + "<b>" * 20000)
    assert len(page.texts) == 1
    assert html_extract.Page("word " * 400000 + "<a b='" * 2000).texts
    assert time.process_time() - began < 20


def test_bytes_that_are_no_text(spark):
    rows = frame(spark, [(1, "http://x/", "")]).withColumn("html", F.expr("cast(X'3c703e61ff623c2f703e' as string)"))
    assert html_extract.extract(rows).collect()[0].text == "a�b"


def test_empty_table(spark):
    assert html_extract.extract(frame(spark, [(1, None, None)]).limit(0)).count() == 0


def _words(rng, n):
    return " ".join(rng.choice("amber brook cedar dune ember fjord grove heath islet knoll".split()) + str(rng.randrange(1000)) for _ in range(n))


@pytest.mark.parametrize("remark", ["<div class='r'><b>someone</b><p>{}</p></div>", "<p>{}</p>"])
def test_remarks_longer_than_the_article(spark, remark):
    rng, rows, bodies, said = random.Random(8), [], [], []
    for i in range(14):
        body, talk = _words(rng, 30), [_words(rng, 20) for _ in range(3)]
        bodies.append(body)
        said.append(talk)
        talk = "".join(remark.format(t) for t in talk)
        rows.append((i, "http://h/", f"<html><body><div class='top'>Site name</div><div class='a'><h1>{body[:10]}</h1><p>{body}</p></div><div class='b'>{talk}</div></body></html>"))
    got = texts(spark, rows)
    for i, (body, talk) in enumerate(zip(bodies, said, strict=True)):
        # what repeats in blocks goes; remarks that look like an article's paragraphs can't be told from it, but never replace it
        assert got[i] == " ".join([body[:10], body, *(talk if "div" not in remark else [])])


@pytest.mark.parametrize("element", ["article", "main"])
def test_a_short_main_element_wins(spark, element):
    rng = random.Random(9)
    bodies = [_words(rng, 30) for _ in range(12)]
    rows = [(i, "http://h/", f"<body><{element}><p>{b}</p></{element}><div class='b'><p>{_words(rng, 60)}</p></div></body>") for i, b in enumerate(bodies)]
    assert texts(spark, rows) == dict(enumerate(bodies))


def test_two_layouts_of_a_host(spark):
    rng, rows, want = random.Random(10), [], []
    for i in range(20):
        want.append(_words(rng, 50))
        one = f"<div class='page'><div class='rail'><p>All about us and our work</p></div><div class='text'><p>{want[-1]}</p></div></div>"
        two = f"<table><tr><td class='rail'><p>Where to find the other things of this site and more</p></td><td class='body'><p>{want[-1]}</p></td></tr></table>"
        rows.append((i, "http://h/", f"<html><body>{one if i < 13 else two}</body></html>"))
    assert texts(spark, rows) == dict(enumerate(want))


def test_frames_of_few_pages_stay_in_the_article(spark):
    rng, rows, want = random.Random(11), [], []
    for i in range(40):
        body, more = _words(rng, 40), _words(rng, 8) if i % 9 == 0 else ""
        want.append(f"{body} {more}".strip())
        rows.append((i, "http://h/", f"<body><div class='side'><a href='x'>{_words(rng, 3)}</a></div><div class='text'><p>{body}</p>{f'<div class=box>{more}</div>' if more else ''}</div></body>"))
    assert texts(spark, rows) == dict(enumerate(want))
