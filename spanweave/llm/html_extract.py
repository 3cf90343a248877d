"""Main text of web pages, by equivalence classes of tokens and the template that they nest into.

The tokens of a page are its elements (in their place: the chain of names and classes from the root) and its texts in their
place. Over the distinct pages of a host, tokens with equal vectors of occurrence counts form an equivalence class. A class is
valid if its tokens keep one order, round after round, on all pages, and if no other class's round begins inside one of its
rounds and ends outside. A class that is not falls apart: each of its elements is a class with its own end tag, and its texts
are none. Classes nest into the host's template: its elements are frames, and what lies in a frame outside of deeper frames
is a slot; texts of valid classes belong to the template and are no content.

Which slots are content is told by what they hold, summed over the pages of each of the host's layouts (pages with the same outer
frames): from the root down, a main element (article, main) is entered, or else the frame that has most of the text outside of
menus, links and the like, until none has. Frames of repeated blocks that follow the text are readers' remarks. A page's
text is what the slots in those frames hold on it.

Vectors are compared by a 64-bit sum of page hash times count, so a host's pages are never gathered, however many.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import strings
from .common import stage

# Attributes by the rules of HTML: quotes matter only after "=", and a quote that is never closed is part of a bare value.
_ATTRS = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+"""
_TOKEN = re.compile(rf"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)({_ATTRS})(?:>|\Z))", re.DOTALL)
_ATTR = re.compile(r"""([^\s/>=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+)""")
_DIGITS = re.compile(r"\d+")

#: Fixed lists of HTML: elements that hold no markup, that have no end tag, that do not break a line of text, that end an
#: open paragraph, and that frame others.
RAW = frozenset("script style textarea noscript template svg iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
FRAMES = frozenset("html body main article section div center table tbody tr td".split())
MAIN = frozenset(("article", "main"))
#: Elements, and whole values of class, id or role, that hold no main text.
ASIDE = frozenset("head title nav header footer aside form button select option dialog menu fieldset object".split())
ASIDE_VALUES = frozenset("""ad ads advert advertisement advertising adverts ad-container ad-slot adsbygoogle banner breadcrumb breadcrumbs comment
comments comment-list comments-area comment-section commentlist complementary contentinfo cookie cookies cookie-banner cookie-notice
consent footer header masthead menu menubar modal nav navbar navigation newsletter newsletter-signup notice notices overlay paywall popup
promo promoted promotion related related-posts replies share sharing share-buttons sidebar signup site-footer site-header skip-link
social social-links sponsor sponsored subscribe toolbar widget widgets""".split())


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed & ((1 << 64) - 1)) - (1 << 63)


def text_key(place: int, part: str) -> int:
    """The token of a text in its place."""
    return _hash(" ".join(part.split()), place + 1)


class Page:
    """One page's tokens and texts. With the template's frames, each text and each frame knows the frame that it lies in.

    tokens: (key, is_text) in order. texts: (block, frame, place, aside, in a link, below a main element, text).
    frames: for each frame on the page, (the frame around it, its element's name, aside, main).
    """

    def __init__(self, source: str, known: frozenset[int] | set[int] = frozenset(), keyed: bool = True):
        self.tokens: list[tuple[int, bool]] = []
        self.texts: list[tuple[int, int, int, bool, bool, bool, str]] = []
        self.frames: dict[int, tuple[int, str, bool, bool]] = {}
        # name, place, frame, aside, link, main: what an open element passes on to all in it
        stack: list[tuple[str, int, int, bool, bool, bool]] = [("", 0, 0, False, False, False)]
        opened: Counter[str] = Counter()
        block, at, n = 0, 0, len(source)

        def close(name: str) -> None:
            while True:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    return

        while at < n:
            m = _TOKEN.search(source, at)
            begin = m.start() if m else n
            if begin > at:
                part = source[at:begin]
                _, place, frame, aside, link, main = stack[-1]
                if keyed and not part.isspace():
                    self.tokens.append((text_key(place, part), True))
                self.texts.append((block, frame, place, aside, link, main, part))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if name not in INLINE:
                block += 1
            if m[1]:
                if opened[name]:
                    close(name)
                continue
            attrs = m[3]
            if name in ENDS_P and opened["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close("p")
                        break
                    if stack[k][0] not in INLINE:
                        break
            if name in ENDS_SAME and opened[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close(name)
                        break
                    if stack[k][0] in ENDS_SAME[name]:
                        break
            values: list[str] = []
            label, role = name, ""
            if "=" in attrs:
                seen: set[str] = set()
                for k, v in _ATTR.findall(attrs):
                    k = k.lower()
                    if k in ("class", "id", "role") and k not in seen:
                        seen.add(k)
                        own = v.strip("\"'").lower().split()
                        values += own
                        if k == "class":
                            label += "." + _DIGITS.sub("0", " ".join(own))
                        elif k == "role":
                            role = " ".join(own)
            _, place, frame, aside, link, inside = stack[-1]
            place = _hash(label, place)
            if keyed:
                self.tokens.append((place, False))
            main = name in MAIN or role in ("main", "article")
            aside = aside or not main and name not in ("html", "body") and (name in ASIDE or any(v in ASIDE_VALUES for v in values))
            if place in known:
                self.frames.setdefault(place, (frame, name, aside, main))
                frame = place
            if name in RAW:
                if not attrs.endswith("/") or name not in ("svg", "template"):
                    end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, at)
                    at = n if end is None else source.find(">", end.end()) + 1 or n
            elif name not in VOID and not attrs.endswith("/"):
                stack.append((name, place, frame, aside, link or name == "a", inside or main))
                opened[name] += 1


def page_tokens(source: str) -> dict[int, tuple[int, bool]]:
    """Each token of a page: its count, and whether it is a text."""
    out: dict[int, tuple[int, bool]] = {}
    for key, is_text in Page(source).tokens:
        out[key] = (out.get(key, (0, is_text))[0] + 1, is_text)
    return out


def class_orders(tokens: list[int], classes: dict[int, int]) -> dict[int, tuple[int, bool]]:
    """For each class on a page: a hash of its tokens' order in a round (0 if rounds differ), and whether its rounds nest.

    Rounds are held against each other by a stack: a class's next token must find its own open round on top. What lies open
    above it began inside and did not end there, so those classes overlap with it.
    """
    by: dict[int, list[int]] = {}
    for t in tokens:
        if (c := classes.get(t)) is not None:
            by.setdefault(c, []).append(t)
    rounds, out = {}, {}
    for c, seq in by.items():
        first = list(dict.fromkeys(seq))
        same = len(seq) % len(first) == 0 and seq == first * (len(seq) // len(first))
        rounds[c] = first if same else None
        out[c] = (_hash(",".join(map(str, first))) if same else 0, True)
    stack: list[list[int]] = []  # class, tokens of the round seen so far
    open_: Counter[int] = Counter()
    for t in tokens:
        c = classes.get(t)
        if c is None or rounds[c] is None or len(rounds[c]) == 1:
            continue
        if t == rounds[c][0]:
            stack.append([c, 1])
            open_[c] += 1
            continue
        while open_[c] and stack[-1][0] != c:
            broken = stack.pop()[0]
            open_[broken] -= 1
            out[broken] = (out[broken][0], False)
        if open_[c]:
            stack[-1][1] += 1
            if stack[-1][1] == len(rounds[c]):
                stack.pop()
                open_[c] -= 1
    return out


Facts = dict[int, tuple[int, str, bool, bool, int, int, int, bool]]


def layout_of(frames: dict[int, tuple[int, str, bool, bool]], times: Counter[int], depth: int = 4) -> int:
    """A page's layout: a hash of its outer frames, those that occur once on it and lie at most depth frames below its root."""
    deep, outer = {0: 0}, []
    for key, (up, name, aside, _) in frames.items():  # a frame comes after the one around it
        deep[key] = deep[up] + 1
        if deep[key] <= depth and not aside and times[key] == 1 and name in FRAMES:
            outer.append(key)
    return _hash(",".join(map(str, sorted(outer))))


def _below(frames: Facts) -> dict[int, list[int]]:
    below: dict[int, list[int]] = {}
    for key, f in frames.items():
        if key:
            below.setdefault(f[0], []).append(key)
    return below


def content_top(frames: Facts, most: float = 0.6, main_most: float = 0.2, share: float = 0.1, remarks: float = 0.5) -> tuple[int, set[int]]:
    """frames: key -> (parent, name, aside, main, most on one page, mass of its own slot, place on a page, slot differs by page).
    The key of the frame that holds the content, and the frames in it that hold none.

    From the root (key 0), the heaviest child frame that is or leads to a main element is entered, if it holds main_most of the
    mass; else the one that holds at least `most` of it. Of frames that hold a share, those of which more than `remarks` lies in
    blocks that repeat on a page are readers' remarks if they follow one whose text is not in such blocks; they go. A frame that
    has most is not entered past another one before it that holds a share of text which differs by page: both are content then, and
    their neighbours of less than a share are none. Frames that repeat on a page, and what is no frame by its name, are not entered.
    """
    below = _below(frames)
    order, i = [0], 0
    while i < len(order):
        order += below.get(order[i], [])
        i += 1
    mass: dict[int, int] = {}
    again: dict[int, int] = {}
    leads: dict[int, bool] = {}
    varies: dict[int, bool] = {}
    for key in reversed(order):
        own = frames.get(key, (0, "", False, False, 1, 0, 0, False))
        kids = [k for k in below.get(key, []) if not frames[k][2]]
        mass[key] = own[5] + sum(mass[k] for k in kids)
        again[key] = mass[key] if own[4] > 1 and (own[1] in FRAMES or own[1] in ENDS_SAME) else sum(again[k] for k in kids)
        leads[key] = own[3] and own[4] == 1 or any(leads[k] for k in kids)
        varies[key] = own[7] or any(varies[k] for k in kids)
    at, gone = 0, set()
    while True:
        inside = at and frames[at][3]
        kids = [k for k in below.get(at, []) if not frames[k][2] and frames[k][4] == 1 and frames[k][1] in FRAMES]
        if inside:  # a main element is left only for another one in it
            kids = [k for k in kids if leads[k]]
        kids.sort(key=lambda k: (-mass[k], k))
        if not kids or not mass[at] or not mass[kids[0]]:
            break
        to = next((k for k in kids if not inside and leads[k] and mass[k] >= main_most * mass[at]), None)
        if to is None:
            large = [k for k in kids if mass[k] >= share * mass[at] and varies[k]]
            told = [frames[k][6] for k in large if again[k] <= remarks * mass[k]]
            said = set() if inside or not told else {k for k in large if again[k] > remarks * mass[k] and frames[k][6] > min(told)}
            gone |= said
            rest, kids = mass[at] - sum(mass[k] for k in said), [k for k in kids if k not in said]
            if mass[kids[0]] >= most * rest:
                before = [] if inside else [k for k in large if k not in said and k != kids[0] and frames[k][6] < frames[kids[0]][6]]
                if before:
                    gone |= {k for k in kids if mass[k] < share * rest}
                else:
                    to = kids[0]
        if to is None:
            break
        at = to
    return at, gone


def content_frames(frames: Facts, layouts: list[Facts]) -> list[int]:
    """The keys of the frames that hold content: for each layout its content's frame, with all frames of the host in it but
    those that hold none; for the host as a whole if no layout is given."""
    below, out = _below(frames), set()
    for facts in layouts or [frames]:
        at, gone = content_top(facts)
        inside, i = [at], 0
        while i < len(inside):
            inside += [k for k in below.get(inside[i], []) if not frames[k][2] and k not in gone]
            i += 1
        out |= set(inside)
    return sorted(out)


def templates(pages: DataFrame, min_pages: int = 10, least: float = 0.1, text_least: float = 0.8, min_layout: int = 5) -> DataFrame:
    """pages(host, html) -> host, frames, content, texts: the template's elements, those that hold content, its texts.

    Tokens on `least` of the host's distinct pages take part (so a host has at most 1 / least times the tokens of a page);
    texts only on text_least of at least min_pages pages, and in a class with another token. Each step aggregates rows of
    (host, token), (host, class) or (host, layout, frame) with partial aggregation. A layout of at least min_layout pages and
    `least` of the host's has a content of its own (so a host has at most 1 / least of them); a host's last row is no longer than
    its template times these.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for h, s in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
                page = _hash(s)
                for token, (n, is_text) in page_tokens(s).items():
                    for c, v in zip(cols, (h, page, token, n, is_text), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["host", "page", "token", "n", "is_text"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(12))
            for h, s, known in zip(strings(batch.column(0)), strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                classes = {x["token"]: x["vector"] for x in known}
                page = Page(s, {x["token"] for x in known if not x["is_text"]})
                texts = {x["token"] for x in known if x["is_text"]}
                for c, (seen, nested) in class_orders([t for t, _ in page.tokens], classes).items():
                    for col, v in zip(cols, (h, 0, c, None, seen if nested else None, nested and seen != 0, None, None, None, None, None, None), strict=True):
                        col.append(v)
                own: Counter[int] = Counter()
                slot: dict[int, int] = {}
                for _, frame, place, aside, link, _, part in page.texts:
                    if not aside and not link and not part.isspace() and text_key(place, part) not in texts:
                        own[frame] += len("".join(part.split()))
                        slot[frame] = _hash(part, slot.get(frame, 0))
                times = Counter(t for t, _ in page.tokens)
                layout = layout_of(page.frames, times)
                for at, (key, (up, name, aside, main)) in enumerate([(0, (0, "", False, False)), *page.frames.items()]):
                    for col, v in zip(cols, (h, layout, None, key, slot.get(key, 0), None, up, name, (1 if aside else 0) + (2 if main else 0), times[key] if key else 1, own[key], at), strict=True):
                        col.append(v)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "layout", "vector", "token", "seen", "fits", "up", "name", "kind", "n", "mass", "at"])

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, frames, contents = batch.column(0), [], []
            for rows in batch.column(1).to_pylist():
                by: dict[int | None, Facts] = {None: {}}  # the whole host, and its layouts
                for r in rows:
                    by.setdefault(r["layout"], {})[r["token"]] = (r["up"], r["name"], bool(r["kind"] & 1), bool(r["kind"] & 2), r["n"], r["mass"], r["at"], r["low"] != r["high"])
                frames.append(sorted(k for k in by[None] if k))
                contents.append(content_frames(by.pop(None), [by[k] for k in sorted(by)]))
            yield pa.record_batch([hosts, pa.array(frames, pa.list_(pa.int64())), pa.array(contents, pa.list_(pa.int64())), batch.column(2)], names=["host", "frames", "content", "texts"])

    rows = pages.select("host", F.coalesce("html", F.lit("")).alias("html"))
    once = rows.mapInArrow(count, "host string, page long, token long, n int, is_text boolean").groupBy("host", "token", "page").agg(F.max("n").alias("n"), F.first("is_text").alias("is_text"))
    vector = F.xxhash64(F.sum(F.xxhash64("page").cast("decimal(38,0)") * F.col("n")))
    tokens = once.groupBy("host", "token").agg(F.count("*").alias("pages"), vector.alias("vector"), F.first("is_text").alias("is_text"))
    tokens = stage(tokens.filter(~F.col("is_text") | (F.col("pages") >= min_pages)), "tokens")
    most = tokens.filter("NOT is_text").groupBy("host").agg(F.max("pages").alias("most"))
    kept = tokens.join(most, "host").filter(F.col("pages") >= F.when(F.col("is_text"), text_least).otherwise(least) * F.col("most"))
    sizes = kept.groupBy("host", "vector").agg(F.count("*").alias("size"))
    kept = stage(kept.join(sizes, ["host", "vector"]).filter("NOT is_text OR size > 1").select("host", "token", "vector", "is_text"), "classes")
    known = stage(kept.groupBy("host").agg(F.collect_list(F.struct("token", "vector", "is_text")).alias("known")), "known")
    known = known.withColumnRenamed("host", "__host")
    facts = rows.join(known, rows["host"] == known["__host"], "left").select("host", "html", F.coalesce("known", F.array().cast(known.schema["known"].dataType)).alias("known"))
    merged = {"low": F.min, "high": F.max, "fits": F.min, "up": F.first, "name": F.first, "kind": F.first, "n": F.max, "mass": F.sum, "at": F.min, "pages": F.sum}
    each = facts.mapInArrow(order, "host string, layout long, vector long, token long, seen long, fits boolean, up long, name string, kind int, n int, mass long, at int")
    each = each.select("*", F.col("seen").alias("low"), F.col("seen").alias("high"), F.lit(1).alias("pages"))
    facts = stage(each.groupBy("host", "layout", "vector", "token").agg(*[f(c).alias(c) for c, f in merged.items()]), "facts")
    valid = facts.filter("vector IS NOT NULL AND fits AND low = high").select("host", "vector")
    texts = kept.filter("is_text").join(valid, ["host", "vector"], "left_semi").groupBy("host").agg(F.collect_list("token").alias("texts"))
    found = facts.filter("token IS NOT NULL")
    roots = found.filter("token = 0").select("host", "layout", "pages")
    large = roots.join(roots.groupBy("host").agg(F.sum("pages").alias("every")), "host").filter((F.col("pages") >= min_layout) & (F.col("pages") >= least * F.col("every")))
    whole = found.groupBy("host", "token").agg(*[f(c).alias(c) for c, f in merged.items()]).withColumn("layout", F.lit(None).cast("long"))
    rows = found.join(large.select("host", "layout"), ["host", "layout"], "left_semi").unionByName(whole, allowMissingColumns=True)
    frames = rows.groupBy("host").agg(F.collect_list(F.struct("layout", "token", "up", "name", "kind", "n", "mass", "at", "low", "high")).alias("rows"))
    return frames.join(texts, "host", "left").select("host", "rows", "texts").mapInArrow(nest, "host string, frames array<long>, content array<long>, texts array<long>")


def main_text(source: str, frames: set[int], content: set[int], texts: set[int]) -> str:
    """What the content's slots hold on a page. A page without the content's frame is read by its main elements, or else whole,
    less asides; without content frames there is no text."""
    if not content:
        return ""
    page = Page(source, frames, keyed=False)
    parts: dict[int, list[str]] = {}
    fits = 0 in content or any(k in content for k in page.frames)
    has_main = not fits and any(t[5] for t in page.texts)
    for block, frame, place, aside, _, main, part in page.texts:
        if not aside and (frame in content if fits else main or not has_main) and (not texts or part.isspace() or text_key(place, part) not in texts):
            parts.setdefault(block, []).append(part)
    rows = (" ".join(_html.unescape("".join(v)).split()) for _, v in sorted(parts.items()))
    return " ".join(r for r in rows if r)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 10) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points), template_texts (how many texts the host's template has).

    Nulls: a null html is empty; a page whose url is null or names no host is a host of its own; ids are only carried.
    Repeated pages repeat, and count once for the template's classes. Text is decoded once; white space in a block (any
    Unicode white space, after decoding) becomes one space; blocks are joined by one space. Markup cut off at the end of a
    page is markup. Empty input gives no rows. Further columns are not read. Only template tables are joined, by host; they
    are read from a table whose true size decides the strategy.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(pages[url_col], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    alone = F.concat(F.lit("/"), F.hex(F.xxhash64(pages[html_col])))
    p = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.when(F.length(host) > 0, host).otherwise(alone).alias("host"), pages[html_col].alias("html"))
    found = stage(templates(p, min_pages), "templates").withColumnRenamed("host", "__host")
    p = p.join(found, p["host"] == found["__host"], "left").select("page_id", "url", "html", "frames", "content", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for s, *known in zip(strings(batch.column(2)), *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                frames, content, texts = (set(k or ()) for k in known)
                sizes.append(len(texts))
                out.append(main_text(s or "", frames, content, texts))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars", "template_texts"])

    return p.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, template_texts long")
