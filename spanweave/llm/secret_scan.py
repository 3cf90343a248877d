"""Secret scanning: patterns for known kinds, and zstandard novelty for strings of no known kind.

In a sensitive context, a candidate string is measured by its marginal compressed size: what it adds to the compressed size
of the code around it, with a compressor primed by a dictionary of common identifiers. Names, paths and words repeat what the
dictionary or the surroundings hold and cost few bytes; keys cost nearly their whole length and are reported.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .arrow import strings

#: Fixed patterns of the base kinds, in the order of ties.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: What makes a context sensitive, and the identifiers that prime the compressor.
CONTEXT = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "authorization", "private_key", "access_key", "auth_key", "signing", "client_id", "encryption")
IDENTIFIERS = """
abstract access account action address admin algorithm allow android anonymous api app application argument array assert
async attribute auth authorization await backend background base64 basic bearer begin boolean branch broker browser bucket
buffer build bundle button byte cache callback catch certificate channel char charset child class client clone cloud cluster
code column command commit common component compress config configuration connect connection const constant constructor
container content context controller cookie copy core count create credential currency current cursor custom data database
date debug decode default define delete deploy description destination development device dictionary directory disable
display document domain double download driver element email enable encode encrypt endpoint engine enum environment error
event example except exception execute export extends false field file filter final finally find float folder format
function gateway generate get global google group handle handler hash header hidden host html http https identifier image
implements import include index init input insert instance int integer interface internal json kernel key label lambda
language layout length level library license limit link list listener load local localhost log logger login long main
manager map master max message meta method min mode model module name namespace network node null number object offset
option order output package page param parameter parent parse passphrase password path pattern payload permission placeholder
port post prefix print private process production profile project property protected provider proxy public query queue
read receive record redirect reference refresh region register release remote remove render replace request require reset
resource response result return role root route row rule runtime sample scope script search secret security select self
send sequence server service session set settings setup sha256 sign signature size source space sql ssh staging start
state static status storage store stream string struct style submit success super switch system table tag target task
template temp test text this thread throw time timeout timestamp title token trace transaction transform true try type
undefined unit update upload url user username utf-8 util value variable vendor version view void volume wait warning web
webhook while width window worker write xml yaml your_api_key_here your-secret-here changeme example.com www.
"""
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+]+")
_MIXED = re.compile(r"[0-9]\+*[A-Za-z]|[A-Za-z]\+*[0-9]")
_CAMEL = re.compile(r"[a-z]*(?:[A-Z][a-z]{2,})+")
_CONTEXT = re.compile("|".join(map(re.escape, sorted(CONTEXT, key=len, reverse=True))), re.ASCII | re.IGNORECASE)


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base kinds, leftmost and non-overlapping for each kind, failing ones dropped."""
    found = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed bytes of candidates in sensitive contexts.

    A run of candidate characters is cut at the sensitive words in it. A piece that a sensitive word precedes on its line
    within `reach` characters is judged once as a whole, less separators at its ends, and if it fails, each of its tokens
    between separators once. So every character is compressed at most twice as part of a candidate, however long its run is.

    Prose has words of one class of characters that no dictionary holds and that cost as much as keys: letters up to a word's
    length, digits up to a number's. So tokens of letters alone or digits alone count from `plain` characters on, those that
    mix both from any length; letters in camel case are words, each of which is a token.
    """

    def __init__(self, least: float = 0.7, reach: int = 64, around: int = 256, shortest: int = 16, plain: int = 20):
        primer = zstandard.ZstdCompressionDict(" ".join(IDENTIFIERS.split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.size = zstandard.ZstdCompressor(level=9, dict_data=primer, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.least, self.reach, self.around, self.shortest, self.plain = least, reach, around, shortest, plain

    def spans(self, text: str, low: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Added spans: pieces, or tokens of them, of `shortest` characters or more that no base span touches, most of which
        are tokens that count, and whose marginal cost is at least `least` bytes a character."""
        if not any(w in low for w in CONTEXT):
            return []
        words = [m.span() for m in _CONTEXT.finditer(text)]
        ends, starts = [e for _, e in words], [s for s, _ in words]
        taken = _disjoint(base)
        found: list[tuple[int, int, int]] = []
        for run in CANDIDATE.finditer(text):
            lo = run.start()
            for k in range(bisect_left(starts, lo), bisect_left(starts, run.end()) + 1):
                hi = min(words[k][0], run.end()) if k < len(words) else run.end()
                last = bisect_right(ends, lo) - 1
                if hi - lo >= self.shortest and last >= 0 and lo < ends[last] + self.reach and "\n" not in text[ends[last] : lo]:
                    found += self.pieces(text, lo, hi, taken)
                lo = words[k][1] if k < len(words) else hi
        return found

    def pieces(self, text: str, lo: int, hi: int, taken: tuple[list[int], list[int]]) -> list[tuple[int, int, int]]:
        tokens = [(lo + m.start(), lo + m.end()) for m in _TOKEN.finditer(text[lo:hi])]
        if not tokens:
            return []
        for part in ([tokens], [[t] for t in tokens if len(tokens) > 1]):
            hit = []
            for group in part:
                a, b = group[0][0], group[-1][1]
                i = bisect_left(taken[0], b) - 1
                free = i < 0 or taken[1][i] <= a
                telling = sum(y - x for x, y in group if self.counts(text, x, y))
                if free and b - a >= self.shortest and 2 * telling > b - a and self.novel(text, a, b):
                    hit.append((a, 3, b))
            if hit:
                return hit
        return []

    def counts(self, text: str, start: int, end: int) -> bool:
        """Whether a token is one that prose doesn't have: mixed of letters and digits, or long and not in camel case."""
        return bool(_MIXED.search(text, start, end)) or end - start >= self.plain and not _CAMEL.fullmatch(text, start, end)

    def novel(self, text: str, start: int, end: int) -> bool:
        before, after = text[max(0, start - self.around) : start], text[end : end + self.around]
        bare, full = (before + after).encode(), (before + text[start:end] + after).encode()
        return len(self.size.compress(full)) - len(self.size.compress(bare)) >= self.least * (end - start)


def _disjoint(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of (start, place, end)."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in sorted(spans):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def scan_text(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text, each (start, place of the kind, end) in code points, sorted."""
    low = text.lower()
    base = sorted(base_spans(text, low))
    return base, sorted(novelty.spans(text, low, base))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    spans lists kind:start:end of every span by start, then kind, comma-joined; base_sha256 digests those of base kinds. Novel
    spans follow a sensitive word on its line, within 64 characters; of letters alone or digits alone, they have 20 or more.
    A null text is read as empty; ids are only carried; repeated rows repeat; empty input gives no rows. Further columns
    are not read. Texts are scanned whole, one at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(least)
        for batch in batches:
            counts, digests, spans = ([], [], [], []), [], []
            for t in strings(batch.column(1)):
                base, more = scan_text(t or "", novelty)
                for k in range(3):
                    counts[k].append(sum(1 for x in base if x[1] == k))
                counts[3].append(len(more))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(sorted(base + more)))
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=names)

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
