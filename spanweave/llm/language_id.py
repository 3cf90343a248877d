"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order (0 to 3) with the escape estimator C, fitted on a bounded sample of
labelled rows and then frozen. A text's code length under a language is the sum over its bytes of -log2 P(byte | the longest
context that the tree holds), escapes included; the language with the shortest code wins. As the statistics are frozen, the
code length of each (context, byte) is computed once, and a text's exact code length is a sum of table lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import utf8

ORDER = 3
#: A text is preceded by this context, in training and in scoring.
START = b"\n" * ORDER


class ContextTrees:
    """The frozen code lengths of all languages.

    Bytes that no training text has behave alike (they escape to the uniform order -1) and share one class. Rows are
    contexts: all pairs of classes first, then the triples seen in training; `longest` maps a triple to its row, or to the
    row of its last two bytes.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        joined = {k: np.frombuffer(b"".join(START + t for t in texts[k]), np.uint8) for k in self.langs}
        seen = np.unique(np.concatenate([np.frombuffer(START, np.uint8), *joined.values()]))
        self.n = n = len(seen) + 1
        self.classes = np.full(256, n - 1, np.int32)
        self.classes[seen] = np.arange(n - 1)
        grams = {k: [_counts(self.classes[v], o, n) for o in range(ORDER + 1)] for k, v in joined.items()}
        triples = np.unique(np.concatenate([g[3][0] // n for g in grams.values()])) if grams else np.zeros(0, np.int64)
        a = np.arange(n)
        self.longest = (a[:, None] * n + a).ravel().astype(np.int32)  # of the last two classes
        self.longest = np.tile(self.longest, n)
        self.longest[triples] = n * n + np.arange(len(triples), dtype=np.int32)
        self.costs = [self._fit(grams[k], triples) for k in self.langs]

    def _fit(self, grams: list[tuple[np.ndarray, np.ndarray]], triples: np.ndarray) -> np.ndarray:
        n = self.n
        cost = _order(np.full((1, n), 8.0), np.zeros(1, np.int64), *grams[0], n)
        cost = _order(np.tile(cost, (n, 1)), np.arange(n), *grams[1], n)
        cost = _order(np.tile(cost, (n, 1)), np.arange(n * n), *grams[2], n)
        more = _order(cost[triples % (n * n)], triples, *grams[3], n)
        return np.concatenate([cost, more]).astype(np.float32).ravel()

    def bits(self, data: np.ndarray, at: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
        """(texts, languages): exact code lengths of the texts data[at[i]:at[i + 1]], in pieces of bounded size."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        i, lo = 0, 0
        while i < len(at) - 1:
            parts, owner, size = [], [], 0
            while i < len(at) - 1 and size < piece:
                hi = min(at[i + 1], at[i] + lo + piece - size)
                begin = at[i] + lo
                lead = np.concatenate([np.frombuffer(START, np.uint8), data[at[i] : begin]])[-ORDER:] if lo < ORDER else data[begin - ORDER : begin]
                if hi > begin:
                    parts.append(np.concatenate([lead, data[begin:hi]]))
                    owner.append(i)
                    size += hi - begin
                lo = hi - at[i]
                if hi == at[i + 1]:
                    i, lo = i + 1, 0
            if parts:
                self._add(out, parts, np.array(owner))
        return out

    def _add(self, out: np.ndarray, parts: list[np.ndarray], owner: np.ndarray) -> None:
        c = self.classes[np.concatenate(parts)]
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        row = self.longest[(c[:-3] * self.n + c[1:-2]) * self.n + c[2:-1]]
        cell = row * self.n + c[3:]
        for k, cost in enumerate(self.costs):
            each = np.zeros(len(c), np.float32)
            each[3:] = cost[cell]
            for o in range(ORDER):
                each[starts + o] = 0
            np.add.at(out[:, k], owner, np.add.reduceat(each, starts, dtype=np.float64))


def _counts(c: np.ndarray, order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.zeros(len(c) - order if len(c) > order else 0, np.int64)
    for o in range(order + 1):
        key = key * n + c[o : o + len(key)]
    return np.unique(key, return_counts=True)


def _order(lower: np.ndarray, contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """lower[r]: the code lengths one order below, for contexts[r] (sorted). Estimator C: a context that had d different
    bytes in t occurrences gives an escape d / (t + d), and a byte seen k times k / (t + d)."""
    row, sym = np.searchsorted(contexts, keys // n), keys % n
    t = np.bincount(row, weights=counts, minlength=len(contexts))
    d = np.bincount(row, minlength=len(contexts))
    held = d > 0
    out = lower.copy()
    out[held] += np.log2((t + d)[held] / d[held])[:, None]
    out[row, sym] = np.log2((t + d)[row] / counts)
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1 (a null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, per_language: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees:
    """Trees from the training rows with a text and a language: for each language, the per_language smallest hashes of ids.

    per_language bounds what reaches the driver; ids are ranked first, on two narrow columns, and texts read for those only.
    """
    rows = docs.filter(~held_out(docs[id_col]) & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    rows = rows.select(F.xxhash64(docs[id_col]).alias("h"), docs[lang_col].alias("lang"), docs[text_col].alias("t"))
    first = rows.select("h", "lang").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= per_language)
    chosen = [r.h for r in first.select("h").distinct().collect()]
    texts: dict[str, list[bytes]] = {}
    if chosen:
        for r in rows.filter(F.col("h").isin(chosen)).groupBy("lang", "h").agg(F.min("t").alias("t")).collect():
            texts.setdefault(r.lang, []).append((r.h, r.t.encode()))
    return ContextTrees({k: [t for _, t in sorted(v)][:per_language] for k, v in texts.items()})


def predict(docs: DataFrame, trees: ContextTrees, keep: dict[str, Column], text: Column, schema: str) -> DataFrame:
    """keep's columns (whose types schema gives) with lang_pred, score and bits_per_byte of the whole text.

    score is the winner's share of 2^-bits over all languages; ties go to the smaller name. A text that is null or without
    a letter has `und`, score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(len(names))
            data, at = utf8(texts)
            lang, score, rate = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if model.langs and batch.num_rows:
                bits, size = model.bits(data, at), np.diff(at)
                best = bits.argmin(axis=1)
                own = bits[np.arange(len(best)), best]
                share = 1 / np.exp2(np.minimum(0, own[:, None] - bits)).sum(axis=1)
                for i in np.flatnonzero(size).tolist():
                    if _has_letter(data[at[i] : at[i + 1]]):
                        lang[i], score[i], rate[i] = model.langs[best[i]], share[i], own[i] / size[i]
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=[*names, "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(*[c.alias(k) for k, c in keep.items()], text.alias("__sw_text"))
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, bits_per_byte double")


def _has_letter(b: np.ndarray) -> bool:
    for k in range(0, len(b), 4096):
        part = b[k : k + 4096] | 32
        if ((part >= 97) & (part <= 122)).any():
            return True
    return any(map(str.isalpha, b.tobytes().decode(errors="ignore")))


def identify(docs: DataFrame, per_language: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, bits_per_byte; see train() and predict().

    Nulls: a null text is `und`; a null language is not learned; a null id is hashed as the empty text. Repeated rows repeat.
    A table without a row to learn from makes every row `und`. Further columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    keep = {"doc_id": docs[id_col], "held_out": held_out(docs[id_col])}
    return predict(docs, train(docs, per_language, id_col, text_col, lang_col), keep, docs[text_col], f"doc_id {kind}, held_out boolean")
