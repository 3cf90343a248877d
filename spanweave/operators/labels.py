"""Labels: significant n-grams. Frequency labels are the closed substrings; wrappers close them under overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ngrams import occurrences


def frequency_labels(vocab: DataFrame) -> DataFrame:
    """ngram, n, cnt of the closed substrings of two characters or more that are no whole text."""
    return vocab.filter("closed AND n > 1 AND NOT is_root").select("ngram", "n", "cnt")


def base_labels(vocab: DataFrame) -> DataFrame:
    """Roots, leaves and frequency labels: label(ngram, n, kind)."""
    kind = F.when(F.col("is_root"), "root").when(F.col("is_leaf"), "leaf").otherwise("frequency")
    return vocab.filter("is_root OR is_leaf OR closed").select("ngram", "n", kind.alias("kind"))


def labelled_intervals(corpus: DataFrame, labels: DataFrame, max_n: int | None = None) -> DataFrame:
    """(text_id, s, e): the places of labels of two characters or more."""
    occ = occurrences(corpus, max_n, 2).select("text_id", F.col("pos").alias("s"), (F.col("pos") + F.col("n")).alias("e"), "ngram")
    return occ.join(labels.filter("n > 1").select("ngram"), "ngram", "left_semi").select("text_id", "s", "e")


def _reach(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(s, lo, hi): for each start, the runs of ends e that chains of overlapping intervals lead to.

    [s, e) is such a chain's span if every boundary within it is crossed by an interval inside it. With starts taken from the
    right, least[b] is the least end of an interval that crosses b; so the ends e of s are those that no least[b] before e
    exceeds, up to the first boundary that nothing crosses.
    """
    out: list[tuple[int, int, int]] = []
    if not len(starts):
        return out
    base = int(starts.min())
    starts, ends = starts - base, ends - base
    never = int(ends.max()) + 1
    least = np.full(never + 1, never, np.int64)
    order = np.lexsort((-ends, -starts))
    held, at = np.unique(-starts[order], return_index=True)
    for s, some in zip((-held).tolist(), np.split(ends[order], at[1:]), strict=True):
        for e in some.tolist():
            np.minimum(least[s + 1 : e], e, out=least[s + 1 : e])
        stop = int((least[s + 1 :] == never).argmax())  # boundaries from s + 1 on that are crossed
        if stop:
            good = np.flatnonzero(np.maximum.accumulate(least[s + 1 : s + 1 + stop]) <= np.arange(s + 2, s + 2 + stop))
            if len(good):
                cut = np.flatnonzero(np.diff(good) > 1)
                lo, hi = good[np.append(0, cut + 1)], good[np.append(cut, len(good) - 1)]
                out += [(s + base, int(a) + s + 2 + base, int(b) + s + 2 + base) for a, b in zip(lo, hi, strict=True)]
    return out


def wrapper_ranges(intervals: DataFrame) -> DataFrame:
    """(text_id, s, e) -> (text_id, s, lo, hi): every interval [s, e) with lo <= e <= hi is labelled or spanned by a chain of
    overlapping labelled ones, and no other is. One sweep a text, without rounds; ends that follow each other are one row."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = _reach(*(rows.column(c).to_numpy().astype(np.int64) for c in ("s", "e")))
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"text_id": pa.array([key[0].as_py()] * len(found), pa.int64()), **{c: pa.array(v, pa.int32()) for c, v in zip(("s", "lo", "hi"), columns, strict=True)}})

    return intervals.groupBy("text_id").applyInArrow(run, "text_id long, s int, lo int, hi int")


def wrapper_labels(corpus: DataFrame, labels: DataFrame, max_n: int | None = None) -> DataFrame:
    """ngram, n of the unlabelled strings (of at most max_n characters) that chains of overlapping labelled intervals span."""
    found = wrapper_ranges(labelled_intervals(corpus, labels, max_n))
    hi = F.col("hi") if max_n is None else F.least("hi", F.col("s") + max_n)
    each = found.filter(F.col("lo") <= hi).select("text_id", "s", F.explode(F.sequence("lo", hi)).alias("e"))
    spans = each.join(corpus, "text_id").select(F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")).alias("ngram")).distinct()
    return spans.join(labels.select("ngram"), "ngram", "left_anti").select("ngram", F.length("ngram").alias("n"))


def all_labels(corpus: DataFrame, vocab: DataFrame, max_n: int | None = None) -> DataFrame:
    """label(ngram, n, kind) with kind root, leaf, frequency or wrapper; the first that applies."""
    base = base_labels(vocab)
    return base.unionByName(wrapper_labels(corpus, base, max_n).withColumn("kind", F.lit("wrapper")))
