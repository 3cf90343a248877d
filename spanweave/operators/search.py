"""Searching and reading: prefix matches, traces, decomposition into known labels and unknown blocks, insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ngrams import occurrences
from ..plans.tables import settle
from .containment import vocabulary
from .cover import NARROW, maximal
from .labels import base_labels, wrapper_labels
from .whole import labelled_prefixes


def match_patterns(a: Column, b: Column) -> Column:
    """How two strings compare from the left: kind exact, remainder_a, remainder_b or mismatch, and what remains."""
    kind = F.when(a == b, "exact").when(a.startswith(b), "remainder_a").when(b.startswith(a), "remainder_b").otherwise("mismatch")
    rest = F.when(a.startswith(b), F.substring(a, F.length(b) + 1, F.length(a))).when(b.startswith(a), F.substring(b, F.length(a) + 1, F.length(b)))
    return F.struct(kind.alias("kind"), rest.alias("remainder"))


def _prefixes(queries: DataFrame) -> DataFrame:
    q = queries.filter(F.length("query") > 0)
    return q.select("query", F.explode(F.sequence(F.lit(1), F.length("query"))).alias("n")).withColumn("ngram", F.substring("query", F.lit(1), F.col("n")))


def largest_prefix(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """query, match, n, remainder: the longest prefix that the vocabulary holds. Prefixes meet it by equality."""
    hit = _prefixes(queries).join(vocab.select("ngram"), "ngram").groupBy("query").agg(F.max("n").alias("n"))
    return hit.select("query", F.substring("query", F.lit(1), F.col("n")).alias("match"), "n", F.substring("query", F.col("n") + 1, F.length("query")).alias("remainder"))


def substrings(labels: DataFrame) -> DataFrame:
    """(label, n, part): every distinct substring of every label."""
    d = labels.select(F.col("ngram").alias("label"), "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("p"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("p") + 1)).alias("w"))
    return d.select("label", "n", F.substring("label", F.col("p"), F.col("w")).alias("part")).distinct()


def search_root(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """query, match, root: the narrowest label that contains the match, ties to the first in order."""
    within = substrings(labels).groupBy("part").agg(F.min(F.struct("n", "label")).alias("root"))
    return matches.join(within, matches["match"] == within["part"]).select("query", "match", F.col("root.label").alias("root"))


def trace(matches: DataFrame) -> DataFrame:
    """matches(query, match, root) -> (query, from, to, dir, dist): containment edges from the first character of the match up to
    the root and down to the last one.

    Upward edges widen by one character: the prefixes of the match, then all that lies between it and the root; dist is how
    much of the node `from` precedes the match. Downward edges narrow the root from the right until it ends with the match,
    then take its last character; dist is where the node `to` begins, from the match's start (negative before it). The
    match is taken where it first occurs in the root. All are intervals of the root, so no edge table is walked.
    """
    m = matches.select("query", "root", (F.instr("root", F.col("match")) - 1).alias("s"), F.length("match").alias("m"), F.length("root").alias("n"))
    m = m.withColumn("e", F.col("s") + F.col("m"))
    s, e, n = F.col("s"), F.col("e"), F.col("n")

    def edges(rows: DataFrame, i: Column, j: Column, k: Column, to: Column, up: bool, dist: Column) -> DataFrame:
        part = lambda lo, hi: F.substring("root", lo + 1, hi - lo)
        return rows.select("query", part(i, j).alias("from"), part(k, to).alias("to"), F.lit("up" if up else "down").alias("dir"), dist.cast("int").alias("dist"))

    prefixes = m.filter("m > 1").select("*", F.explode(F.sequence(s + 1, e - 1)).alias("j"))
    around = m.select("*", F.explode(F.sequence(F.lit(0), s)).alias("i")).select("*", F.explode(F.sequence(e, n)).alias("j"))
    narrowed = m.filter("e < n").select("*", F.explode(F.sequence(e + 1, n)).alias("j"))
    i, j, zero = F.col("i"), F.col("j"), F.lit(0)
    found = [
        edges(prefixes, s, j, s, j + 1, True, zero),
        edges(around.filter("i > 0"), i, j, i - 1, j, True, s - i),
        edges(around.filter("j < n"), i, j, i, j + 1, True, s - i),
        edges(narrowed, zero, j, zero, j - 1, False, -s),
        edges(m.filter("e > 1"), zero, e, e - 1, e, False, e - 1 - s),
    ]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.distinct()


def longest_labels(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """query, offset, child_n: the longest label that starts at each place. Queries of up to NARROW characters are compared by all
    their substrings, in one join; wider ones by labelled_prefixes()."""
    wide = queries.filter(F.length("query") > NARROW).select("query").distinct()
    wide = settle(wide.select(F.monotonically_increasing_id().alias("text_id"), F.col("query").alias("text")), "wide")
    q = queries.filter((F.length("query") > 0) & (F.length("query") <= NARROW))
    q = q.select("query", F.explode(F.sequence(F.lit(0), F.length("query") - 1)).alias("offset"))
    q = q.select("*", F.explode(F.sequence(F.lit(1), F.length("query") - F.col("offset"))).alias("n"))
    q = q.withColumn("ngram", F.substring("query", F.col("offset") + 1, F.col("n")))
    hit = q.join(labels.select("ngram"), "ngram", "left_semi").groupBy("query", "offset").agg(F.max("n").alias("child_n"))
    if wide.isEmpty():
        return hit
    more = labelled_prefixes(wide, labels).join(wide, "text_id")
    return hit.unionByName(more.select(F.col("text").alias("query"), F.col("pos").alias("offset"), F.col("n").alias("child_n")))


def decomposition(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """query, offset, ngram, n: at each place the longest label that starts there, less those inside another."""
    best = maximal(longest_labels(queries, labels), "query")
    return best.select("query", "offset", F.substring("query", F.col("offset") + 1, F.col("child_n")).alias("ngram"), F.col("child_n").alias("n"))


def blocks(queries: DataFrame, alphabet: DataFrame) -> DataFrame:
    """query, start, length, known: runs of characters that the alphabet has, and runs that it has not."""
    q = queries.filter(F.length("query") > 0).select("query", F.posexplode(F.split("query", "")).alias("pos", "ngram"))
    q = q.join(alphabet.select("ngram", F.lit(True).alias("known")), "ngram", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("query", "known").orderBy("pos"))
    return q.withColumn("island", F.col("pos") - place).groupBy("query", "known", "island").agg(F.min("pos").alias("start"), F.count("*").alias("length")).select("query", "start", "length", "known")


def inserted(corpus: DataFrame, labels: DataFrame, texts: DataFrame, max_n: int | None = None) -> DataFrame:
    """label(ngram, n, kind) of the corpus with texts(text) added, from the labels of the corpus alone.

    Only n-grams of the new texts can change: others keep their counts, and so do all their extensions. So those alone are
    counted again, over all texts; what was closed stays closed. Wrappers then close over all texts. Texts that the corpus has
    already add nothing.
    """
    new = texts.filter(F.length("text") > 0).select("text").distinct().join(corpus.select("text"), "text", "left_anti")
    new = settle(new.select(F.xxhash64("text").alias("text_id"), "text"), "new")
    every = corpus.filter(F.length("text") > 0).select(F.xxhash64("text").alias("text_id"), "text").distinct().unionByName(new)
    touched = settle(occurrences(new, max_n, ngrams_only=True).distinct(), "touched")
    again = base_labels(vocabulary(every, max_n, touched))
    kept = labels.filter("kind <> 'wrapper'").select("ngram", "n", "kind").join(again, "ngram", "left_anti")
    base = settle(kept.unionByName(again), "base")
    return base.unionByName(wrapper_labels(every, base, max_n).withColumn("kind", F.lit("wrapper")))


def overlap_chains(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """query, offset, n, links: runs of known strings of which each starts before the one before it ends, as one interval each.

    The strings are the longest that start at each place, less those inside another: from a match, the next one is that of its
    longest postfix that a known string continues beyond it. Places where nothing known starts are strings of one character.
    """
    q = queries.filter(F.length("query") > 0).select("query").distinct()
    single = q.select("query", F.explode(F.sequence(F.lit(0), F.length("query") - 1)).alias("offset"), F.lit(1).alias("child_n"))
    best = longest_labels(q, labels).unionByName(single).groupBy("query", "offset").agg(F.max("child_n").alias("child_n"))
    best = maximal(best, "query")
    before = Window.partitionBy("query").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.max(F.col("offset") + F.col("child_n")).over(before) <= F.col("offset"), F.lit(True))
    chain = F.sum(first.cast("int")).over(Window.partitionBy("query").orderBy("offset"))
    runs = best.withColumn("first", first).withColumn("chain", chain).groupBy("query", "chain")
    runs = runs.agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("child_n")).alias("end"), F.count("*").alias("links"))
    return runs.select("query", "offset", (F.col("end") - F.col("offset")).cast("int").alias("n"), "links")


def read_sequences(queries: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, labels) after all sequences of queries(query) were read, by induction.

    A round takes every sequence's chains of overlapping known strings with the labels of its start, and inserts what each chain
    spans as a label (kind inserted), which the next round's matches begin with. Rounds end when no chain is new, with each
    sequence a row of known strings that don't overlap; that is its rule (query, sub_index, offset, child, child_n). Unknown
    characters become labels too, and the sequences themselves (kind root). All sequences of a round see the same labels, so
    neither their order nor their partitioning matters.
    """
    q = settle(queries.filter(F.length("query") > 0).select("query").distinct(), "sequences")
    leaves = q.select(F.explode(F.array_distinct(F.split("query", ""))).alias("ngram")).distinct().join(labels.select("ngram"), "ngram", "left_anti")
    known = settle(labels.select("ngram", "n", "kind").unionByName(leaves.select("ngram", F.lit(1).alias("n"), F.lit("leaf").alias("kind"))), "known")
    while True:
        chains = settle(overlap_chains(q, known), "chains")
        spans = chains.filter("links > 1").select(F.substring("query", F.col("offset") + 1, F.col("n")).alias("ngram")).distinct()
        new = settle(spans.join(known.select("ngram"), "ngram", "left_anti"), "inserted")
        if new.isEmpty():
            break
        known = settle(known.unionByName(new.select("ngram", F.length("ngram").alias("n"), F.lit("inserted").alias("kind"))), "known")
    place = F.row_number().over(Window.partitionBy("query").orderBy("offset")) - 1
    rules = chains.select("query", place.alias("sub_index"), "offset", F.substring("query", F.col("offset") + 1, F.col("n")).alias("child"), F.col("n").alias("child_n"))
    roots = q.select(F.col("query").alias("ngram")).join(known.select("ngram"), "ngram", "left_anti")
    return rules, known.unionByName(roots.select("ngram", F.length("ngram").alias("n"), F.lit("root").alias("kind")))
