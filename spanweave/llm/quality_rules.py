"""Quality rules with host-level verdicts.

Each document is judged by rules of its own; rule failures are summed by host (the site or source a document is from), host
rates are shrunk towards the corpus with a beta prior fitted to all hosts, and a host's verdict is joined back to its
documents. Everything is a DataFrame expression over one row per document; only counts are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, stage, words


def signals(docs: DataFrame, keep: dict[str, Column], text: Column, window: int = 5) -> DataFrame:
    """keep's columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text.

    Repeated windows are found by their 64-bit hash within one text. A text whose window hashes are all distinct is done
    there; in others the windows are sorted by hash, equal neighbours give the positions, and the words they cover are summed.
    """
    d = docs.select(*[c.alias(k) for k, c in keep.items()], F.coalesce(text, F.lit("")).alias("t"))
    d = d.select("*", words(F.col("t")).alias("w"))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)
    d = d.select(
        *keep, "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), lines.alias("lines"),
        F.when(F.size("w") > window, F.transform(F.sequence(F.lit(1), F.size("w") - (window - 1)), lambda i: F.xxhash64(F.slice("w", i, window)))).alias("h"),
    )
    again = F.size("h") > F.size(F.array_distinct("h"))
    d = d.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"),
    )
    same = lambda x, j: F.coalesce((F.get("s", j - 1)["h"] == x["h"]) | (F.get("s", j + 1)["h"] == x["h"]), F.get("s", j - 1)["h"] == x["h"], F.get("s", j + 1)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")))["n"]
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(F.when(F.col("s").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def host_verdicts(judged: DataFrame, max_rate: float = 0.5, most_weight: float = 20.0) -> DataFrame:
    """judged(host, failed) -> host, n_docs, n_failed, shrunk, host_ok.

    The prior beta(a, b) has the mean of all documents and, by the method of moments, the spread of host rates beyond what
    chance gives, but it never weighs more than most_weight documents: where nearly all hosts are alike, the fit alone would
    let no small host differ from them. A host is bad if its posterior mean less two posterior deviations is over max_rate,
    so a host of a few documents needs strong evidence. One row per host; the prior is one row of sums.
    """
    by = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    by = by.filter("host IS NOT NULL")
    rate = F.col("n_failed") / F.col("n_docs")
    by = stage(by, "hosts")
    p = by.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("n_docs") * rate * rate).alias("q")).first()
    n = p.n or 1
    m = ((p.f or 0) + 0.5) / (n + 1)
    spread = max((p.q or 0) / n - m * m - m * (1 - m) * (p.k - 1) / n, 1e-6)
    weight = min(most_weight, max(2.0, m * (1 - m) / spread - 1))
    a, b = F.lit(m * weight) + F.col("n_failed"), F.lit((1 - m) * weight) + F.col("n_docs") - F.col("n_failed")
    mean = a / (a + b)
    low = mean - 2 * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return by.select("host", "n_docs", "n_failed", mean.alias("shrunk"), F.coalesce(low <= max_rate, F.lit(True)).alias("host_ok"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, max_rate: float = 0.5) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, host_rate, kept.

    base_failed: fewer than 10 words, or over 20% of words in 5-word windows that recur in the text. failed: base_failed, more
    than one symbol per ten words, or over 30 repeated lines per hundred words; this feeds the host's rate. kept: not
    base_failed, and the host's verdict is good. Nulls: a null text has no words; a null host has no verdict and rejects
    nothing; ids are only carried. Repeated rows count each. Empty input gives no rows. Further columns are not read.
    """
    d = signals(docs, {"doc_id": docs[id_col], "host": docs["source"] if host is None else host}, docs[text_col])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.withColumn("base_failed", base)
    d = stage(d.withColumn("failed", base | (10 * F.col("n_symbols") > F.col("n_words")) | (100 * F.col("n_dup_lines") > 30 * F.col("n_words"))), "rules")
    verdicts = host_verdicts(d, max_rate).select(F.col("host").alias("__host"), F.col("shrunk").alias("host_rate"), "host_ok")
    d = d.join(verdicts, d["host"] == verdicts["__host"], "left")
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("__host", "host_ok")


#: The same in DuckDB SQL, with windows compared as texts and the prior in one row.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) AS g FROM d WHERE len(w) > 5),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT rid, sum(least(5, coalesce(i - before, 5)))::BIGINT AS n FROM (SELECT *, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM again) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
s AS (SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d JOIN lines USING (rid) LEFT JOIN covered c USING (rid)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
h AS (SELECT host, count(*) AS n, sum((base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_words)::INT) AS f FROM j WHERE host IS NOT NULL GROUP BY host),
p AS (SELECT sum(n)::DOUBLE AS n, (sum(f) + 0.5::DOUBLE) / (sum(n) + 1) AS m, count(*) AS k, sum(f::DOUBLE * f / n) AS q FROM h),
v AS (SELECT m, least(20.0::DOUBLE, greatest(2.0::DOUBLE, m * (1 - m) / greatest(q / n - m * m - m * (1 - m) * (k - 1) / n, 1e-6::DOUBLE) - 1)) AS weight FROM p),
r AS (SELECT host, (m * weight + f) / (weight + n) AS mean, weight + n AS size FROM h, v)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(mean - 2 * sqrt(mean * (1 - mean) / (size + 1)) <= 0.5, true) AS kept FROM j LEFT JOIN r ON j.host = r.host
"""
