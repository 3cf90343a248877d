"""Line deduplication with a log-template tree of fixed depth.

A line's tokens with digits are variable fields from the start. Lines fall into leaves by token count and leading tokens. In a
leaf, a token is constant if its place holds it in lines of at least min_docs documents; the other tokens generalise to
variable fields, and lines that are alike after that form a log group, of which a leaf may have many. A line most of whose
tokens would be variable stands for itself. A template, that of a group or a line of its own, is boilerplate if it
recurs in min_docs documents, and its lines are dropped.

Copies are one document: equal texts, and texts of which 95% of the words lie in lines that recur elsewhere, which count by the
least of those lines. So groups of copies are left to document-level deduplication, however many copies they have, while pages
that are a long licence and few words of their own lose the licence. Only hashes of lines are shuffled, but for the distinct
lines of leaves that may hold a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, discard, stage

VARIABLE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9]*+[0-9])[^\x20\x09-\x0D]++"


def _masked(lines: Column) -> Column:
    """The lines with their variable fields masked, tokens parted by single spaces. Most lines need neither regex.

    One transform after the other: what a lambda's argument is bound to is computed once, however often the body has it.
    """
    lines = F.transform(lines, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, VARIABLE, "<*>")).otherwise(x))
    odd = lambda x: x.contains("  ") | x.contains("\t") | x.contains("\x0b") | x.contains("\x0c") | x.contains("\r")
    return F.transform(lines, lambda x: F.trim(F.when(odd(x), F.regexp_replace(x, GAP, " ")).otherwise(x)))


def _size(x: Column) -> Column:
    return F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)


def _leaf(x: Column, size: Column, depth: int) -> Column:
    """Up to depth tokens, a line is its own leaf and an exact template."""
    return F.xxhash64(size, F.substring_index(x, " ", depth))


def _worded(x: Column) -> Column:
    """Whether a line has a letter outside its variable fields: rules, brackets and bare numbers are no template."""
    return F.when(x.contains("<*>"), F.replace(x, F.lit("<*>"), F.lit(""))).otherwise(x).rlike(r"\p{L}")


def _lines(docs: DataFrame, depth: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each line with a word: k, kh (the document's id and text hash), words (of the whole text), line (from 0), size
    (tokens), h (the masked line's hash), first (its digest, which orders alike on every engine), leaf."""
    d = docs.filter(docs[text_col].isNotNull()).select(docs[id_col].alias("k"), F.xxhash64(docs[text_col]).alias("kh"), _masked(F.split(docs[text_col], "\n", -1)).alias("ls"))
    facts = F.transform("ls", lambda x, i: F.struct(i.alias("line"), _size(x).alias("size"), x.alias("m")))
    d = d.select("k", "kh", F.filter(facts, lambda x: x["size"] > 0).alias("ls"))
    d = d.select("k", "kh", F.aggregate("ls", F.lit(0), lambda a, x: a + x["size"]).alias("words"), F.explode("ls").alias("x")).select("k", "kh", "words", "x.*")
    d = d.filter(_worded(F.col("m")))
    return d.select("k", "kh", "words", "line", "size", F.xxhash64("m").alias("h"), F.substring(F.md5("m"), 1, 8).alias("first"), _leaf(F.col("m"), F.col("size"), depth).alias("leaf"))


def _forms(docs: DataFrame, depth: int, text_col: str) -> DataFrame:
    """leaf, h, m of each line of more than depth tokens, for joining: texts of lines are read again rather than carried."""
    d = docs.filter(docs[text_col].isNotNull()).select(F.explode(_masked(F.split(docs[text_col], "\n", -1))).alias("m")).select("m", _size(F.col("m")).alias("size"))
    return d.filter((F.col("size") > depth) & _worded(F.col("m"))).select(_leaf(F.col("m"), F.col("size"), depth).alias("leaf"), F.xxhash64("m").alias("h"), "m")


def origins(lines: DataFrame, copied: float = 0.95) -> DataFrame:
    """kh, origin of the texts that count by a line of theirs: `copied` of their words lie in lines found in other texts too."""
    again = lines.groupBy("h").agg(F.min("kh").alias("a"), F.max("kh").alias("b")).filter("a < b").select("h")
    held = lines.join(stage(again, "again"), "h", "left_semi").groupBy("kh").agg(F.collect_set(F.struct("line", "size")).alias("ls"), F.max("words").alias("words"), F.min("first").alias("first"))
    share = F.aggregate("ls", F.lit(0), lambda a, x: a + x["size"]) / F.col("words")
    return held.filter(share >= copied).select("kh", F.xxhash64(F.lit("line"), "first").alias("origin"))


def line_templates(docs: DataFrame, min_docs: int = 10, depth: int = 3, similarity: float = 0.7, copied: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per line of leaves that min_docs lines of several texts fall into: k, kh, line, origin, template; see _lines().

    template is a hash of the line's log group, or of the line with its variable fields masked.
    """
    lines = stage(_lines(docs, depth, id_col, text_col), "lines")
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("kh").alias("a"), F.max("kh").alias("b"), F.min("h").alias("c"), F.max("h").alias("d"))
    leaves = stage(leaves.filter((F.col("n") >= min_docs) & (F.col("a") < F.col("b"))).select("leaf", (F.col("c") < F.col("d")).alias("several")), "leaves")
    live = lines.join(leaves, "leaf").join(stage(origins(lines, copied), "origins"), "kh", "left")
    live = stage(live.select("leaf", "several", "h", "k", "kh", "line", F.coalesce("origin", "kh").alias("origin")), "live")
    discard(lines)
    seen = live.filter("several").select("leaf", "h", "origin").distinct().groupBy("leaf", "h").agg(F.count("*").alias("n"))
    forms = _forms(docs, depth, text_col).join(leaves.filter("several").select("leaf"), "leaf", "left_semi").groupBy("leaf", "h").agg(F.first("m").alias("m"))
    forms = stage(forms.join(seen, ["leaf", "h"]).select("leaf", "h", "n", F.split("m", " ").alias("tokens")), "forms")
    cells = forms.select("leaf", "h", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token")).filter(F.col("pos") >= depth)
    fixed = stage(cells.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= min_docs).select("leaf", "pos", "token"), "fixed")
    groups = cells.join(fixed, ["leaf", "pos", "token"]).groupBy("leaf", "h", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("constant"))
    groups = groups.filter(F.size("constant") >= similarity * (F.col("size") - depth)).select("leaf", "h", F.xxhash64("leaf", "constant").alias("group"))
    live = live.join(stage(groups, "groups"), ["leaf", "h"], "left")
    return live.select("k", "kh", "line", "origin", F.coalesce("group", "h").alias("template"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, depth: int = 3, similarity: float = 0.7, copied: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text less its boilerplate lines, and n_lines, n_dropped (long); other columns pass through.

    A template is boilerplate if it is found in at least min_docs documents, copies counting once; what recurs within one
    document stays. Lines without a letter outside of tokens with digits stay. A line is generalised if at least
    `similarity` of its tokens after the leading ones are constant. Nulls: a null text stays null with no lines; null ids
    count as one id. Repeated rows (equal id and text) get equal results and count once. Empty input gives no rows.
    """
    lines = stage(line_templates(docs, min_docs, depth, similarity, copied, id_col, text_col), "templates")
    often = lines.select("template", "origin").distinct().groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    often = stage(often.select("template"), "often")
    drops = lines.join(often, "template", "left_semi").groupBy("k", "kh").agg(F.collect_set("line").alias("__sw_lines"))
    drops = drops.select(F.col("k").alias("__sw_k"), F.col("kh").alias("__sw_kh"), "__sw_lines")
    rows = docs.withColumn("__sw_h", F.xxhash64(docs[text_col]))
    rows = rows.join(drops, rows[id_col].eqNullSafe(drops["__sw_k"]) & (rows["__sw_h"] == drops["__sw_kh"]), "left")
    every = F.split(rows[text_col], "\n", -1)
    kept = F.filter(every, lambda x, i: ~F.coalesce(F.array_contains("__sw_lines", i), F.lit(False)))
    text = F.when(F.col("__sw_lines").isNull(), rows[text_col]).otherwise(F.array_join(kept, "\n"))
    extra = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return rows.select(
        *[docs[c] for c in extra], text.alias(text_col),
        F.when(rows[text_col].isNull(), 0).otherwise(F.size(every)).cast("long").alias("n_lines"), F.when(F.col("__sw_lines").isNull(), 0).otherwise(F.size("__sw_lines")).cast("long").alias("n_dropped"),
    )


#: The same in DuckDB SQL at the default parameters, with lines, leaves and groups as texts instead of hashes.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, text, unnest(range(0, len(ls))) AS line, unnest(list_transform(ls, lambda x: list_transform(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda y: CASE WHEN regexp_matches(y, '[0-9]') THEN '<*>' ELSE y END))) AS w FROM d WHERE text IS NOT NULL),
m AS MATERIALIZED (SELECT rid, text, line, w, array_to_string(w, ' ') AS m, len(w) || ' ' || array_to_string(w[1:3], ' ') AS leaf, sum(len(w)) OVER (PARTITION BY rid) AS words FROM l WHERE len(w) > 0),
c AS MATERIALIZED (SELECT * FROM m WHERE regexp_matches(replace(m, '<*>', ''), '\p{L}')),
again AS (SELECT m FROM c GROUP BY m HAVING count(DISTINCT text) > 1),
copies AS (SELECT rid, min(substr(md5(m), 1, 8)) AS origin FROM c WHERE m IN (SELECT m FROM again) GROUP BY rid, words HAVING sum(len(w)) >= 0.95 * words),
o AS MATERIALIZED (SELECT c.*, coalesce('line ' || origin, 'text ' || text) AS origin FROM c LEFT JOIN copies USING (rid)),
forms AS MATERIALIZED (SELECT leaf, m, any_value(w) AS w, count(DISTINCT origin) AS n FROM o WHERE len(w) > 3 GROUP BY leaf, m),
cells AS MATERIALIZED (SELECT leaf, m, n, len(w) AS size, unnest(range(3, len(w))) AS pos, unnest(w[4:]) AS token FROM forms),
fixed AS (SELECT leaf, pos, token FROM cells GROUP BY leaf, pos, token HAVING sum(n) >= 10),
grouped AS (SELECT leaf, m, string_agg(pos || ' ' || token, chr(10) ORDER BY pos) AS g FROM cells JOIN fixed USING (leaf, pos, token) GROUP BY leaf, m, size HAVING count(*) >= 0.7 * (size - 3)),
t AS MATERIALIZED (SELECT rid, line, origin, CASE WHEN g IS NULL THEN 'line ' || o.m ELSE 'leaf ' || o.leaf || chr(10) || g END AS template FROM o LEFT JOIN grouped ON o.leaf = grouped.leaf AND o.m = grouped.m),
often AS (SELECT template FROM t GROUP BY template HAVING count(DISTINCT origin) >= 10),
gone AS (SELECT rid, list(line) AS gone FROM t WHERE template IN (SELECT template FROM often) GROUP BY rid)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text FROM d LEFT JOIN gone USING (rid)
"""
