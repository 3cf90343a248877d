"""DuckDB SQL of the registered queries, built from common table expressions.

Forms are independent of the Spark ones where two exist: closed strings by comparing counts of extensions, wrappers by
boundary coverage, covers by anti-joins.
"""

from __future__ import annotations

from .sources.graphs import EXAMPLES

_PARTS = {
    "corpus": "SELECT row_number() OVER (ORDER BY p_name) - 1 AS text_id, p_name AS text FROM (SELECT DISTINCT p_name FROM part WHERE length(p_name) > 0)",
    "queries": "SELECT DISTINCT lower(p_type) AS query FROM part WHERE length(p_type) > 0",
    "occ": """SELECT text_id, text, pos::INT AS pos, n::INT AS n, substring(text, pos + 1, n) AS ngram FROM
      (SELECT *, unnest(range(1, length(text) - pos + 1)) AS n FROM (SELECT *, unnest(range(0, length(text))) AS pos FROM corpus))""",
    "vocab": "SELECT ngram, n, count(*)::BIGINT AS cnt, bool_or(n = length(text)) AS is_root, n = 1 AS is_leaf FROM occ GROUP BY ngram, n",
    "edges": """SELECT parent, parent_n, pattern_id::INT AS pattern_id, sub_index::INT AS sub_index, "offset"::INT AS "offset", child, length(child)::INT AS child_n FROM (
      SELECT ngram AS parent, n AS parent_n, 0 AS pattern_id, 0 AS sub_index, 0 AS "offset", left(ngram, n - 1) AS child FROM vocab WHERE n > 1
      UNION ALL SELECT ngram, n, 0, 1, n - 1, right(ngram, 1) FROM vocab WHERE n > 1
      UNION ALL SELECT ngram, n, 1, 0, 0, left(ngram, 1) FROM vocab WHERE n > 2
      UNION ALL SELECT ngram, n, 1, 1, 1, right(ngram, n - 1) FROM vocab WHERE n > 2)""",
    "closed": """SELECT * FROM vocab v WHERE NOT EXISTS (SELECT 1 FROM vocab y WHERE y.n = v.n + 1 AND y.cnt = v.cnt
      AND (left(y.ngram, v.n) = v.ngram OR right(y.ngram, v.n) = v.ngram))""",
    "base": """SELECT ngram, n, CASE WHEN is_root THEN 'root' WHEN is_leaf THEN 'leaf' ELSE 'frequency' END AS kind FROM vocab
      WHERE is_root OR is_leaf OR ngram IN (SELECT ngram FROM closed)""",
    "li": "SELECT text_id, text, pos AS s, pos + n AS e FROM occ WHERE n > 1 AND ngram IN (SELECT ngram FROM base)",
    "wrap": """SELECT DISTINCT substring(a.text, a.s + 1, b.e - a.s) AS ngram, (b.e - a.s)::INT AS n FROM (SELECT DISTINCT text_id, text, s FROM li) a
      JOIN (SELECT DISTINCT text_id, e FROM li) b ON a.text_id = b.text_id AND b.e - a.s > 1
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT text_id, unnest(range(1, length(text))) AS x FROM corpus) i WHERE i.text_id = a.text_id AND i.x > a.s AND i.x < b.e
        AND NOT EXISTS (SELECT 1 FROM li l WHERE l.text_id = i.text_id AND l.s >= a.s AND l.e <= b.e AND l.s < i.x AND i.x < l.e))
      AND substring(a.text, a.s + 1, b.e - a.s) NOT IN (SELECT ngram FROM base)""",
    "labels": "SELECT ngram, n, kind FROM base UNION ALL SELECT ngram, n, 'wrapper' FROM wrap",
    "inner_i": """SELECT parent, pos::INT AS "offset", w::INT AS child_n, substring(parent, pos + 1, w) AS child FROM
      (SELECT *, unnest(range(1, n - pos + 1)) AS w FROM (SELECT ngram AS parent, n, unnest(range(0, n)) AS pos FROM labels WHERE n > 1))
      WHERE w < n AND substring(parent, pos + 1, w) IN (SELECT ngram FROM labels)""",
    "cover": """SELECT parent, "offset", child, child_n FROM inner_i a WHERE NOT EXISTS (SELECT 1 FROM inner_i b WHERE b.parent = a.parent
      AND b."offset" <= a."offset" AND b."offset" + b.child_n >= a."offset" + a.child_n AND b.child_n > a.child_n)""",
    "ends": """SELECT parent, length(parent) AS n, max(child_n) FILTER ("offset" = 0) AS lp, max(child_n) FILTER ("offset" + child_n = length(parent)) AS ls FROM inner_i GROUP BY parent""",
    "grammar": """SELECT parent, pattern_id::INT AS pattern_id, sub_index::INT AS sub_index, "offset"::INT AS "offset", child, length(child)::INT AS child_n FROM (
      SELECT c.parent, 0 AS pattern_id, row_number() OVER (PARTITION BY c.parent ORDER BY c."offset") - 1 AS sub_index, c."offset", c.child FROM cover c JOIN ends e ON c.parent = e.parent WHERE e.lp + e.ls <= e.n
      UNION ALL SELECT parent, 0, 0, 0, left(parent, lp) FROM ends WHERE lp + ls > n
      UNION ALL SELECT parent, 0, 1, lp, right(parent, n - lp) FROM ends WHERE lp + ls > n
      UNION ALL SELECT parent, 1, 0, 0, left(parent, n - ls) FROM ends WHERE lp + ls > n
      UNION ALL SELECT parent, 1, 1, n - ls, right(parent, ls) FROM ends WHERE lp + ls > n)""",
    "prefix": """SELECT query, max(n)::INT AS n FROM (SELECT query, unnest(range(1, length(query) + 1)) AS n FROM queries) WHERE left(query, n) IN (SELECT ngram FROM vocab) GROUP BY query""",
    "nexts": """SELECT left(x.ngram, x.n - 1) AS v, right(x.ngram, 1) AS w, x.cnt / v.cnt AS p FROM vocab x JOIN vocab v ON v.ngram = left(x.ngram, x.n - 1)""",
    "sib": "SELECT DISTINCT x.child AS a, y.child AS b FROM grammar x JOIN grammar y ON x.parent = y.parent AND x.child < y.child WHERE x.child_n > 1 AND y.child_n > 1",
}

#: What each part is built from.
_NEEDS = {
    "occ": ["corpus"], "vocab": ["occ"], "edges": ["vocab"], "closed": ["vocab"], "base": ["closed", "vocab"], "li": ["occ", "base"], "wrap": ["li", "corpus", "base"],
    "labels": ["base", "wrap"], "inner_i": ["labels"], "cover": ["inner_i"], "ends": ["inner_i"], "grammar": ["cover", "ends"], "prefix": ["queries", "vocab"], "nexts": ["vocab"], "sib": ["grammar"],
}


def _with(*parts: str) -> str:
    order: list[str] = []

    def add(p: str) -> None:
        for q in _NEEDS.get(p, []):
            add(q)
        if p not in order:
            order.append(p)

    for p in parts:
        add(p)
    return "WITH " + ",\n".join(f"{p} AS MATERIALIZED ({_PARTS[p]})" for p in order) + "\n"


_ROOT = """SELECT query, left(query, n) AS "match", (SELECT ngram FROM labels l WHERE contains(l.ngram, left(query, prefix.n)) ORDER BY l.n, l.ngram LIMIT 1) AS root FROM prefix
  WHERE EXISTS (SELECT 1 FROM labels l WHERE contains(l.ngram, left(query, prefix.n)))"""

#: A corpus of the part names and the part types, parsed as a whole: what insertion has to come to.
_GROWN, _GROWN_GRAMMAR = (_with(x).replace(_PARTS["corpus"], """SELECT row_number() OVER (ORDER BY text) - 1 AS text_id, text FROM (SELECT p_name AS text FROM part WHERE length(p_name) > 0
      UNION SELECT lower(p_type) FROM part WHERE length(p_type) > 0)""") for x in ("labels", "grammar"))

#: The example graphs as rows of (graph, parent, pattern_id, cells).
_EXAMPLES = ", ".join(f"({g}, '{parent}', {i}, {cells})" for g, rules in EXAMPLES.items() for parent, patterns in rules.items() for i, cells in enumerate(patterns))

#: Users' events as texts of one character an event, and the closed strings of them.
_EVENTS = """WITH kinds AS (SELECT event_type, chr((96 + row_number() OVER (ORDER BY event_type))::INT) AS c FROM (SELECT DISTINCT event_type FROM events)),
  corpus AS MATERIALIZED (SELECT user_id AS text_id, string_agg(c, '' ORDER BY ts, event_id) AS text, list(event_type ORDER BY ts, event_id) AS names FROM events JOIN kinds USING (event_type) GROUP BY user_id),
  occ AS (SELECT text_id, text, names, pos, n, substring(text, pos + 1, n) AS ngram FROM (SELECT *, unnest(range(1, length(text) - pos + 1)) AS n FROM (SELECT *, unnest(range(0, length(text))) AS pos FROM corpus))),
  stats AS MATERIALIZED (SELECT ngram, n, count(*) AS cnt, bool_or(n = length(text)) AS is_root, any_value(array_to_string(names[pos + 1:pos + n], ' ')) AS gram,
    count(nullif(substring(text, pos, 1), '')) AS pc, min(nullif(substring(text, pos, 1), '')) AS pl, max(nullif(substring(text, pos, 1), '')) AS pm,
    count(nullif(substring(text, pos + n + 1, 1), '')) AS nc, min(nullif(substring(text, pos + n + 1, 1), '')) AS nl, max(nullif(substring(text, pos + n + 1, 1), '')) AS nm FROM occ GROUP BY ngram, n),
  base AS MATERIALIZED (SELECT ngram, n::INT AS n, gram, CASE WHEN is_root THEN 'root' WHEN n = 1 THEN 'leaf' ELSE 'frequency' END AS kind FROM stats
    WHERE is_root OR n = 1 OR NOT coalesce(pc = cnt AND pl = pm, FALSE) AND NOT coalesce(nc = cnt AND nl = nm, FALSE))
"""

def _read(rounds: int) -> str:
    """Reading by induction, with as many rounds as the part types settle in at any scale (a round more changes nothing)."""
    out = """, letters AS (SELECT DISTINCT unnest(string_split(query, '')) AS ngram FROM queries), k0 AS MATERIALIZED (SELECT ngram FROM labels UNION SELECT ngram FROM letters)"""
    for r in range(rounds + 1):
        out += f""", b{r} AS MATERIALIZED (SELECT query, pos, max(w) AS w FROM (SELECT *, unnest(range(1, length(query) - pos + 1)) AS w FROM (SELECT query, unnest(range(0, length(query))) AS pos FROM queries))
        WHERE substring(query, pos + 1, w) IN (SELECT ngram FROM k{r}) GROUP BY query, pos),
      m{r} AS (SELECT * FROM b{r} a WHERE NOT EXISTS (SELECT 1 FROM b{r} b WHERE b.query = a.query AND b.pos < a.pos AND b.pos + b.w >= a.pos + a.w)),
      c{r} AS MATERIALIZED (SELECT query, min(pos) AS pos, max(pos + w) AS e, count(*) AS links FROM (SELECT *, sum(f) OVER (PARTITION BY query ORDER BY pos) AS chain FROM
        (SELECT *, CASE WHEN coalesce(max(pos + w) OVER (PARTITION BY query ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= pos, TRUE) THEN 1 ELSE 0 END AS f FROM m{r})) GROUP BY query, chain),
      k{r + 1} AS MATERIALIZED (SELECT ngram FROM k{r} UNION SELECT substring(query, pos + 1, e - pos) FROM c{r} WHERE links > 1)"""
    return out + f""" SELECT query, (row_number() OVER (PARTITION BY query ORDER BY pos) - 1)::INT AS sub_index, pos::INT AS "offset", substring(query, pos + 1, e - pos) AS child, (e - pos)::INT AS child_n FROM c{rounds}"""


_CUT = """, cut AS (SELECT parent, (length(parent) // 2)::INT AS "at", TRUE AS top FROM grammar UNION SELECT parent, "offset", FALSE FROM grammar WHERE "offset" > 0),
  borders AS (SELECT parent, "at" FROM cut UNION SELECT parent, 0 FROM cut UNION SELECT parent, length(parent)::INT FROM cut),
  ranges AS MATERIALIZED (SELECT a.parent, a."at" AS lo, b."at" AS hi FROM borders a JOIN borders b ON a.parent = b.parent AND a."at" < b."at"
    WHERE EXISTS (SELECT 1 FROM cut t WHERE t.top AND t.parent = a.parent AND (a."at" >= t."at" OR b."at" <= t."at")))"""

def _completed(rounds: int) -> str:
    """Inner and passed splits of the part names' thirds; texts of at most `rounds` characters settle in as many rounds."""
    inner = """SELECT DISTINCT r.parent, "at" FROM (SELECT parent, unnest([min("offset"), max("offset" + child_n)]) AS "at" FROM
        (SELECT g.*, coalesce((SELECT max(t."at") FROM {t} t WHERE t.parent = g.parent AND t."at" <= g."offset"), 0) AS lo FROM grammar g
          WHERE g.parent IN (SELECT parent FROM {t}) AND NOT EXISTS (SELECT 1 FROM {t} t WHERE t.parent = g.parent AND t."at" > g."offset" AND t."at" < g."offset" + g.child_n))
        GROUP BY parent, pattern_id, lo HAVING count(*) > 1) r WHERE "at" BETWEEN 1 AND length(r.parent) - 1
        AND NOT EXISTS (SELECT 1 FROM {t} t WHERE t.parent = r.parent AND t."at" = r."at")"""
    out = """, t0 AS MATERIALIZED (FROM (SELECT DISTINCT text AS parent, unnest([length(text) // 3, 2 * length(text) // 3])::INT AS "at" FROM corpus) WHERE "at" > 0)"""
    for k in range(rounds):
        out += f""", i{k} AS MATERIALIZED ({inner.format(t=f"t{k}")}),
      t{k + 1} AS MATERIALIZED (FROM t0 UNION SELECT child, (s."at" - "offset")::INT FROM grammar g JOIN (FROM t{k} UNION FROM i{k}) s ON s.parent = g.parent AND s."at" > "offset" AND s."at" < "offset" + child_n)"""
    return out + f""" SELECT parent, "at", TRUE AS top FROM t{rounds} UNION ALL SELECT parent, "at"::INT, FALSE FROM ({inner.format(t=f"t{rounds}")})"""


SQL = {
    "insert_texts": _GROWN + "SELECT ngram, n, kind FROM labels",
    "insert_grammar": _GROWN_GRAMMAR + "SELECT * FROM grammar",
    "rule_union": _with("labels", "edges", "grammar") + """, first AS (SELECT DISTINCT parent, list("offset" ORDER BY "offset") AS b FROM grammar WHERE "offset" > 0 GROUP BY parent, pattern_id),
      second AS (SELECT DISTINCT parent, ["offset"] AS b FROM edges WHERE "offset" > 0 AND parent IN (SELECT ngram FROM labels))
      SELECT parent, array_to_string(b, ',') AS bounds, 'first' AS given FROM first UNION ALL
      SELECT parent, array_to_string(b, ','), 'second' FROM second s WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.parent = s.parent AND list_has_all(s.b, f.b))""",
    "example_graphs": f"""WITH rules(graph, parent, pattern_id, cells) AS (VALUES {_EXAMPLES}), c AS (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM rules)
      SELECT graph, parent, pattern_id, (i - 1)::INT AS sub_index, length(array_to_string(cells[1:i - 1], ''))::INT AS "offset", cells[i] AS child, length(cells[i])::INT AS child_n FROM c""",
    "graph_of_names": _with("corpus") + """, rules AS (SELECT text AS parent, 0 AS pattern_id, regexp_extract_all(text, '[^ ]+| ') AS cells FROM corpus
        UNION ALL SELECT text, 1, [left(text, strpos(text, ' ')), substring(text, strpos(text, ' ') + 1)] FROM corpus WHERE strpos(text, ' ') > 1 AND strpos(text, ' ') < length(text)),
      c AS (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM rules)
      SELECT parent, pattern_id, (i - 1)::INT AS sub_index, length(array_to_string(cells[1:i - 1], ''))::INT AS "offset", cells[i] AS child, length(cells[i])::INT AS child_n FROM c""",
    "vocab_widest_first": _with("vocab") + "SELECT ngram, n, cnt FROM vocab ORDER BY n DESC, ngram",
    "most_frequent_ngrams": _with("vocab") + "SELECT ngram, n, cnt FROM vocab ORDER BY cnt DESC, ngram",
    "shared_ngrams": _with("vocab", "queries") + """SELECT ngram, n, cnt FROM vocab WHERE ngram IN (SELECT substring(query, pos + 1, n) FROM
      (SELECT *, unnest(range(1, length(query) - pos + 1)) AS n FROM (SELECT query, unnest(range(0, length(query))) AS pos FROM queries)))""",
    "ngram_occurrences": _with("occ") + "SELECT text_id, pos, n, ngram FROM occ",
    "occurrence_context": _with("occ") + """SELECT text_id, pos, n, ngram, CASE WHEN pos > 0 THEN substring(text, pos, 1) END AS prev,
      CASE WHEN pos + n < length(text) THEN substring(text, pos + n + 1, 1) END AS next FROM occ""",
    "ngram_counts_all": _with("vocab") + "SELECT ngram, n, cnt FROM vocab",
    "ngram_counts_bounded9": _with("vocab") + "SELECT ngram, n, cnt FROM vocab WHERE n <= 9",
    "document_ngram_counts": """WITH d AS MATERIALIZED (SELECT string_split(text, '') AS c FROM documents WHERE length(text) > 0)
      SELECT ngram, length(ngram)::INT AS n, count(*) AS cnt FROM (SELECT unnest(c) AS ngram FROM d
      UNION ALL SELECT unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) FROM d
      UNION ALL SELECT unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) FROM d) GROUP BY ngram""",
    "repeated_ngrams": _with("vocab") + "SELECT ngram, n, cnt FROM vocab WHERE cnt > 1",
    "count_histogram": _with("vocab") + "SELECT cnt, count(*) AS ngrams FROM vocab GROUP BY cnt",
    "corpus_statistics": "SELECT count(*) AS texts, sum(length(text))::BIGINT AS characters, max(length(text)) AS longest, max(strlen(text)) AS longest_bytes FROM documents WHERE length(text) > 0",
    "vocab_roots_leaves": _with("vocab") + "SELECT ngram, n, cnt, is_root, is_leaf FROM vocab",
    "first_seen_roots": _with("occ") + "SELECT ngram, n FROM (SELECT *, row_number() OVER (PARTITION BY ngram ORDER BY text_id, pos) AS r FROM occ) WHERE r = 1 AND n = length(text)",
    "containment_edges": _with("edges") + "SELECT * FROM edges",
    "bottom_up_neighbours": _with("edges") + "SELECT DISTINCT child, parent FROM edges WHERE parent_n = child_n + 1",
    "node_degree": _with("edges") + """SELECT coalesce(u.node, d.node) AS node, coalesce(parents, 0) AS parents, coalesce(children, 0) AS children, coalesce(patterns, 0) AS patterns FROM
      (SELECT child AS node, count(DISTINCT parent) AS parents FROM edges GROUP BY 1) u FULL JOIN
      (SELECT parent AS node, count(DISTINCT child) AS children, count(DISTINCT pattern_id) AS patterns FROM edges GROUP BY 1) d ON u.node = d.node""",
    "nodes_by_width": _with("vocab") + "SELECT n, count(*) AS nodes, sum(cnt)::BIGINT AS occurrences FROM vocab GROUP BY n",
    "edge_offsets": _with("edges") + """SELECT parent, child, string_agg("offset"::VARCHAR, ',' ORDER BY "offset") AS offsets FROM (SELECT DISTINCT parent, child, "offset" FROM edges) GROUP BY parent, child""",
    "frequency_labels": _with("closed") + "SELECT ngram, n, cnt FROM closed WHERE n > 1 AND NOT is_root",
    "wrapper_labels": _with("wrap") + "SELECT ngram, n FROM wrap",
    "all_labels": _with("labels") + "SELECT * FROM labels",
    "child_cover": _with("cover") + "SELECT * FROM cover",
    "cover_overlaps": _with("cover") + """SELECT x.parent, x."offset" AS a, y."offset" AS b FROM cover x JOIN cover y ON x.parent = y.parent AND x."offset" < y."offset" AND y."offset" < x."offset" + x.child_n""",
    "cover_hull": _with("cover") + """SELECT parent, min("offset") AS start, max("offset" + child_n) AS "end" FROM cover GROUP BY parent""",
    "partition_static": _with("grammar") + "SELECT * FROM grammar",
    "partition_offsets": _with("grammar") + """SELECT parent, pattern_id, sub_index, "offset", child FROM grammar""",
    "partition_cells": _with("grammar") + "SELECT parent, pattern_id, sub_index, child || '(' || length(child) || ')' AS cell FROM grammar",
    "digrams": _with("grammar") + """SELECT x.child AS "left", y.child AS "right", count(*) AS patterns FROM grammar x JOIN grammar y ON x.parent = y.parent AND x.pattern_id = y.pattern_id AND y.sub_index = x.sub_index + 1 GROUP BY 1, 2""",
    "pattern_splits": _with("grammar") + """SELECT g.parent, (length(parent) // 2)::INT AS at, pattern_id, sub_index, (length(parent) // 2 - "offset")::INT AS "inner", length(parent) // 2 = "offset" AS perfect
      FROM grammar g WHERE "offset" <= length(parent) // 2 AND length(parent) // 2 < "offset" + child_n""",
    "completed_splits": _with("grammar") + _completed(16),
    "joined_partitions": _with("grammar") + """, cut AS (SELECT parent, (length(parent) // 2)::INT AS "at", TRUE AS top FROM grammar UNION SELECT parent, "offset", FALSE FROM grammar WHERE "offset" > 0),
      borders AS (SELECT parent, "at" FROM cut UNION SELECT parent, 0 FROM cut UNION SELECT parent, length(parent)::INT FROM cut)
      SELECT a.parent, a."at" AS lo, b."at" AS hi, substring(a.parent, a."at" + 1, b."at" - a."at") AS part FROM borders a JOIN borders b ON a.parent = b.parent AND a."at" < b."at"
      WHERE EXISTS (SELECT 1 FROM cut t WHERE t.top AND t.parent = a.parent AND (a."at" >= t."at" OR b."at" <= t."at"))""",
    "reconstruct_texts": _with("corpus") + "SELECT text, text AS spelled FROM corpus",
    "grammar_nodes": _with("grammar") + "SELECT DISTINCT node, length(node)::INT AS n FROM (SELECT parent AS node FROM grammar UNION ALL SELECT child FROM grammar)",
    "grammar_edges": _with("grammar") + "SELECT DISTINCT parent, child FROM grammar",
    "count_propagation": _with("vocab") + "SELECT ngram, n, cnt FROM vocab",
    "search_largest_prefix": _with("prefix") + """SELECT query, left(query, n) AS "match", n, substring(query, n + 1) AS remainder FROM prefix""",
    "search_root": _with("prefix", "labels") + _ROOT,
    "search_trace": _with("prefix", "labels", "edges").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", roots AS (SELECT *, strpos(root, "match") - 1 AS s FROM ({_ROOT})),
      step AS (SELECT DISTINCT child, parent, "offset" FROM edges WHERE parent_n = child_n + 1 AND ("offset" = 0 AND left(parent, child_n) = child OR "offset" = 1 AND right(parent, child_n) = child)),
      walk AS (SELECT query, root, s, "match" AS node, 0 AS before, NULL::VARCHAR AS came, 0 AS dist FROM roots
        UNION SELECT w.query, w.root, w.s, t.parent, w.before + t."offset", w.node, w.before FROM walk w JOIN step t ON t.child = w.node
          AND w.s >= w.before + t."offset" AND substring(w.root, w.s - w.before - t."offset" + 1, length(t.parent)) = t.parent),
      found AS (SELECT query, came AS "from", node AS "to", 'up' AS dir, dist FROM walk WHERE came IS NOT NULL
        UNION SELECT query, left("match", k), left("match", k + 1), 'up', 0 FROM (SELECT *, unnest(range(1, length("match"))) AS k FROM roots)
        UNION SELECT query, left(root, k), left(root, k - 1), 'down', -s FROM (SELECT *, unnest(range(s + length("match") + 1, length(root) + 1)) AS k FROM roots)
        UNION SELECT query, left(root, s + length("match")), right("match", 1), 'down', length("match") - 1 FROM roots WHERE s + length("match") > 1)
      SELECT query, "from", "to", dir, dist::INT AS dist FROM found""",
    "read_decomposition": _with("queries", "labels") + """, hit AS (SELECT query, pos::INT AS "offset", max(w)::INT AS n FROM (SELECT *, unnest(range(1, length(query) - pos + 1)) AS w FROM
        (SELECT query, unnest(range(0, length(query))) AS pos FROM queries)) WHERE substring(query, pos + 1, w) IN (SELECT ngram FROM labels) GROUP BY 1, 2)
      SELECT query, "offset", substring(query, "offset" + 1, n) AS ngram, n FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE b.query = a.query AND b."offset" < a."offset" AND b."offset" + b.n >= a."offset" + a.n)""",
    "unknown_blocks": _with("queries", "vocab") + """SELECT query, min(pos)::INT AS start, count(*) AS length, known FROM (SELECT *, pos - row_number() OVER (PARTITION BY query, known ORDER BY pos) AS island FROM
      (SELECT query, pos, substring(query, pos + 1, 1) IN (SELECT ngram FROM vocab WHERE n = 1) AS known FROM (SELECT query, unnest(range(0, length(query))) AS pos FROM queries))) GROUP BY query, known, island""",
    "match_patterns": _with("prefix") + """SELECT query, left(query, n) AS "match", CASE WHEN n = length(query) THEN 'exact' ELSE 'remainder_a' END AS kind, substring(query, n + 1) AS rest FROM prefix""",
    "neighbourhood": _with("grammar") + "SELECT DISTINCT child AS node, 'up' AS direction, parent AS neighbour FROM grammar UNION ALL SELECT DISTINCT parent, 'down', child FROM grammar",
    "cond_prob": _with("vocab") + "SELECT v.ngram AS v, x.ngram AS x, round(x.cnt / v.cnt, 6) AS p FROM vocab x JOIN vocab v ON v.n < x.n AND left(x.ngram, v.n) = v.ngram",
    "prob_within_n": _with("vocab") + "SELECT ngram, n, round(cnt / sum(cnt) OVER (PARTITION BY n), 6) AS p FROM vocab",
    "next_token": _with("nexts") + "SELECT v, w, round(p, 6) AS p FROM nexts",
    "most_likely_next": _with("nexts") + "SELECT v, w, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY p DESC, w) AS r FROM nexts) WHERE r = 1",
    "backoff": _with("nexts", "queries") + """, used AS (SELECT query, max(k) AS k FROM (SELECT query, unnest(range(1, length(query) + 1)) AS k FROM queries) WHERE right(query, k) IN (SELECT v FROM nexts) GROUP BY query)
      SELECT query AS context, right(query, k) AS used, w, round(p, 6) AS p FROM used JOIN nexts ON v = right(query, k)""",
    "node_contexts": _with("vocab", "labels") + "SELECT v.ngram AS node, l.ngram AS context FROM vocab v JOIN labels l ON contains(l.ngram, v.ngram) AND l.ngram <> v.ngram",
    "similarity": _with("sib") + "SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM sib",
    "semantic_distance": _with("sib") + """, up AS (SELECT DISTINCT child, parent FROM grammar)
      SELECT a, b, round(avg(d), 6) AS distance FROM (SELECT a, b, x.parent, min(levenshtein(x.parent, y.parent)) AS d FROM sib JOIN up x ON x.child = a JOIN up y ON y.child = b GROUP BY a, b, x.parent) GROUP BY a, b""",
    "word_ngrams": r"""WITH w AS (SELECT regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS c FROM documents WHERE text IS NOT NULL)
      SELECT gram, n::INT AS n, count(*) AS cnt FROM (SELECT unnest(c) AS gram, 1 AS n FROM w UNION ALL
      SELECT c[i] || ' ' || c[i + 1], 2 FROM (SELECT c, unnest(range(1, len(c))) AS i FROM w)) GROUP BY gram, n HAVING count(*) > 1""",
    "event_ngrams": """WITH s AS (SELECT list(event_type ORDER BY ts, event_id) AS c FROM events GROUP BY user_id)
      SELECT array_to_string(c[i:i + n - 1], ' ') AS gram, n::INT AS n, count(*) AS cnt FROM (SELECT *, unnest(range(1, least(3, len(c) - i + 1) + 1)) AS n FROM (SELECT c, unnest(range(1, len(c) + 1)) AS i FROM s)) GROUP BY 1, 2""",
    "scalar_functions": _with("corpus") + """SELECT text, strlen(text)::INT AS bytes, left(text, 1) AS first, CASE WHEN length(text) > 8 THEN left(text, 5) || '...' ELSE text END AS short,
      base64(encode(text)) AS b64, text AS back, length(text)::INT AS chars, round(100.0::DOUBLE * length(text) / 12, 6) AS percent FROM corpus""",
    "streaming_labels": _with("base") + "SELECT * FROM base",
    "joined_patterns": _with("grammar") + _CUT + """, rules AS (SELECT substring(r.parent, lo + 1, hi - lo) AS node, [c."at" - lo] AS b FROM ranges r JOIN cut c ON c.parent = r.parent AND lo < c."at" AND c."at" < hi
        UNION SELECT parent, ["at"] FROM cut WHERE top
        UNION SELECT substring(r.parent, lo + 1, hi - lo), list_sort(list_distinct(list(g."offset" - lo) FILTER (g."offset" > lo AND g."offset" < hi))) FROM ranges r JOIN grammar g ON g.parent = r.parent
          WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.parent = r.parent AND lo < c."at" AND c."at" < hi) GROUP BY r.parent, lo, hi, g.pattern_id HAVING count(*) FILTER (g."offset" > lo AND g."offset" < hi) > 0),
      numbered AS (SELECT node, [0] || b || [length(node)] AS e, row_number() OVER (PARTITION BY node ORDER BY b) - 1 AS pattern_id FROM rules),
      cells AS (SELECT *, unnest(range(1, len(e))) AS i FROM numbered)
      SELECT node AS parent, pattern_id::INT AS pattern_id, (i - 1)::INT AS sub_index, e[i]::INT AS "offset", substring(node, e[i] + 1, e[i + 1] - e[i]) AS child, (e[i + 1] - e[i])::INT AS child_n FROM cells""",
    "read_sequences": _with("queries", "labels") + _read(6),
    "document_short_labels": """WITH d AS MATERIALIZED (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0),
      p AS (SELECT doc_id, unnest(c) AS ch, unnest(range(len(c))) AS i FROM d),
      o AS (SELECT lag(ch) OVER t AS prev, concat(ch, lead(ch, 1) OVER t, lead(ch, 2) OVER t, lead(ch, 3) OVER t, lead(ch, 4) OVER t, lead(ch, 5) OVER t, lead(ch, 6) OVER t, lead(ch, 7) OVER t, lead(ch, 8) OVER t) AS w,
        lead(ch, 9) OVER t AS far FROM p WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
      s AS (SELECT left(w, n) AS ngram, n, count(*) AS cnt, count(prev) AS pc, min(prev) AS pl, max(prev) AS pm, count(nx) AS nc, min(nx) AS nl, max(nx) AS nm FROM
        (SELECT w, n, prev, CASE WHEN n = 9 THEN far WHEN n < length(w) THEN substring(w, n + 1, 1) END AS nx FROM (SELECT *, unnest(range(2, length(w) + 1)) AS n FROM o)) GROUP BY left(w, n), n)
      SELECT ngram, n::INT AS n, cnt FROM s WHERE cnt > 1 AND NOT coalesce(pc = cnt AND pl = pm, FALSE) AND NOT coalesce(nc = cnt AND nl = nm, FALSE)""",
    "document_spelling": "SELECT doc_id, md5(text) AS digest FROM documents WHERE length(text) > 1",
    "parsed_types": _with("queries") + "SELECT query AS text, query AS spelled FROM queries WHERE length(query) > 1",
    "wrapper_ranges": _with("li", "corpus") + """, spans AS (SELECT DISTINCT a.text_id, a.s, b.e FROM (SELECT DISTINCT text_id, s FROM li) a JOIN (SELECT DISTINCT text_id, e FROM li) b ON a.text_id = b.text_id AND b.e - a.s > 1
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT text_id, unnest(range(1, length(text))) AS x FROM corpus) i WHERE i.text_id = a.text_id AND i.x > a.s AND i.x < b.e
          AND NOT EXISTS (SELECT 1 FROM li l WHERE l.text_id = i.text_id AND l.s >= a.s AND l.e <= b.e AND l.s < i.x AND i.x < l.e)))
      SELECT text_id, s::INT AS s, min(e)::INT AS lo, max(e)::INT AS hi FROM (SELECT *, e - row_number() OVER (PARTITION BY text_id, s ORDER BY e) AS island FROM spans) GROUP BY text_id, s, island""",
    "ngram_postings": _with("occ") + """, x AS (SELECT ngram, text_id // 16 AS block, text_id % 16 AS t, pos, lag(text_id % 16) OVER w AS lt, lag(pos) OVER w AS lp FROM occ WINDOW w AS (PARTITION BY ngram, text_id // 16 ORDER BY text_id, pos))
      SELECT ngram, block, count(*) AS cnt, string_agg((t - coalesce(lt, 0))::VARCHAR, ',' ORDER BY t, pos) AS texts, string_agg((pos - CASE WHEN lt = t THEN lp ELSE 0 END)::VARCHAR, ',' ORDER BY t, pos) AS "at" FROM x GROUP BY ngram, block""",
    "search_places": _with("prefix", "occ") + """SELECT query, left(query, prefix.n) AS "match", text_id, pos FROM prefix JOIN occ ON ngram = left(query, prefix.n)""",
    "event_labels": _EVENTS + "SELECT gram, n, kind FROM base",
    "event_rules": _EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """, best AS MATERIALIZED (SELECT text_id, pos, max(n) AS n FROM occ WHERE ngram IN (SELECT ngram FROM base WHERE kind <> 'root') GROUP BY text_id, pos),
      walk AS (SELECT text_id, 0 AS pos, 0 AS i FROM corpus WHERE length(text) > 1 UNION ALL SELECT w.text_id, w.pos + b.n, w.i + 1 FROM walk w JOIN best b USING (text_id, pos) JOIN corpus c USING (text_id) WHERE w.pos + b.n < length(c.text))
      SELECT text_id AS user_id, i::INT AS sub_index, pos::INT AS "offset", array_to_string(names[pos + 1:pos + n], ' ') AS gram, n::INT AS n FROM walk JOIN best USING (text_id, pos) JOIN corpus USING (text_id)""",
    "streaming_counts": _with("vocab") + "SELECT ngram, n, cnt FROM vocab",
}
