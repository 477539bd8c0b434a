"""DuckDB SQL with the rows of those queries that SQL can express: secrets, near duplicates, vectors, substrings, top-k."""

from __future__ import annotations

from .secrets import ALLOWED, ALPHABET, CLASSES, ENTROPY, RULES, WINDOW

WORDS = r"'[^\x20\x09-\x0D]+'"


def components_sql(links: str, nodes: str) -> str:
    """CTEs ``reach`` and ``part`` (node, component): the least node that links (a, b), given both ways, lead to."""
    return f"""reach AS (
  SELECT node, node AS other FROM {nodes}
  UNION SELECT r.node, l.b FROM reach r JOIN {links} l ON r.other = l.a),
part AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


def _base_sql(number: int) -> str:
    """SELECT of one base kind's spans: matches and the gaps between them alternate."""
    rule = RULES[number]
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, start, {number} AS kind_no, start + length(whole) AS stop, '{rule.kind}' AS kind FROM (
    SELECT doc_id, whole, part, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY k) - length(whole) AS start FROM (
      SELECT doc_id, unnest(range(1, len(wholes) + 1)) AS k, unnest(gaps[1:len(wholes)]) AS gap, unnest(wholes) AS whole, unnest(parts) AS part FROM (
        SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS wholes,
               regexp_extract_all(t, '{pattern}', {rule.group}) AS parts FROM texts)))
  WHERE length(part) >= {rule.least}"""


def secrets_sql() -> str:
    letters = "[" + ALPHABET.replace("-", "") + "-]"
    run = f"{letters}{{{WINDOW},}}"
    least = " ".join(f"WHEN regexp_matches(part, '{p}') THEN {x}" for p, x in CLASSES[:-1])
    counts = ", ".join(f"CAST(count(kind) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in RULES)
    named = "coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind_no, stop)"
    bases = "\n  UNION ALL ".join(_base_sql(k) for k in range(len(RULES)))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({bases}),
runs AS (
  SELECT doc_id, k, part, sum(length(gap) + length(part)) OVER (PARTITION BY doc_id ORDER BY k) - length(part) AS start FROM (
    SELECT doc_id, unnest(range(1, len(parts) + 1)) AS k, unnest(gaps[1:len(parts)]) AS gap, unnest(parts) AS part FROM (
      SELECT doc_id, regexp_split_to_array(t, '{run}') AS gaps, regexp_extract_all(t, '{run}', 0) AS parts FROM texts))),
mixed AS (
  SELECT *, CASE {least} ELSE {CLASSES[-1][1]} END AS least FROM runs
  WHERE regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z]')),
windows AS (SELECT doc_id, k, start, part, least, unnest(range(1, length(part) - {WINDOW - 2})) AS i FROM mixed),
letters AS (SELECT doc_id, k, i, unnest(string_split(substr(part, i, {WINDOW}), '')) AS c FROM windows),
counted AS (SELECT doc_id, k, i, c, count(*) AS n FROM letters GROUP BY ALL),
entropy AS (SELECT doc_id, k, i, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS bits FROM counted GROUP BY ALL),
hits AS (
  SELECT doc_id, k, start + min(i) - 1 AS start, start + max(i) - 1 + {WINDOW} AS stop,
         substr(part, min(i), max(i) - min(i) + {WINDOW}) AS span
  FROM windows JOIN entropy USING (doc_id, k, i) WHERE bits >= least GROUP BY doc_id, k, start, part),
found AS (
  SELECT * FROM base
  UNION ALL SELECT doc_id, start, {len(RULES)}, stop, '{ENTROPY}' FROM hits h
  WHERE NOT regexp_matches(span, '{ALLOWED}')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.start <= h.start AND h.stop <= b.stop))
SELECT d.doc_id, {counts},
       sha256({named} FILTER (kind <> '{ENTROPY}'), '')) AS base_sha256, {named}, '') AS spans
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)
  UNION SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS node FROM documents),
{components_sql("links", "nodes")}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component AS component_id, d.doc_id = component AS kept
FROM documents d JOIN part ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""

NEAR_VECTORS = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS (
  SELECT vec_id, v FROM vectors
  WHERE len(v) = 64 AND list_count(v) = 64 AND isfinite(list_sum(v)) AND (list_min(v) < 0 OR list_max(v) > 0)),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id
  WHERE list_inner_product(x.v, y.v) >= 0.95 * sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))),
nodes AS (SELECT vec_id AS node FROM embeddings),
{components_sql("links", "nodes")}
SELECT e.vec_id, CAST((SELECT count(*) FROM links WHERE a = e.vec_id) AS BIGINT) AS n_links, component AS component_id, e.vec_id = component AS kept
FROM embeddings e JOIN part ON node = e.vec_id"""

SUBSTRINGS = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
firsts AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM firsts WHERE k > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""

TOP_K = """
WITH sound AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding))),
whole AS (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(floor(256.0 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM sound),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": secrets_sql(),
        "op5_minhash": NEAR_DUPLICATES,
        "op6_embeddings": NEAR_VECTORS,
        "op7_substrings": SUBSTRINGS,
        "op10_topk": TOP_K,
    }
