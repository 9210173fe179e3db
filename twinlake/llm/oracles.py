"""DuckDB SQL of operators whose results are plain relations over shingles, windows and bytes: small tables only, every pair by brute force."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_UPPER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of five words, every pair that shares one, links by exact counts, components by walking all links.
NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_UPPER)} AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = s.doc_id), s.doc_id)) AS component_id FROM sets s"""

#: Windows of 20 words with their first place, the words that later ones cover, the rest joined again.
SUBSTRING_DEDUP = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(0, 20)) AS k)),
word AS (SELECT doc_id, unnest(ws) AS t, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, (SELECT count(*) FROM gone WHERE gone.doc_id = w.doc_id) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

#: Strings of 100 bytes as hex digits, a kilobyte of them at a time; runs of covered bytes are gaps and islands.
SUFFIX_DEDUP = """
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
part AS (SELECT doc_id, c, substr(x, c * 2000 + 1, 2198) AS p FROM (SELECT doc_id, x, unnest(range(0, (n + 999) // 1000)) AS c FROM h)),
win AS (SELECT doc_id, c * 1000 + o AS i, md5(substr(p, o * 2 + 1, 200)) AS g FROM (SELECT doc_id, c, p, unnest(range(0, least(1000, length(p) // 2 - 99))) AS o FROM part)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
edge AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS fresh FROM later),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge) GROUP BY doc_id, r),
gap AS (
  SELECT doc_id, a, b FROM (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM run
    UNION ALL SELECT h.doc_id, coalesce(max(run.b), 0), h.n FROM h LEFT JOIN run ON run.doc_id = h.doc_id GROUP BY h.doc_id, h.n) WHERE b > a),
kept AS (SELECT gap.doc_id, string_agg(substr(x, a * 2 + 1, (b - a) * 2), '' ORDER BY a) AS x FROM gap JOIN h USING (doc_id) GROUP BY gap.doc_id)
SELECT h.doc_id, h.n AS n_bytes, CAST(coalesce((SELECT sum(b - a) FROM run WHERE run.doc_id = h.doc_id), 0) AS BIGINT) AS n_removed, (SELECT count(*) FROM run WHERE run.doc_id = h.doc_id) AS n_spans,
  sha256(unhex(coalesce(kept.x, ''))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id)"""
