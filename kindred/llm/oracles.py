"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_near_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
    ) AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM split WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
  WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
), reach AS (
  SELECT doc_id, doc_id AS r FROM split
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT s.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM split s LEFT JOIN sizes n ON n.doc_id = s.doc_id
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""

ORACLES["op8_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM split WHERE len(ws) >= 35)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM again
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM split
)
SELECT s.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words,
  CAST(count(g.j) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(w.word, ' ' ORDER BY w.j) FILTER (WHERE g.j IS NULL), '')) AS kept_sha256
FROM split s LEFT JOIN words w ON w.doc_id = s.doc_id LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.j = w.j
GROUP BY s.doc_id, s.ws
"""

ORACLES["op9_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY place) AS rendered,
    array_agg({'r': role, 't': text} ORDER BY place) AS parts
  FROM turns GROUP BY conv_id
), one AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, rendered, parts FROM whole
  GROUP BY n_turns, rendered, parts
), inner_prefixes AS (
  SELECT DISTINCT parts[1:k] AS parts FROM (SELECT parts, unnest(range(1, n_turns)) AS k FROM whole WHERE n_turns > 1)
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies, rendered
FROM one WHERE parts NOT IN (SELECT parts FROM inner_prefixes)
"""

ORACLES["op11_ranked_search"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), items AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), wanted AS (
  SELECT item_id, t, count(*) AS times FROM items GROUP BY ALL
), totals AS (
  SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts)) AS big_l FROM split
), tf AS (
  SELECT doc_id, len(ts) AS n, t, count(*) AS tf
  FROM (SELECT doc_id, ts, unnest(ts) AS t FROM split) WHERE t IN (SELECT t FROM wanted) GROUP BY doc_id, len(ts), t
), weight AS (
  SELECT t, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, totals GROUP BY t, big_n
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS score
  FROM wanted JOIN tf USING (t) JOIN weight USING (t), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM ranked WHERE rank <= 20
"""
