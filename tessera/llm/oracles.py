"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

PROBE = "<|im_end|><|im_start|>assistant ok"

CHAT = f"""WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
  placed AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
      sum(24 + length(role) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
  examples AS (SELECT *, role = 'assistant' OR n = total AS ends FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
  CAST(sum(CASE WHEN ends THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars, CAST(sum(CASE WHEN ends THEN 1 ELSE 0 END) AS BIGINT) AS n_examples
FROM examples GROUP BY conv_id"""

VECTOR_LINKS = """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL),
  fit AS (SELECT * FROM e WHERE v IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(v, v) > 0),
  links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98),
  reach(x, y) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
  n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(reach.y) AS component_id, e.vec_id = min(reach.y) AS kept
FROM e JOIN reach ON reach.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id GROUP BY e.vec_id"""

NEAR_DUPLICATES = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
  grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS g FROM w),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT x, y FROM common JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * c >= 90 * (sx.n + sy.n - c)),
  reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT w.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(reach.y) AS component_id
FROM w JOIN reach ON reach.x = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id"""

FILTER_AUDIT = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM d),
  m AS (SELECT doc_id, part, CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
      + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
      + 16 * CAST(coalesce(again, false) AS INT) AS mask FROM w),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
  c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
  f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
  o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM f p JOIN f q ON q.x <> p.x JOIN f r ON r.x NOT IN (p.x, q.x)
    JOIN f s ON s.x NOT IN (p.x, q.x, r.x) JOIN f t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
  steps AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) k(step)),
  r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

PREFIX_TRIE = """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
    FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))) AS crc FROM (SELECT DISTINCT conv_id FROM t)),
  h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM c),
  turns AS (SELECT h.conv_id, 0 AS own, t.n, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.n <= h.h
    UNION ALL SELECT h.conv_id, 1, t.n, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.n > h.h),
  whole AS (SELECT h.conv_id, coalesce(r.turns, []) AS turns FROM h LEFT JOIN (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY own, n) AS turns FROM turns GROUP BY conv_id) r USING (conv_id)),
  ways AS (SELECT conv_id, d AS depth, turns[1:d] AS k, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
  nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ended,
      (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(k[depth].text) END AS saved FROM ways GROUP BY k, depth),
  kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
  sized AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.k = nodes.k),
  above AS (SELECT k[1:a] AS k, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM sized)),
  sums AS (SELECT k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY k)
SELECT s.conv_id, s.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children::BIGINT AS n_children, sums.n_leaves, sums.saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(s.ended, '')) AS ends_sha256
FROM sized s JOIN sums ON sums.k = s.k LEFT JOIN nodes p ON s.depth > 0 AND p.k = s.k[1:s.depth - 1]"""
