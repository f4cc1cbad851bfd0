"""Reference SQL of the conversation and suffix operators, for an engine without crc32: it is spelled out in lists."""

_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
)"""


def _crc(text: str) -> str:
    """crc32 of an ASCII text, given crc_table's t."""
    bytes_of = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({bytes_of}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


REPAIR = f"""
WITH RECURSIVE {_TABLE},
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(k)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
),
judged AS (
  SELECT conv_id, turn, role, text, rn, left(role, 1) AS initial, before, bare = '' AS blank, bare <> '' AND later AS duplicate,
         bare <> '' AND NOT later AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS later FROM placed)
),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(rn) AS n
  FROM judged GROUP BY conv_id
),
put(q, q1, letters, price, lines) AS (
  VALUES ('', '', '', 0, CAST([] AS VARCHAR[])), ('', 'u', 'I', 5, ['user:']), ('', 'a', 'II', 10, ['user:', 'assistant:']),
         ('s', 's', '', 0, []), ('s', 'u', 'I', 5, ['user:']), ('s', 'a', 'II', 10, ['user:', 'assistant:']),
         ('u', 'u', '', 0, []), ('u', 'a', 'I', 5, ['assistant:']), ('u', 'u', 'II', 10, ['assistant:', 'user:']),
         ('a', 'a', '', 0, []), ('a', 'u', 'I', 5, ['user:']), ('a', 'a', 'II', 10, ['user:', 'assistant:'])
),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM faults
  UNION ALL
  SELECT conv_id, i, q, min(cost), arg_min(audit, (cost, audit)), arg_min(lines, (cost, audit))
  FROM (
    SELECT b.conv_id, j.rn AS i, e.letter,
           CASE e.letter WHEN 'D' THEN p.q1 WHEN 'K' THEN j.initial ELSE CASE p.q1 WHEN 'u' THEN 'a' ELSE 'u' END END AS q,
           b.cost + p.price + CASE e.letter WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END
             + CASE WHEN e.letter <> 'D' AND j.truncated THEN 5 ELSE 0 END AS cost,
           b.audit || p.letters || e.letter AS audit,
           b.lines || p.lines || CASE e.letter WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [j.role || ':' || j.text]
             ELSE [CASE p.q1 WHEN 'u' THEN 'assistant:' ELSE 'user:' END || j.text] END AS lines
    FROM best b
    JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.rn = b.i + 1
    JOIN put p ON p.q = b.q
    JOIN (VALUES ('D'), ('K'), ('R')) AS e(letter)
      ON e.letter = 'D' OR NOT (j.blank OR j.duplicate) AND (e.letter = 'R' OR j.initial = 's' AND p.q1 = ''
         OR j.initial = 'u' AND p.q1 <> 'u' OR j.initial = 'a' AND p.q1 = 'u')
  )
  GROUP BY conv_id, i, q
),
ended AS (
  SELECT b.conv_id, min(b.cost + p.price) AS cost, arg_min(b.audit || p.letters, (b.cost + p.price, b.audit || p.letters)) AS audit,
         arg_min(b.lines || p.lines, (b.cost + p.price, b.audit || p.letters)) AS lines
  FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.i JOIN put p ON p.q = b.q AND p.q1 IN ('', 'a')
  GROUP BY b.conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

TRIE = f"""
WITH {_TABLE},
own AS (
  SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
plan AS (
  SELECT f.c, f.h, f.c - f.c % 5 AS giver, least(f.h, coalesce(g.n, 0)) AS taken
  FROM (SELECT c, {_crc("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT c FROM own), crc_table) f
  LEFT JOIN (SELECT c, count(*) AS n FROM own GROUP BY c) g ON g.c = f.c - f.c % 5
),
whole AS (
  SELECT p.c, o.i, o.role, o.text FROM plan p JOIN own o ON o.c = p.giver AND o.i < p.taken
  UNION ALL
  SELECT p.c, o.i - p.h + p.taken, o.role, o.text FROM plan p JOIN own o ON o.c = p.c AND o.i >= p.h
),
chained AS (
  SELECT c, i + 1 AS depth, octet_length(encode(text)) AS size,
         array_to_string(list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY i), '') AS path
  FROM whole
),
member AS (
  SELECT c, depth, size, sha256(path) AS path FROM chained
  UNION ALL
  SELECT c, 0, 0, '' FROM plan
),
node AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n, max(size) AS size FROM member GROUP BY depth, path),
line AS (SELECT m.c, n.depth, n.path, n.conv_id FROM member m JOIN node n USING (depth, path)),
child AS (
  SELECT n.*, u.conv_id AS parent FROM node n LEFT JOIN line u ON u.c = n.conv_id AND u.depth = n.depth - 1
),
kids AS (SELECT depth - 1 AS depth, parent AS conv_id, count(*) AS k FROM child WHERE depth > 0 GROUP BY ALL),
valued AS (
  SELECT n.*, coalesce(k, 0) AS k, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf, (n.n - 1) * n.size AS saving
  FROM child n LEFT JOIN kids USING (depth, conv_id)
),
below AS (
  SELECT a.depth, a.conv_id, sum(v.leaf) AS leaves, sum(v.saving) AS saved
  FROM valued v JOIN line a ON a.c = v.conv_id AND a.depth <= v.depth GROUP BY ALL
),
ends AS (
  SELECT l.depth, l.conv_id, string_agg(CAST(l.c AS VARCHAR), ',' ORDER BY l.c) AS ids
  FROM line l JOIN (SELECT c, max(depth) AS depth FROM member GROUP BY c) USING (c, depth) GROUP BY ALL
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, v.parent AS parent_conv_id, v.n AS n_convs, v.k AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM valued v JOIN below b USING (depth, conv_id) LEFT JOIN ends e USING (depth, conv_id)
"""

SUFFIXES = """
WITH d AS (SELECT doc_id, row_number() OVER () AS k, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT k, p, md5(array_slice(b, p, p + 199)) AS h FROM (SELECT k, b, unnest(range(1, octet_length(b) - 198)) AS p FROM d)),
again AS (SELECT k, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT *, p - lag(p) OVER (PARTITION BY k ORDER BY p) AS gap FROM again),
numbered AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > 200) OVER (PARTITION BY k ORDER BY p) AS s FROM marked),
span AS (SELECT k, s, min(p) AS a, max(p) + 199 AS z FROM numbered GROUP BY k, s),
listed AS (SELECT k, count(*) AS n, sum(z - a + 1) AS removed, list(a ORDER BY a) AS firsts, list(z ORDER BY a) AS lasts FROM span GROUP BY k)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       CASE WHEN n IS NULL THEN sha256(b)
       ELSE sha256(unhex(array_to_string(list_transform(range(n + 1),
         lambda i: hex(array_slice(b, CASE i WHEN 0 THEN 1 ELSE lasts[i] + 1 END, CASE i WHEN n THEN octet_length(b) ELSE firsts[i + 1] - 1 END))), '')))
       END AS kept_sha256
FROM d LEFT JOIN listed USING (k)
"""
