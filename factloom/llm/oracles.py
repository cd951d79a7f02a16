"""SQL of the queries on conversations and on resampling."""

from __future__ import annotations


def crc32(codes: str) -> str:
    """crc32 of a list of byte values, bit by bit."""
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: "
        "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    )


def _after(state: str, cost: str, letters: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'w': {state}.w || {letters}}} END"


def _kept(initial: str, *states: str) -> str:
    """The least way to a turn that stays as this role, from any of the states; (i) marks one with an insertion before."""
    late = "CASE WHEN fault = 't' THEN 3 ELSE 0 END"
    ways = [_after(s[0], f"{late} + CASE WHEN ini = '{initial}' THEN 0 ELSE 3 END + {3 if s[1:] else 0}", f"'{'I' if s[1:] else ''}' || CASE WHEN ini = '{initial}' THEN 'K' ELSE 'R' END") for s in states]
    return ", ".join(f"CASE WHEN fault NOT IN ('b', 'd') THEN {w} END" for w in ways)


#: One row after another through four states; the letters of the least way are then put back on the rows.
REPAIR_SQL = rf"""
WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
f AS (SELECT *, {crc32("list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)")} % 20 AS hurt FROM z),
b AS (SELECT conv_id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role, CASE hurt WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN hurt = 3 THEN 2 ELSE 1 END)) FROM f WHERE hurt <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM b),
r AS (SELECT conv_id, turn, role, text, i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
d AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'w': ''}} AS e, NULL::STRUCT(c BIGINT, w VARCHAR) AS s, NULL::STRUCT(c BIGINT, w VARCHAR) AS u, NULL::STRUCT(c BIGINT, w VARCHAR) AS a FROM n
  UNION ALL SELECT d.conv_id, r.i, {_after("e", "4", "'D'")},
    list_min([{_after("s", "4", "'D'")}, CASE WHEN ini = 's' AND fault NOT IN ('b', 'd') THEN {_after("e", "CASE WHEN fault = 't' THEN 3 ELSE 0 END", "'K'")} END]),
    list_min([{_after("u", "4", "'D'")}, {_kept("u", "e", "s", "a", "u(i)")}]),
    list_min([{_after("a", "4", "'D'")}, {_kept("a", "u", "e(i)", "s(i)", "a(i)")}])
  FROM d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1),
w AS (SELECT n.*, list_min([e, a, {_after("u", "3", "'I'")}, {_after("s", "6", "'II'")}]) AS best FROM d JOIN n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.n = d.i),
l AS (SELECT conv_id, unnest(string_split(best.w, '')) AS x, generate_subscripts(string_split(best.w, ''), 1) AS p FROM w WHERE best.w <> ''),
m AS (SELECT *, count(*) FILTER (x <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (x <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS q FROM l),
t AS (SELECT m.conv_id, p, x, q, role, text, max(CASE WHEN q = 1 AND x = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS lead
  FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i),
h AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (q - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS made FROM t WHERE x <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.w, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""

#: Features as rows; each distinct string is hashed once.
RESAMPLE_SQL = rf"""
WITH words AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words),
c AS (SELECT side, r, g, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM c)),
b AS (SELECT g, {crc32("list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))")} % 10000 AS bucket FROM x),
t AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM c JOIN b USING (g) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((coalesce(t.s, 0) + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS gain FROM t, a),
m AS (SELECT r, sum(n) AS n, floor(sum(n * gain) / sum(n)) AS weight FROM c JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
s AS (SELECT doc_id, len(w) >= 20 AS fit, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN m USING (r) WHERE side = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (fit) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank FROM o
"""
