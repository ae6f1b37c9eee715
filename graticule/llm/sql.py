"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

_SPACE = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
dup AS (SELECT doc_id, line, count(*) - 1 AS extra FROM l WHERE regexp_matches(line, '{_SPACE}') GROUP BY doc_id, line),
lines AS (SELECT doc_id, sum(extra)::BIGINT AS n, sum(extra * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS chars FROM dup GROUP BY doc_id),
g AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (5), (6), (8), (10)) v(k))),
r AS (SELECT doc_id, k, i FROM (SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, gram) AS c FROM g) WHERE c > 1),
p AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS pos FROM r),
c AS (SELECT p.doc_id, count(*) FILTER (k = 8) AS words,
        coalesce(sum(length(d.w[pos])) FILTER (k = 5), 0)::BIGINT AS c5, coalesce(sum(length(d.w[pos])) FILTER (k = 6), 0)::BIGINT AS c6,
        coalesce(sum(length(d.w[pos])) FILTER (k = 8), 0)::BIGINT AS c8, coalesce(sum(length(d.w[pos])) FILTER (k = 10), 0)::BIGINT AS c10
      FROM p JOIN d USING (doc_id) GROUP BY p.doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
        coalesce(words, 0)::BIGINT AS n_repeat_words, coalesce(lines.chars, 0) AS dup_line_chars, coalesce(c5, 0) AS dup_chars_5,
        coalesce(c6, 0) AS dup_chars_6, coalesce(c8, 0) AS dup_chars_8, coalesce(c10, 0) AS dup_chars_10
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT *, NOT (base_failed OR 100 * dup_chars_5 > 40 * word_chars OR 100 * dup_chars_6 > 38 * word_chars OR 100 * dup_chars_8 > 35 * word_chars
  OR 100 * dup_chars_10 > 30 * word_chars OR 100 * dup_line_chars > 40 * word_chars) AS kept FROM f
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
x AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, CAST(CAST(unhex(sha1(t)) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, (5 * i + 1)::BIGINT, 1)::INT + 8 * substr(bits, (5 * i + 2)::BIGINT, 1)::INT + 4 * substr(bits, (5 * i + 3)::BIGINT, 1)::INT
      + 2 * substr(bits, (5 * i + 4)::BIGINT, 1)::INT + substr(bits, (5 * i + 5)::BIGINT, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w2) AS m, array_to_string(w2, ' ') AS gram FROM (
  SELECT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS w2 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0))),
g AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS gram
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win))),
h AS (SELECT doc_id, i, g.m, item_id FROM g JOIN win ON g.m = win.m AND g.gram = win.gram),
pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_LOWERED_ALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED_ALL}, '{_SPACE}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
c AS (SELECT min(doc_id) AS id, list_sort(g) AS g, len(g) AS n FROM s GROUP BY ALL HAVING len(g) > 0),
e AS (SELECT id, n, unnest(g) AS gram FROM c),
p AS (SELECT a.id AS x, b.id AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM e a JOIN e b ON a.gram = b.gram AND a.id < b.id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * k >= 80 * (nx + ny - k)),
both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS id, x AS root FROM both_ways UNION SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.id AND r.root < b.y),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(least(m.root, c.id), c.id, s.doc_id) AS component_id, s.doc_id = coalesce(least(m.root, c.id), c.id, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN m ON m.id = c.id
"""

URL_FILTER = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS own FROM a),
u AS (SELECT row_number() OVER () AS k, page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(own) + 1), '^[^?#]*') AS path FROM b),
f AS (SELECT k, max({'n': length(r.host) + length(r.path), 'h': length(r.host), 'rule': r.host || r.path, 'verdict': r.verdict}) AS best
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY k)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (k)
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    return (
        f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"
    )


CONVERSATION_TRIE = f"""
WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns,
  {_crc32("conv_id::VARCHAR")} % 6 AS h FROM conversations GROUP BY conv_id),
r AS (SELECT a.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, a.h), list_slice(a.turns, a.h + 1, len(a.turns))) AS turns FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns,
  list_transform(turns, lambda t: sha256(length(t.role) || ':' || t.role || t.text)) AS hashes FROM r),
m AS (SELECT conv_id, n, depth, array_to_string(hashes[1:depth], '') AS path, CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].text) END AS chars FROM p),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY path, depth),
kids AS (SELECT substr(path, 1, 64 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
up AS (SELECT substr(n.path, 1, 64 * d) AS path, (n.n_convs - 1) * n.chars AS saved, kids.path IS NULL AS leaf
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) n LEFT JOIN kids USING (path)),
sums AS (SELECT path, sum(saved)::BIGINT AS saved, count(*) FILTER (leaf) AS leaves FROM up GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes o ON n.depth > 0 AND o.path = substr(n.path, 1, 64 * (n.depth - 1)) LEFT JOIN kids k ON k.path = n.path JOIN sums s ON s.path = n.path
"""

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS again FROM src WHERE f <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), again) AS i FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again_seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM ord),
x AS (SELECT conv_id, turn, i, role, text, role[1] AS c, CASE WHEN body = '' THEN 'B' WHEN again_seen THEN 'D' WHEN body[-1] IN ('.', '!', '?') THEN '' ELSE 'T' END AS fault FROM seen),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate,
  count(*) FILTER (fault = 'T') AS truncated, count(*) AS n FROM x GROUP BY conv_id),
pairs AS (SELECT a.conv_id, count(*) FILTER (a.c || b.c NOT IN ('su', 'ua', 'au')) AS illegal FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.i = a.i + 1 GROUP BY a.conv_id),
step(a, b, way) AS (VALUES ('^', 's', ''), ('^', 'u', ''), ('^', 'a', 'I'), ('s', 'u', ''), ('s', 'a', 'I'), ('u', 'u', 'I'), ('u', 'a', ''), ('a', 'u', ''), ('a', 'a', 'I')),
stop(a, way) AS (VALUES ('^', ''), ('s', 'II'), ('u', 'I'), ('a', '')),
dp AS (SELECT conv_id, 0::BIGINT AS i, '^' AS s, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM counts
  UNION ALL SELECT conv_id, i, s, min(best) FROM (
    SELECT dp.conv_id, x.i, dp.s, {{'cost': dp.best.cost + 3, 'audit': dp.best.audit || 'D'}} AS best FROM dp JOIN x ON x.conv_id = dp.conv_id AND x.i = dp.i + 1
    UNION ALL SELECT dp.conv_id, x.i, step.b, {{'cost': dp.best.cost + 2 * length(step.way) + CASE WHEN x.c = step.b THEN 0 ELSE 2 END + CASE WHEN x.fault = 'T' THEN 1 ELSE 0 END,
      'audit': dp.best.audit || step.way || CASE WHEN x.c = step.b THEN 'K' ELSE 'R' END}}
    FROM dp JOIN x ON x.conv_id = dp.conv_id AND x.i = dp.i + 1 JOIN step ON step.a = dp.s WHERE x.fault IN ('', 'T') AND (x.c = step.b OR step.b <> 's')) GROUP BY conv_id, i, s),
done AS (SELECT conv_id, min({{'cost': best.cost + 2 * length(way), 'audit': best.audit || way}}) AS best FROM dp JOIN counts USING (conv_id) JOIN stop ON stop.a = dp.s WHERE dp.i = counts.n GROUP BY conv_id),
ops AS (SELECT conv_id, k, best.audit[k] AS op, k - length(replace(best.audit[1:k], 'I', '')) AS inserts FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS k FROM done)),
kept AS (SELECT ops.conv_id, k, op, x.role, x.text, row_number() OVER (PARTITION BY ops.conv_id ORDER BY k) AS o FROM ops LEFT JOIN x ON op <> 'I' AND x.conv_id = ops.conv_id AND x.i = k - inserts WHERE op <> 'D'),
shift AS (SELECT conv_id, CASE WHEN op = 'K' AND role[1] = 's' THEN 1 ELSE 0 END AS d FROM kept WHERE o = 1),
texts AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (o - d) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM kept JOIN shift USING (conv_id) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts USING (conv_id) LEFT JOIN pairs USING (conv_id) LEFT JOIN done USING (conv_id) LEFT JOIN texts USING (conv_id)
"""

ORACLES = {
    "op1_near_dedup": NEAR_DEDUP, "op2_warc": WARC, "op3_decontamination": DECONTAMINATION, "op9_quality_rules": QUALITY_RULES,
    "op11_url_filter": URL_FILTER, "op12_conversation_trie": CONVERSATION_TRIE, "op13_conversation_repair": CONVERSATION_REPAIR,
}
