"""DuckDB SQL of the results of operators 11 to 13, written from their definitions and not from the operators."""

OP11 = r"""
WITH win AS MATERIALIZED (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS t FROM
 (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT item, w, least(len(w), 10) AS size FROM
  (SELECT coalesce(item_id::varchar, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0))),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT k, size, i, array_to_string(w[i : i + size - 1], ' ') AS t FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win))),
occ AS MATERIALIZED (SELECT k, size, i, t FROM p WHERE t IN (SELECT t FROM win)),
hit AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS j FROM occ) GROUP BY k),
who AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT k, item FROM occ JOIN win USING (t)) GROUP BY k)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN who USING (k)
"""

OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
 || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
 || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM t),
r AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f LEFT JOIN r USING (doc_id) GROUP BY part, fails),
l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || x.c || d.c || e.c AS o FROM l a, l b, l x, l d, l e WHERE len(list_distinct([a.c, b.c, x.c, d.c, e.c])) = 5),
s AS (SELECT o, k, o[k] AS c, left(o, k - 1) AS before, left(o, k) AS upto FROM o, (SELECT unnest(range(1, 6)) AS k)),
e AS (SELECT part, o, k, c, sum(CASE WHEN translate(fails, upto, '') = fails THEN n ELSE 0 END) AS kept,
 sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
 sum(CASE WHEN contains(fails, c) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost FROM s, m GROUP BY part, o, k, c)
SELECT part, o AS filter_order, k::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
 good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::bigint AS shapley FROM e
"""

_CRC = """xor(list_reduce(flatten(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
 lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::bigint), 4294967295::bigint)"""


def _add(path: str, cost: str, initial: str) -> str:
    """A path of eight digits of cost and the initials, with an edit more."""
    return f"(lpad((left({path}, 8)::int + {cost})::varchar, 8, '0') || substr({path}, 9) || '{initial}')"


OP13 = f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations),
h AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
 unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE kind <> 0),
r AS MATERIALIZED (SELECT *, left(role, 1) AS c, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS ahead, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE 'none' END AS fault
 FROM h WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy)),
n AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
 count_if(fault = 'truncated') AS truncated, count_if(ahead IS NOT NULL AND ahead || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY g),
x AS (SELECT g, i, fault IN ('blank', 'duplicate') AS faulty, c, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM r),
v(g, i, s0, ss, su, sa) AS (SELECT g, 0::bigint, '00000000', NULL::varchar, '00000003I', '00000006II' FROM n
 UNION ALL SELECT g, i, x0, xs, yu, least(xa, {_add("yu", "3", "I")}) FROM
 (SELECT *, least(xu, {_add("least(x0, xs, xa)", "3", "I")}) AS yu FROM
  (SELECT x.g, x.i, {_add("s0", "4", "D")} AS x0, least({_add("ss", "4", "D")}, CASE WHEN NOT faulty AND c = 's' THEN {_add("s0", "t", "K")} END) AS xs,
   least({_add("su", "4", "D")}, CASE WHEN faulty THEN NULL WHEN c = 'u' THEN {_add("least(s0, ss, sa)", "t", "K")} ELSE {_add("least(s0, ss, sa)", "t + 3", "R")} END) AS xu,
   least({_add("sa", "4", "D")}, CASE WHEN faulty THEN NULL WHEN c = 'a' THEN {_add("su", "t", "K")} ELSE {_add("su", "t + 3", "R")} END) AS xa FROM v JOIN x ON x.g = v.g AND x.i = v.i + 1))),
b AS MATERIALIZED (SELECT v.g, left(least(s0, sa), 8)::bigint AS cost, substr(least(s0, sa), 9) AS audit FROM v JOIN n ON n.g = v.g AND n.n = v.i),
e AS (SELECT g, j, audit[j] AS c FROM (SELECT g, audit, unnest(range(1, length(audit) + 1)) AS j FROM b)),
p AS (SELECT *, count_if(c <> 'I') OVER w AS i, count_if(c <> 'D') OVER w AS k FROM e WINDOW w AS (PARTITION BY g ORDER BY j)),
q AS (SELECT p.g, p.j, p.c, p.k, r.role, r.text, max(CASE WHEN p.k = 1 AND p.c = 'K' AND r.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.g) AS led FROM p LEFT JOIN r ON r.g = p.g AND r.i = p.i AND p.c <> 'I'),
z AS (SELECT g, sha256(string_agg(CASE WHEN c = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN c = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM q WHERE c <> 'D' GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
 coalesce(illegal, 0)::bigint AS illegal, coalesce(cost, 0)::bigint AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM o) LEFT JOIN n USING (g) LEFT JOIN b USING (g) LEFT JOIN z USING (g)
"""
