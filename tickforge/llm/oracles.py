"""DuckDB SQL of the operators that it can express, each written from the operator's definition and not from its method."""

from __future__ import annotations

#: The table of CRC-32, from its polynomial.
_CRC = """byte AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) AS g(i)))"""


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's bytes."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split_regex(rtrim(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g')), ' '), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])))"


OP11_SQL = rf"""
WITH {_CRC},
w AS (SELECT 'd' AS kind, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT kind, doc_id, array_to_string(w[i : i + n - 1], ' ') AS f, count(*) AS c FROM w, range(1, 4) AS g(n), unnest(range(1, len(w) - n + 2)) AS p(i) GROUP BY ALL),
h AS (SELECT f, {_crc('f')} % 10000 AS b FROM (SELECT DISTINCT f FROM f), byte),
n AS (SELECT b, coalesce(sum(c) FILTER (kind = 'd'), 0) AS s, coalesce(sum(c) FILTER (kind = 'b'), 0) AS t FROM f JOIN h USING (f) GROUP BY b),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(n.t + 1 AS DOUBLE) * CAST(a.s + 10000 AS DOUBLE)) / (CAST(n.s + 1 AS DOUBLE) * CAST(a.t + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM n, a),
x AS (SELECT doc_id, sum(c) AS n_features, sum(c * g) AS weight FROM f JOIN h USING (f) JOIN gain USING (b) WHERE kind = 'd' GROUP BY doc_id),
r AS (SELECT w.doc_id, len(w.w) >= 20 AS fit, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || w.doc_id)[1:8] AS BIGINT) + 0.5e0) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN x ON x.doc_id = w.doc_id WHERE kind = 'd'),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS k, count(*) FILTER (fit) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND k <= 5 * n // 100 THEN k END AS rank FROM o"""

# Runs from equal eight-word stretches: a run's first eight words are found again a period on, where its period is no longer kept to the left.
OP12_SQL = rf"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS own FROM (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w, {_crc('CAST(doc_id AS VARCHAR)')} AS h FROM documents, byte)),
q AS (SELECT *, CASE WHEN own THEN g % n ELSE n END AS a, CASE WHEN own THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM d),
e AS (SELECT doc_id, i, n, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS x FROM q, unnest(range(n)) AS u(i)),
z AS (SELECT doc_id, n, list(x ORDER BY i) AS w FROM e GROUP BY doc_id, n),
s AS (SELECT doc_id, i, CASE WHEN i > 0 THEN w[i] END AS before, array_to_string(w[i + 1 : i + 8], ' ') AS x FROM z, unnest(range(n - 7)) AS u(i)),
c AS (SELECT l.doc_id, l.i AS start, r.i - l.i AS period FROM s l JOIN s r ON r.doc_id = l.doc_id AND r.x = l.x AND r.i > l.i AND (l.before IS NULL OR l.before <> r.before)),
m AS (SELECT DISTINCT doc_id, period FROM c),
o AS (SELECT m.doc_id, m.period, l.i FROM m JOIN e l ON l.doc_id = m.doc_id JOIN e r ON r.doc_id = m.doc_id AND r.i = l.i + m.period AND r.x <> l.x UNION ALL SELECT m.doc_id, m.period, n - m.period FROM m JOIN z USING (doc_id)),
f AS (SELECT c.doc_id, start, c.period, o.i + c.period - start AS length FROM c ASOF JOIN o ON o.doc_id = c.doc_id AND o.period = c.period AND o.i >= c.start),
v AS (SELECT doc_id, start, length, min(period) AS period FROM f WHERE length >= 24 AND length >= 3 * period GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, u.i FROM v, unnest(range(start + period, start + length)) AS u(i)),
k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.i) AS kept FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i WHERE gone.i IS NULL GROUP BY e.doc_id),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP13_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS x FROM w, unnest(range(1, len(w) - 11)) AS g(i)),
m AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM s JOIN m USING (x), range(13) AS g(j) WHERE doc_id > first),
e AS (SELECT doc_id, g.i, w[g.i] AS x FROM w, unnest(range(1, len(w) + 1)) AS g(i)),
j AS (SELECT e.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY e.i) FILTER (gone.i IS NULL), '') AS kept FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN j USING (doc_id)"""
