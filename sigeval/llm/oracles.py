"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (cast(concat('0x', substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS fill, sum(source_size) OVER () * 1.5::DOUBLE AS everything FROM s1),
s3 AS (SELECT *, fill <= (everything - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM s2),
s4 AS (SELECT *, CASE WHEN capped THEN cap ELSE (everything - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
    / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () * weight END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies FROM s4),
s AS (SELECT source, source_size, target, floor(copies) AS whole, copies - floor(copies) AS fraction, target - floor(copies) * source_size AS rest FROM s5),
r AS (SELECT d.*, source_size, target, whole, rest, fraction,
    CASE WHEN fraction > 0 THEN (u / (1.0::DOUBLE - u)) / (fraction / (1.0::DOUBLE - fraction)) END AS q
    FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT source, q, sum(size) AS words FROM r WHERE q IS NOT NULL GROUP BY source, q),
c AS (SELECT source, q, sum(words) OVER (PARTITION BY source ORDER BY q) - words / 2.0::DOUBLE AS middle FROM t)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.q = c.q"""

ORACLES["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""

ORACLES["op5_host_reputation"] = r"""
WITH p0 AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p0),
k AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS known FROM p),
h0 AS (SELECT host, count(known) AS n, coalesce(sum((known = 'block')::INT), 0) AS bad, string_split(host, '.') AS labels FROM k GROUP BY host),
h AS (SELECT host, n, bad, labels[-1] AS suffix, array_to_string(CASE WHEN length(labels[-1]) = 2 AND len(labels) > 2
      AND labels[-2] IN ('co', 'com', 'org', 'net', 'ac', 'gov') THEN labels[-3:] ELSE labels[-2:] END, '.') AS domain FROM h0),
a AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT m FROM a) AS prior FROM h GROUP BY suffix),
sr AS (SELECT coalesce((sum(n * power(bad / n::DOUBLE - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.5) AS r FROM s0 WHERE n > 0),
s1 AS (SELECT *, (1 - least(greatest((SELECT r FROM sr), 0.001), 0.999)) / least(greatest((SELECT r FROM sr), 0.001), 0.999) AS s FROM s0),
s2 AS (SELECT suffix, (bad + s * prior) / (n + s) AS rate FROM s1),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS prior FROM h JOIN s2 USING (suffix) GROUP BY suffix, domain),
dr AS (SELECT coalesce((sum(n * power(bad / n::DOUBLE - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.5) AS r FROM d0 WHERE n > 0),
d1 AS (SELECT *, (1 - least(greatest((SELECT r FROM dr), 0.001), 0.999)) / least(greatest((SELECT r FROM dr), 0.001), 0.999) AS s FROM d0),
d2 AS (SELECT suffix, domain, (bad + s * prior) / (n + s) AS rate FROM d1),
e0 AS (SELECT host, n, bad, rate AS prior FROM h JOIN d2 USING (suffix, domain)),
er AS (SELECT coalesce((sum(n * power(bad / n::DOUBLE - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.5) AS r FROM e0 WHERE n > 0),
e1 AS (SELECT *, (1 - least(greatest((SELECT r FROM er), 0.001), 0.999)) / least(greatest((SELECT r FROM er), 0.001), 0.999) AS s FROM e0),
e2 AS (SELECT host, n + s AS size, (bad + s * prior) / (n + s) AS rate FROM e1),
e AS (SELECT host, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (size + 1)) > 0.5 AS blocked FROM e2)
SELECT page_id, k.host, path, rule, coalesce(known, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM k JOIN e USING (host)"""


def _spans(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    """CTE of one kind's spans: matches start after the gaps and matches before them."""
    p = pattern.replace("'", "''")
    return f"""k{number} AS (SELECT doc_id, {number} AS no, '{kind}' AS kind, start, start + hit AS stop FROM (
    SELECT doc_id, hit, part, sum(gap) OVER w + coalesce(sum(hit) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
      SELECT doc_id, unnest(range(len(hits))) AS i, length(unnest(hits)) AS hit, length(unnest(parts)) AS part,
        length(unnest(gaps[:len(hits)])) AS gap FROM (
        SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS parts, string_split_regex(t, '{p}') AS gaps FROM d))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE part >= {least})"""


_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24), ("repo_token", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15), ("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
ORACLES["op10_secrets"] = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    + ", ".join(_spans(n, *k) for n, k in enumerate(_KINDS))
    + ", a AS ("
    + " UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(len(_KINDS)))
    + """), g AS (SELECT doc_id, count(*) FILTER (no = 0) AS n0, count(*) FILTER (no = 1) AS n1, count(*) FILTER (no = 2) AS n2,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, no) FILTER (no < 3) AS base,
    string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, no) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
)

ORACLES["op2_decontaminate"] = r"""
WITH b0 AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b0 WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM b), wins AS (SELECT DISTINCT win FROM b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
o AS (SELECT doc_id, i, n, win FROM g SEMI JOIN wins USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o JOIN b USING (win)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

# The CRC-32 takes its key bit by bit; edits are found from the first row to the last, as the least (cost, initials) of each state.
ORACLES["op13_dialogue_repair"] = r"""
WITH RECURSIVE
k AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat_ws(':', coalesce(conv_id::VARCHAR, ' '), coalesce(turn::VARCHAR, ' ')) AS name FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(name) + 1),
      lambda i: [ascii(substr(name, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, b: xor(xor(x, b) >> 1, 3988292384::BIGINT * (xor(x, b) & 1))), 4294967295::BIGINT) % 20 AS kind FROM k),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM n),
moves AS (SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')) AS m(s, t, said)),
-- before a row: none, one or two inserted rows
ways AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)) AS w(s, t, added)),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS said FROM k
  UNION ALL
  SELECT conv_id, i, s, cost, audit, said FROM (
    SELECT f.conv_id, f.i, e.s, p.cost + 2 * w.added + e.cost AS cost, p.audit || repeat('I', w.added) || e.initial AS audit,
      p.said || CASE WHEN w.added = 0 THEN '' WHEN w.added = 2 THEN 'user:' || chr(10) || 'assistant:' || chr(10)
        WHEN w.t = 2 THEN 'user:' || chr(10) ELSE 'assistant:' || chr(10) END || e.said AS said,
      row_number() OVER (PARTITION BY f.conv_id, e.s ORDER BY p.cost + 2 * w.added + e.cost, p.audit || repeat('I', w.added) || e.initial) AS best
    FROM walk p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ways w ON w.s = p.s,
    LATERAL (
      SELECT w.t AS s, 3 AS cost, 'D' AS initial, '' AS said
      UNION ALL SELECT m.t, CASE WHEN f.fault = 't' THEN 1 ELSE 0 END, 'K', f.role || ':' || f.text || chr(10)
        FROM moves m WHERE m.s = w.t AND m.said = substr(f.role, 1, 1) AND f.fault IN ('', 't')
      UNION ALL SELECT m.t, CASE WHEN f.fault = 't' THEN 3 ELSE 2 END, 'R', CASE m.said WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text || chr(10)
        FROM moves m WHERE m.s = w.t AND m.said <> 's' AND f.fault IN ('', 't')) AS e) AS x
  WHERE best = 1),
finished AS (SELECT p.conv_id, p.cost + 2 * w.added AS cost, p.audit || repeat('I', w.added) AS audit,
    p.said || CASE WHEN w.added = 0 THEN '' WHEN w.added = 2 THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE 'assistant:' || chr(10) END AS said,
    row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 2 * w.added, p.audit || repeat('I', w.added)) AS best
  FROM walk p JOIN (SELECT conv_id, max(i) AS i FROM walk GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.i = p.i
  JOIN ways w ON w.s = p.s AND (w.t = 3 OR w.t = 0)),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT r.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, r.cost::BIGINT AS cost, audit,
  sha256(CASE WHEN said = '' THEN '' ELSE left(said, len(said) - 1) END) AS repaired_sha256
FROM finished r LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM r.conv_id WHERE best = 1"""
