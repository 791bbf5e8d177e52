"""DuckDB SQL for the operators that SQL can express over the given tables.

Written from the contracts, not from the operators: other functions, and plain
scans where the operators take their own ways. The rest (learned lexicons,
hash fingerprints, token ids, permutations) is held against brute force in
tests/llm.
"""

from __future__ import annotations


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_BEFORE = rf"""(?:{_KEYWORD})["'']?\x20*[:=]\x20*["'']?"""
_PATTERNS = {"assign": f"{_BEFORE}[A-Za-z0-9+/_.=-]+", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
             "candidate": "[A-Za-z0-9+/_-]{20,}={0,2}"}


def _matches(kind: str) -> str:
    """rid, found, start, past of every match: places from the lengths of pieces and matches before it."""
    p = _PATTERNS[kind]
    return f"""
{kind}_m AS (SELECT rid, ms[i] AS found,
  list_sum(list_transform(ps[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d
              WHERE regexp_matches(t, '{p}')))
  WHERE length(found) >= {8 if kind in ("assign", "access") else 20 if kind == "candidate" else 32})"""


# Every letter a-f is a "hex" match of its own; only texts with a long one are cut up.
_HEX = _matches("hex").replace("WHERE regexp_matches(t, '[0-9a-f]+')", "WHERE regexp_matches(t, '[0-9a-f]{32}')")

OP9 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_matches("assign")}, {_matches("access")}, {_HEX}, {_matches("candidate")},
base AS MATERIALIZED (
  SELECT rid, 0 AS no, 'assign' AS kind, start, start + length(found) AS past FROM assign_m
  WHERE length(regexp_replace(found, '^{_BEFORE}', '')) >= 8
  UNION ALL SELECT rid, 1, 'access', start, start + length(found) FROM access_m WHERE length(found) >= 16
  UNION ALL SELECT rid, 2, 'hex', start, start + length(found) FROM hex_m WHERE length(found) >= 32),
free AS MATERIALIZED (
  SELECT rid, found, start, start + length(found) AS past,
    CASE WHEN regexp_full_match(found, '[0-9+/_=-]+') THEN 3.2
         WHEN regexp_full_match(found, '[0-9a-f]+|[0-9A-F]+') THEN 3.0
         WHEN regexp_full_match(found, '[A-Za-z/_=-]+') THEN 4.0 ELSE 3.8 END AS least
  FROM candidate_m c
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start < c.start + length(found) AND c.start < b.past)
    AND NOT regexp_matches(lower(found), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')
    AND NOT regexp_full_match(found, 'AKIA[A-Z0-9]{{9,}}EXAMPLE|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY')
    AND length(replace(found, found[1], '')) > 0
    AND NOT regexp_full_match(found, '/?[A-Za-z_-]+(?:/[A-Za-z0-9_-]{{1,12}}){{2,16}}/?')),
windows AS (SELECT rid, start, past, least, string_split(substr(found, p, 20), '') AS cs
  FROM (SELECT *, unnest(range(1, length(found) - 18)) AS p FROM free WHERE least IS NOT NULL)),
entropy AS (SELECT rid, start, past FROM (
  SELECT rid, start, past, least, max(-list_sum(list_transform(list_distinct(cs),
    lambda x: len(list_filter(cs, lambda y: y = x)) / 20.0 * log2(len(list_filter(cs, lambda y: y = x)) / 20.0)))) AS h
  FROM windows GROUP BY ALL) WHERE h >= least - 1e-9),
every AS (SELECT * FROM base UNION ALL SELECT rid, 3, 'entropy', start, past FROM entropy),
b AS (SELECT rid, count(*) FILTER (WHERE no = 0) AS a, count(*) FILTER (WHERE no = 1) AS k, count(*) FILTER (WHERE no = 2) AS x,
  string_agg(kind || ':' || start || ':' || past, ',' ORDER BY start, no) AS spans FROM base GROUP BY rid),
e AS (SELECT rid, count(*) FILTER (WHERE no = 3) AS n,
  string_agg(kind || ':' || start || ':' || past, ',' ORDER BY start, no) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(b.a, 0) AS n_assign, coalesce(b.k, 0) AS n_access, coalesce(b.x, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans, coalesce(e.n, 0) AS n_entropy
FROM d LEFT JOIN b USING (rid) LEFT JOIN e USING (rid)
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
first AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h),
digits AS (SELECT page_id, h, list_transform(range(0, 8), lambda c: ('0x' || substr(sha1(h), 5 * c + 1, 5))::BIGINT) AS v FROM p),
base32 AS (SELECT page_id, h, list_aggregate(list_transform(range(0, 32),
  lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)),
  'string_agg', '') AS digest FROM digits)
SELECT page_id, strlen(h) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM base32 JOIN first USING (h)
"""

# The pages' own markup: one article of a heading and paragraphs, bold and line breaks inside them.
OP5 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS inner_ FROM pages),
blocks AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(inner_, '</?(?:h1|p)>'), lambda b:
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '</?b>', '', 'g'), '<br>', ' ', 'g'),
    '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS bs FROM a)
SELECT page_id, url, array_to_string(bs, chr(10)) AS text, length(array_to_string(bs, chr(10))) AS n_chars FROM blocks
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
  ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS c4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain'
       WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

# Blocks of 256 words, 32 rounds; plain running sums and a closed form of the level where the operator
# takes chunks and rounds of resharing; the part-taken epoch by adding up its blocks in drawn order.
OP12 = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][no % 3 + 1] AS w FROM s),
r AS (SELECT *, sum(z) OVER o - z AS z_before, sum(w) OVER o - w AS w_before, sum(z) OVER () AS zs, sum(w) OVER () AS ws
      FROM w WINDOW o AS (ORDER BY z::DOUBLE / w, no ROWS UNBOUNDED PRECEDING)),
level AS (SELECT 3 * zs - 4 * z_before AS num, 2 * (ws - w_before) AS den FROM r
          WHERE (3 * zs - 4 * z_before) * w <= 4 * z * (ws - w_before) ORDER BY w_before LIMIT 1),
t AS (SELECT source, no, z, CASE WHEN num * w > 2 * z * den THEN 2.0 * z ELSE (num * w)::DOUBLE / den::DOUBLE END AS target FROM w, level),
p AS MATERIALIZED (SELECT *, words // greatest(z, 1) AS epochs, words % greatest(z, 1) AS rest, (z + 255) // 256 AS n
  FROM (SELECT *, least(2 * z, floor(target + 0.5)::BIGINT) AS words FROM t)),
keys AS MATERIALIZED (SELECT no, i, ('0x' || substr(h, 1, 11))::BIGINT % n AS k, ('0x' || substr(h, 12, 7))::BIGINT AS a,
    ('0x' || substr(h, 19, 7))::BIGINT AS b, ('0x' || substr(h, 26, 7))::BIGINT AS c
  FROM (SELECT no, n, i, md5(concat_ws('|', 12, coalesce('s:' || source, 'null'), epochs, i)) AS h
        FROM p, range(32) AS x(i) WHERE rest > 0)),
walk AS (SELECT no, n, place, place AS x, 0 AS i FROM p, LATERAL (SELECT unnest(range(n)) AS place) WHERE rest > 0
  UNION ALL
  SELECT no, n, place, CASE WHEN ((((m * m + c) % 2147483647) >> 15) & 1) = 1 THEN y ELSE x END, i + 1
  FROM (SELECT w.*, y, c, ((greatest(x, y) & 1073741823) * a + (greatest(x, y) >> 30) * b + c) % 2147483647 AS m
        FROM (SELECT walk.*, (k - x + n) % n AS y, a, b, c FROM walk JOIN keys USING (no, i)) AS w)),
part AS (SELECT no, x, greatest(0, least(len, rest - coalesce(sum(len) OVER (PARTITION BY no ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS kept
  FROM (SELECT walk.no, place, x, rest, least(256, z - x * 256) AS len FROM walk JOIN p USING (no) WHERE i = 32)),
o AS (SELECT rid, doc_id, size, no, z, target, epochs, sum(size) OVER (PARTITION BY no ORDER BY key, rid) - size AS start
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
cut AS (SELECT rid, sum(greatest(0, least(start + size, x * 256 + kept) - greatest(start, x * 256))) AS more
        FROM o JOIN part ON o.no = part.no AND x BETWEEN start // 256 AND (start + size - 1) // 256 GROUP BY rid)
SELECT doc_id, size::BIGINT AS size, z AS source_size, target::DOUBLE AS target, (epochs * size + coalesce(more, 0))::BIGINT AS taken
FROM o LEFT JOIN cut USING (rid)
"""
