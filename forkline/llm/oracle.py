"""SQL counterparts of the operators' queries for DuckDB, written from the contracts."""

from __future__ import annotations

SPACE = r"\x20\x09-\x0D"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

ORACLE = {
    "op3_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER("coalesce(text, '')")}, '[^{SPACE}]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n""",
    "op5_url_filter": r"""
WITH c AS (
  SELECT page_id, url, (DATE '2024-01-01' + ((page_id * 37) % 366)::INTEGER)::DATE AS fetched_on,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '') AS host,
    CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
d AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS domain FROM c WHERE host IS NOT NULL),
k AS (SELECT domain, ('0x' || substr(md5(domain), 1, 7))::BIGINT AS k FROM d),
l AS (SELECT * FROM k WHERE k % 2 = 0 OR regexp_matches(domain, 'casino|bets|pills')),
change AS (
  SELECT domain, '/' AS path, 'block' AS action, k % 300 AS d, 1 AS live FROM l
  UNION ALL SELECT domain, '/', 'block', k % 300 + 20 + k % 97, 0 FROM l WHERE k % 3 <> 0
  UNION ALL SELECT domain, '/', 'block', k % 300 + 150, 1 FROM l WHERE k % 5 = 0
  UNION ALL SELECT domain, '/en/', 'allow', k % 200, 1 FROM l WHERE k % 4 = 0),
daily AS (SELECT domain, path, action, (DATE '2024-01-01' + d::INTEGER)::DATE AS day, max(live) AS live FROM change GROUP BY 1, 2, 3, 4),
runs AS (SELECT *, lead(day) OVER (PARTITION BY domain, path, action ORDER BY day) AS until FROM daily),
entry AS (SELECT domain, path, action, day AS valid_from, until AS valid_to FROM runs WHERE live = 1),
met AS (
  SELECT c.page_id, e.*, row_number() OVER (PARTITION BY c.page_id ORDER BY len(string_split(e.domain, '.')) DESC, len(e.path) DESC,
    (e.action = 'allow') DESC, valid_from DESC) AS place
  FROM c JOIN entry e ON (c.host = e.domain OR c.host LIKE '%.' || e.domain) AND starts_with(c.path, e.path)
    AND e.valid_from <= c.fetched_on AND (e.valid_to IS NULL OR c.fetched_on < e.valid_to))
SELECT c.page_id, c.url, c.fetched_on, c.host, coalesce(m.action, 'pass') AS verdict, m.domain AS matched_domain,
  m.path AS matched_path, m.valid_from, m.valid_to
FROM c LEFT JOIN met m ON m.page_id = c.page_id AND m.place = 1""",
    "op6_warc_transactions": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h AND n >= 1000""",
    "op8_benchmark_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all({ASCII_LOWER("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS size, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1),
    lambda x: array_to_string(ws[x:x + 12], ' '))) AS g FROM i WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS k, ws FROM d, sizes WHERE len(ws) >= size),
hit AS (SELECT DISTINCT g.doc_id, g.k, g.size, w.item_id FROM grams g JOIN win w ON w.size = g.size AND w.g = array_to_string(g.ws[g.k:g.k + g.size - 1], ' ')),
pos AS (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS p FROM hit),
hits AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_conversation_repair": r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
-- crc32 by bytes: no counterpart in DuckDB.
bits AS (SELECT range AS b, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
names AS (SELECT DISTINCT name FROM given),
h AS (
  SELECT name, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::UBIGINT)),
    lambda a, x: xor(a // 256, t[(xor(a % 256, x) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS h FROM names, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given JOIN h USING (name) WHERE h <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault, left(role, 1) AS f FROM seen),
-- From the last row to the first: for each state the least (cost, audit) and the repaired lines.
best AS (
  SELECT conv_id, n + 1 AS i, [
    {'c': 0, 'a': '', 'l': []::VARCHAR[]}, {'c': 6, 'a': 'II', 'l': ['user:', 'assistant:']},
    {'c': 3, 'a': 'I', 'l': ['assistant:']}, {'c': 0, 'a': '', 'l': []::VARCHAR[]}] AS s FROM r WHERE r.i = 1
  UNION ALL
  SELECT conv_id, i, [list_min([b0, {'c': 3 + c2.c, 'a': 'I' || c2.a, 'l': list_prepend('user:', c2.l)}]),
    list_min([b1, {'c': 3 + c2.c, 'a': 'I' || c2.a, 'l': list_prepend('user:', c2.l)}]), c2, c3]
  FROM (
    SELECT *, list_min([b2, {'c': 3 + b3.c, 'a': 'I' || b3.a, 'l': list_prepend('assistant:', b3.l)}]) AS c2,
      list_min([b3, {'c': 3 + b2.c, 'a': 'I' || b2.a, 'l': list_prepend('user:', b2.l)}]) AS c3
    FROM (
      SELECT r.conv_id, r.i,
        list_min([del(s, 1), keep(s, 's', 2, fault, f, role, text), keep(s, 'u', 3, fault, f, role, text), rerole(s, 'user', 3, fault, text)]) AS b0,
        list_min([del(s, 2), keep(s, 'u', 3, fault, f, role, text), rerole(s, 'user', 3, fault, text)]) AS b1,
        list_min([del(s, 3), keep(s, 'a', 4, fault, f, role, text), rerole(s, 'assistant', 4, fault, text)]) AS b2,
        list_min([del(s, 4), keep(s, 'u', 3, fault, f, role, text), rerole(s, 'user', 3, fault, text)]) AS b3
      FROM best JOIN r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i - 1))),
done AS (SELECT conv_id, s[1] AS x FROM best WHERE i = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'b')::INT) AS blank,
    sum((fault = 'd')::INT) AS duplicate, sum((fault = 't')::INT) AS truncated,
    sum((pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal
  FROM r GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost,
  coalesce(x.a, '') AS audit, sha256(coalesce(array_to_string(x.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id""",
}


def _edits(sql: str) -> str:
    """Writes out the three edits of a row, with which the repair's text is easier to read."""
    def line(role, rest):
        return f"list_prepend({role} || ':' || text, s[{rest}].l)"

    for k in range(1, 5):
        sql = sql.replace(f"del(s, {k})", f"{{'c': 4 + s[{k}].c, 'a': 'D' || s[{k}].a, 'l': s[{k}].l}}")
        stays = "CASE fault WHEN 't' THEN 3 ELSE 0 END"
        for f in "sua":
            sql = sql.replace(f"keep(s, '{f}', {k}, fault, f, role, text)", (
                f"CASE WHEN f = '{f}' AND fault NOT IN ('b', 'd') THEN "
                f"{{'c': {stays} + s[{k}].c, 'a': 'K' || s[{k}].a, 'l': {line('role', k)}}} END"))
        for name in ("user", "assistant"):
            sql = sql.replace(f"rerole(s, '{name}', {k}, fault, text)", (
                f"CASE WHEN fault NOT IN ('b', 'd') THEN "
                f"{{'c': 3 + {stays} + s[{k}].c, 'a': 'R' || s[{k}].a, 'l': {line(repr(name), k)}}} END"))
    return sql


ORACLE["op13_conversation_repair"] = _edits(ORACLE["op13_conversation_repair"])
