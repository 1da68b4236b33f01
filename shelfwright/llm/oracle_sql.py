"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

_OP6 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""

_OP7 = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """List of (start, rank, text) of one kind's spans."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS k, unnest(list_transform(
    list_filter(range(1, len(whole) + 1), lambda i: length(judged[i]) >= {least}),
    lambda i: struct_pack(s := list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda m: length(m))), 0),
                     n := length(whole[i])))) AS x
  FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS whole,
               regexp_extract_all(t, '{p}', {group}) AS judged FROM d)"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

_OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans('assign', 0, _ASSIGN, 2, 6)}
  UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+', 0, 20)}
  UNION ALL {_spans('hex', 2, '[0-9a-f]+', 0, 24)}),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
        count(*) FILTER (k = 2) AS n_hex,
        string_agg(['assign', 'access', 'hex'][k + 1] || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT), ',' ORDER BY x.s, k) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""


_NORM = r"""trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g'))"""

_OP1 = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
w AS (SELECT conv_id, turn, {_NORM.format('text')} AS norm, string_split(text, chr(10)) AS said,
  string_split({_NORM.format('text')}, ' ') AS words FROM m),
parts AS (SELECT conv_id, turn, list_prepend(norm, string_split(regexp_replace(norm, '([.!?])\\x20', '\\1' || chr(10), 'g'), chr(10))) AS whole,
  list_transform(said, lambda x: {_NORM.format('x')}) AS lines,
  CASE WHEN len(list_filter(said, lambda x: len(string_split(x, ' ')) > 9)) > 0 THEN list_transform(
    range(0, CAST(ceil(len(words) / 9) AS BIGINT)), lambda i: array_to_string(words[i * 9 + 1:i * 9 + 9], ' ')) END AS anew FROM w),
own AS (SELECT conv_id, turn, unnest(list_concat(whole, lines)) AS piece FROM parts),
firsts AS (SELECT conv_id, piece, min(turn) AS turn FROM own WHERE piece <> '' GROUP BY ALL),
quotes AS (SELECT m.conv_id, m.turn, q.level, unnest(list_concat(o.whole, CASE WHEN (m.conv_id + m.turn) % 2 = 0
    THEN coalesce(o.anew, o.lines) ELSE o.lines END)) AS piece
  FROM m, (VALUES (1), (2)) AS q(level) JOIN parts o ON true WHERE o.conv_id = m.conv_id AND o.turn = m.turn - q.level),
quoted AS (SELECT DISTINCT conv_id, turn, level, piece FROM quotes WHERE piece <> ''),
votes AS (SELECT q.conv_id, q.turn, q.level, f.turn AS reply_turn, sum(length(q.piece)) AS size
  FROM quoted q JOIN firsts f ON f.conv_id = q.conv_id AND f.piece = q.piece GROUP BY ALL),
best AS (SELECT conv_id, turn, reply_turn FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, reply_turn) = 1),
totals AS (SELECT conv_id, turn, max(level) AS max_level, count(DISTINCT level) AS n FROM quoted GROUP BY ALL),
chain AS (SELECT conv_id, turn, turn AS thread_turn, 0 AS depth FROM m
    WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.conv_id = m.conv_id AND b.turn = m.turn)
  UNION ALL SELECT b.conv_id, b.turn, c.thread_turn, c.depth + 1 FROM best b
    JOIN chain c ON c.conv_id = b.conv_id AND c.turn = b.reply_turn)
SELECT m.conv_id, m.turn, CASE WHEN b.turn IS NOT NULL THEN m.conv_id END AS reply_conv, b.reply_turn,
  m.conv_id AS thread_conv, c.thread_turn, c.depth, coalesce(t.max_level, 0) AS max_level,
  coalesce(t.n, 0) AS n_quoted, coalesce(t.n, 0) AS n_linked, sha256(m.text) AS own_sha256
FROM m JOIN chain c USING (conv_id, turn) LEFT JOIN best b USING (conv_id, turn) LEFT JOIN totals t USING (conv_id, turn)
"""


_OP13 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS k, sha1(payload) AS hex FROM p),
f AS (SELECT k, min(page_id) AS first FROM h GROUP BY k)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, page_id % 64 = 5 AS salvaged
FROM h JOIN f USING (k)
"""


def oracles() -> dict[str, str]:
    return {"op1_quote_links": _OP1, "op2_secret_ledger": _OP2, "op6_exact_dedup": _OP6, "op7_url_filter": _OP7,
            "op13_warc_salvage": _OP13}
