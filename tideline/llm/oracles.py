"""DuckDB SQL for the rows of the training-data queries that SQL can express."""

SQL = {
    "op1_warc_revisits": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), o AS (
  SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN o.first_id IS NULL OR o.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o.first_id <> p.page_id THEN o.first_id END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND p.payload_bytes >= 1000
""",
    "op2_perspective_rotation": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), r AS (
  SELECT t.conv_id, s.speaker, t.turn, t.role, t.text, t.role = s.speaker AS own,
         CASE WHEN t.role = 'system' THEN '<|system|>' || chr(10)
              WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || regexp_replace(t.role, '[|\\r\\n]', '_', 'g') || '|>' || chr(10) END AS head,
         t.text || '<|end|>' AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), w AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS past
  FROM r
)
SELECT conv_id, speaker, string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_own,
       string_agg(CASE WHEN own THEN CAST(past - 1 - length(body) AS VARCHAR) || ':' || CAST(past - 1 AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, role, text) AS mask_spans,
       CAST(sum(CASE WHEN own THEN length(body) ELSE 0 END) AS BIGINT) AS mask_chars
FROM w GROUP BY conv_id, speaker
""",
    "op11_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), occ AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS p, k
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w) WHERE len(w) >= k)
), f AS (
  SELECT lang, p, k, count(*) AS n FROM occ GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, p, k, n AS a, string_split(p, ' ') AS w FROM f WHERE k > 1
), cuts AS (
  SELECT lang, p, k, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), scored AS (
  SELECT cuts.lang, cuts.p, a, j, fx.n AS l, fy.n AS r, (2000000::HUGEINT * a) // (fx.n::HUGEINT + fy.n) AS score
  FROM cuts JOIN f AS fx ON fx.lang = cuts.lang AND fx.p = cuts.x JOIN f AS fy ON fy.lang = cuts.lang AND fy.p = cuts.y
), s AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS p, max(a) AS longer
  FROM (SELECT lang, w, k, a, unnest([1, 2, 3, 1, 2]) AS i, unnest([2, 2, 2, 3, 3]) AS m FROM c) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), kept AS (
  SELECT s.lang, s.p AS phrase, s.a, s.l, s.r, s.score
  FROM s LEFT JOIN inner_ AS i ON s.lang = i.lang AND s.p = i.p WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, t.n, CAST(r.score AS BIGINT) AS score
FROM ranked AS r JOIN totals AS t ON r.lang = t.lang WHERE r.rank <= 2000
""",
    "op13_prefix_trie": """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id AS c, list(t ORDER BY place) AS ts FROM turns GROUP BY conv_id
), hashed AS (  -- CRC-32 of the decimal digits, bit by bit
  SELECT c, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda h, d: list_reduce(list_prepend(xor(h, d), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h
  FROM own
), built AS (
  SELECT a.c, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM hashed AS a LEFT JOIN own AS b ON b.c = a.c - a.c % 5
), rows AS (
  SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM built
), members AS (
  SELECT c, d, ts[1:d] AS k, CASE WHEN d > 0 THEN ts[1:d - 1] END AS up, len(ts) = d AS ends, CASE WHEN d > 0 THEN strlen(ts[d].text) ELSE 0 END AS size FROM rows
), nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(size) AS size,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ends FROM members GROUP BY k, d
), children AS (
  SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
), sums AS (
  SELECT n.*, coalesce(ch.n, 0) AS n_children FROM nodes AS n LEFT JOIN children AS ch ON ch.up = n.k
), spread AS (
  SELECT *, unnest(range(0, d + 1)) AS e FROM sums
), subtrees AS (
  SELECT k[1:e] AS k, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM spread GROUP BY k[1:e]
)
SELECT s.conv_id, s.d AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(s.ends) AS ends_sha256
FROM sums AS s JOIN subtrees AS t ON t.k = s.k LEFT JOIN nodes AS p ON p.k = s.up
""",
}
