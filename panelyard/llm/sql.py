"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b2)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, item_id, n, i FROM pos JOIN win USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
pos AS (SELECT doc_id, i, trim(l[i], ' ') AS a, trim(l[i + 1], ' ') AS b, trim(l[i + 2], ' ') AS c FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS r FROM pos WHERE a <> '' OR b <> '' OR c <> '') WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(3) t(k)),
kept AS (SELECT doc_id, count(g) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (g IS NULL) AS text
         FROM (SELECT x.doc_id, x.i, x.line, g.i AS g FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d) x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i) GROUP BY 1)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


OP1 = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


OP4 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10) ||
  'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head, chr(13) || chr(10) || chr(13) || chr(10) AS tail
  FROM pages WHERE page_id IS NOT NULL),
r AS (SELECT page_id, page_id % 17 AS k, sha256(head || body || tail) AS sha, strlen(head || body || tail) AS size,
  CASE page_id % 17 WHEN 3 THEN sha256(head || '#' || substr(body, 2) || tail) WHEN 5 THEN sha256(head || substr(body, 1, greatest(length(body) - 5, 0)) || '?????' || tail) ELSE sha256(head || body || tail) END AS worn FROM p),
o AS (SELECT *, sum(size) OVER (PARTITION BY page_id // 4096 ORDER BY page_id, sha ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM r)
SELECT page_id AS record_id, CASE k WHEN 7 THEN 'missing' WHEN 13 THEN 'extra' WHEN 11 THEN 'moved' ELSE 'changed' END AS status, (stop - size)::BIGINT AS start, stop,
  CASE WHEN k <> 13 THEN sha END AS expected, CASE WHEN k <> 7 THEN worn END AS found
FROM o WHERE k IN (7, 11, 13) OR worn <> sha
"""


OP11 = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
f AS (SELECT w.doc_id, part, l.quality, l.toxic,
  (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (w.doc_id > min(w.doc_id) OVER (PARTITION BY text))::INT AS mask
  FROM w LEFT JOIN labels l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f GROUP BY 1, 2),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM one a, one b, one c, one d, one e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1 : k - 1]), 0)::INT AS gone FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS k FROM o)),
r AS (SELECT c.part, s.*, c.mask, n, good, toxic, (mask & own) > 0 AS fails, (mask & gone) > 0 AS early FROM c, s),
t AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT early), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT early), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND early), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT early), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT early), 0)::BIGINT AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t
"""


OP12 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i : i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
d AS (SELECT doc_id, list_sort(list_distinct(list(t))) AS s FROM g GROUP BY 1),
u AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM d GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS t FROM u),
e AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT rep, rep FROM u UNION SELECT r.a, two.b FROM r JOIN two ON two.a = r.b),
c AS (SELECT a AS rep, min(b) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(len(d.s), 0)::BIGINT AS n_shingles, coalesce(c.least, w.doc_id) AS component_id
FROM w LEFT JOIN d ON d.doc_id = w.doc_id LEFT JOIN u ON u.s = d.s LEFT JOIN c ON c.rep = u.rep
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_bitslice_topk": OP1, "op2_decontaminate": OP2, "op3_line_dedup": OP3, "op4_merkle_audit": OP4, "op11_filter_audit": OP11, "op12_jaccard_join": OP12}
