"""DuckDB SQL for those of the thirteen queries that SQL can express."""

from __future__ import annotations

_SPACE = r"\x20\x09-\x0D"

ORACLES = {
    "op3_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, pos, line, key, length(key) >= 40 AS counts FROM (
    SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))),
often AS (SELECT key, max(doc_id) AS last FROM l WHERE counts GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT l.*, coalesce(l.counts AND l.doc_id < often.last, false) AS gone FROM l LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op5_segment_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_url_filter": """
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
hit AS (SELECT page_id, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC, r_verdict DESC) AS k
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT p.page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND k = 1""",
    "op10_curriculum": rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^{_SPACE}]+')), 0) AS BIGINT) AS size, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS lim, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
b AS (SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, place, coalesce(least(lim, max(CASE WHEN lim / weight > level THEN level END) OVER () * weight), lim) AS target FROM b),
r AS (SELECT doc_id, size, source_size, place, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken, least((before + size / 2) / target, 1) AS share FROM r)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN least(1, CASE place % 3 WHEN 0 THEN 2 * share / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2 * share, 0))) WHEN 1 THEN 2 * share / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * share)) ELSE share END) END AS position FROM k""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30::HUGEINT * positive_score <= 100::HUGEINT * score AND 100::HUGEINT * score <= 90::HUGEINT * positive_score)
SELECT * FROM n WHERE rank <= 10""",
    "op13_collocations": r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS lengths(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, phrase, lang || chr(9) || phrase AS key, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c
  JOIN f AS x ON x.key = c.lang || chr(9) || array_to_string(w[1 : cut], ' ') JOIN f AS y ON y.key = c.lang || chr(9) || array_to_string(w[cut + 1 : c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ ON best.lang = inner_.lang AND best.phrase = inner_.phrase WHERE coalesce(100::HUGEINT * longer < 80::HUGEINT * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON ranked.lang = n.lang WHERE rank <= 2000""",
}
