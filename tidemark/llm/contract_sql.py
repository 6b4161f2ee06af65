"""SQL of the divergence audit, the archives and the filter audit, each written from its contract alone."""

from __future__ import annotations

DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), found AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, k.n AS lang_n, s.v, s.total AS lang_total,
         sum(coalesce(f.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (total + v) AS p, 1 + (1000000000 * (lang_n + 1)) // (lang_total + v) AS q FROM cells
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INTEGER FROM terms
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

FILTERS_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT row, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         unnest([{'filter': 'A', 'fails': len(words) < 200},
                 {'filter': 'B', 'fails': 100 * len(list_distinct(words)) < 50 * len(words)},
                 {'filter': 'C', 'fails': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)},
                 {'filter': 'D', 'fails': regexp_matches(text, '[#$%&*|]')},
                 {'filter': 'E', 'fails': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)}], recursive := true)
  FROM docs LEFT JOIN marks USING (doc_id)
), failing AS (
  SELECT row, part, good, toxic, coalesce(string_agg(filter, '') FILTER (WHERE fails), '') AS failed FROM flagged GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM orders
), cases AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failing GROUP BY ALL
), told AS (
  SELECT c.part, s.filter_order, s.step, c.failed, c.n, c.good, c.toxic, substr(s.filter_order, s.step::INT, 1) AS filter,
         regexp_matches(c.failed, '[' || substr(s.filter_order, 1, s.step::INT) || ']') AS gone_after,
         s.step > 1 AND regexp_matches(c.failed, '[' || substr(s.filter_order || '-', 1, greatest(s.step::INT - 1, 1)) || ']') AS gone_before
  FROM cases c, steps s
), counted AS (
  SELECT part, filter_order, step::INTEGER AS step, filter,
         coalesce(sum(n) FILTER (WHERE NOT gone_after), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE gone_after AND NOT gone_before), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone_before AND contains(failed, filter)), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE failed = filter), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE gone_after AND NOT gone_before), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE gone_after AND NOT gone_before), 0)::BIGINT AS toxic_lost
  FROM told GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""

ARCHIVES_SQL = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), told AS (
  SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM min(page_id) OVER (PARTITION BY payload_digest) AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM told
"""
