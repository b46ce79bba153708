"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH docs AS (
  SELECT doc_id, source,
         coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix'), 1, 13))::BIGINT AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM docs GROUP BY source
), capped AS (
  SELECT *, (source_size * 2)::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM sizes
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), targets AS (
  SELECT source, source_size,
         least(cap, coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight, cap)) AS target
  FROM levels
), placed AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source, source_size, target,
       (CASE WHEN source_size > 0
             THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before))
             ELSE 0 END)::BIGINT AS taken
FROM placed
"""

OP7 = r"""
WITH pages AS (
  SELECT row_number() OVER () AS page, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), lines AS (
  SELECT page, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS at FROM pages
), hosts AS (
  SELECT source, count(*) AS n FROM pages GROUP BY source
), boilerplate AS (
  SELECT l.source, l.line
  FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]')
  GROUP BY l.source, l.line
  HAVING count(DISTINCT l.page) >= 3 AND count(DISTINCT l.page) > 0.015::DOUBLE * any_value(h.n)
), kept AS (
  SELECT l.page, coalesce(string_agg(l.line, chr(10) ORDER BY l.at) FILTER (b.line IS NULL), '') AS text,
         count(b.line) AS n_dropped
  FROM lines l LEFT JOIN boilerplate b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line
  GROUP BY l.page
)
SELECT p.doc_id, p.source, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped,
       md5(CASE WHEN k.n_dropped > 0 THEN k.text ELSE p.text END) AS text_md5
FROM pages p LEFT JOIN kept k ON p.page = k.page
"""

OP9 = r"""
WITH counts AS (
  SELECT doc_id, source, lang, 'words-1' AS tokenizer,
         coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents
  UNION ALL
  SELECT doc_id, source, lang, 'pieces-1',
         coalesce(length(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^\x00-\x20\x7F0-9A-Za-z\x{80}-\x{10FFFF}]')), 0)
  FROM documents
), marks AS (
  SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), final AS (
  SELECT source, lang, tokenizer, CASE WHEN m.toxic = 1 THEN 0 ELSE tokens END AS tokens
  FROM counts c LEFT JOIN marks m ON c.doc_id = m.doc_id
  WHERE m.quality IS NULL OR m.quality <> 0
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens
FROM final GROUP BY source, lang, tokenizer
"""

OP10 = r"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS text,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), sites AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    CASE
      WHEN regexp_matches(text, '^[^:/?#]*://([^/?#]*\.)?example\.org/de/') THEN '@@||example.org/de/'
      WHEN regexp_matches(text, '^[^:/?#]*://([^/?#]*\.)?spam-farm\.') THEN '||spam-farm.'
      WHEN regexp_matches(text, '^[^:/?#]*://([^/?#]*\.)?cheap-pills\.') THEN '||cheap-pills.'
      WHEN regexp_matches(text, '([^0-9a-z_.%-]|$)phishing([^0-9a-z_.%-]|$)') THEN '^phishing^'
      WHEN regexp_matches(text, '/xxx([^0-9a-z_.%-]|$)') THEN '/xxx^'
      WHEN contains(text, '/wp-login.php') THEN '/wp-login.php'
      WHEN regexp_matches(text, '(?s)/cgi-bin/.*\.exe$') THEN '/cgi-bin/*.exe|'
      WHEN contains(text, '/casino/') THEN '/casino/'
      WHEN contains(text, '/adult/') THEN '/adult/'
      WHEN regexp_matches(text, '\.onion([^0-9a-z_.%-]|$)') THEN '.onion^' END AS pattern
  FROM parts
)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN pattern IS NULL OR pattern LIKE '@@%' THEN 'allow' ELSE 'block' END AS verdict
FROM sites
"""

OP11 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), failing AS (
  SELECT doc_id, part, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM docs
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS f
), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS fs
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT array_to_string(list_transform(fs, lambda x: chr(64 + x)), '') AS filter_order, step, fs[step] AS f, fs[:step - 1] AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), judged AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, fails[f] AS fails_it,
         len(list_filter(before, lambda x: fails[x])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) AS n_fails
  FROM masks, steps
), counted AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (NOT gone AND NOT fails_it) AS kept,
         sum(n) FILTER (NOT gone AND fails_it) AS removed,
         sum(n) FILTER (gone AND fails_it) AS redundant,
         sum(n) FILTER (fails_it AND n_fails = 1) AS unique_fails,
         sum(n_good) FILTER (NOT gone AND fails_it) AS good_lost,
         sum(n_toxic) FILTER (NOT gone AND fails_it) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

ORACLES: dict[str, str] = {
    "op5_mixing": OP5,
    "op7_line_dedup": OP7,
    "op9_token_rollup": OP9,
    "op10_url_rules": OP10,
    "op11_filter_audit": OP11,
}
