"""DuckDB SQL for those of the subpackage's queries that SQL can say."""

from __future__ import annotations

_LANGUAGE = r"""
WITH folded AS (
  SELECT doc_id, lang, chr(1) || trim(regexp_replace(lower(text), '[^\p{L}]+', chr(1), 'g'), chr(1)) || chr(1) AS t FROM documents WHERE text IS NOT NULL
),
chars AS (SELECT doc_id, lang, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS pos FROM folded WHERE length(t) > 2),
near AS (SELECT doc_id, lang, c, lead(c) OVER w AS c1, lead(c, 2) OVER w AS c2 FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (
  SELECT doc_id, lang, c AS g FROM near WHERE c <> chr(1)
  UNION ALL SELECT doc_id, lang, c || c1 FROM near WHERE c1 IS NOT NULL
  UNION ALL SELECT doc_id, lang, c || c1 || c2 FROM near WHERE c2 IS NOT NULL AND c1 <> chr(1)
),
own AS (SELECT doc_id, any_value(lang) AS lang, g, count(*) AS n FROM grams GROUP BY doc_id, g),
profile AS (
  SELECT lang, g, rank FROM (
    SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS rank FROM own WHERE lang IS NOT NULL GROUP BY lang, g
  ) WHERE rank < 300
),
mine AS (SELECT doc_id, g, rank FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS rank FROM own) WHERE rank < 300),
apart AS (
  SELECT m.doc_id, l.lang, sum(coalesce(abs(m.rank - p.rank), 300)) AS distance
  FROM mine m CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = m.g GROUP BY m.doc_id, l.lang
),
best AS (SELECT doc_id, lang, distance, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS rn FROM apart)
SELECT d.doc_id, b.lang AS language, CAST(coalesce(b.distance, 0) AS BIGINT) AS distance FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.rn = 1
"""

_URLS = r"""
WITH bare AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', ''), '(\.html?)?/*$', '') AS u FROM pages
),
keyed AS (SELECT *, nullif(regexp_replace(lower(regexp_extract(u, '^[^/]*')), '^(www|m)\.', '') || regexp_extract(u, '/.*$'), '') AS key FROM bare),
listed AS (SELECT DISTINCT key FROM keyed WHERE key IS NOT NULL AND (contains(html, '%%%') OR contains(html, '***')))
SELECT page_id, url, l.key IS NOT NULL AS blocked FROM keyed k LEFT JOIN listed l ON k.key = l.key
"""

_MIXING = """
WITH s AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS w FROM documents GROUP BY source),
rates AS (
  SELECT source, CAST(floor((SELECT sum(n) FROM s) * w / (SELECT sum(w ORDER BY source) FROM s) / n * 1000000 + 0.5) AS BIGINT) AS e,
    CAST('0x' || substr(md5('13:' || coalesce(source, chr(0))), 1, 8) AS BIGINT) % 1000000 AS o FROM s
),
sums AS (
  SELECT d.doc_id, d.source, e, CAST(o + sum(e) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) AS BIGINT) AS upto
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, source, CAST(unnest(range(1, upto // 1000000 - (upto - e) // 1000000 + 1)) AS INTEGER) AS copy FROM sums
"""

_EXACT = """
SELECT min(doc_id) AS doc_id, CAST(0 AS INTEGER) AS part, count(*) AS n_copies, list(doc_id ORDER BY doc_id) AS copies
FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL) GROUP BY text, CASE WHEN text IS NULL THEN doc_id END
"""

ORACLES: dict[str, str] = {"op2_language_id": _LANGUAGE, "op6_url_filters": _URLS, "op9_mixing": _MIXING, "op10_exact_dedup": _EXACT}
