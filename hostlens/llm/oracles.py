"""DuckDB SQL for the queries that SQL can express; each from the definitions, not from the code."""

from __future__ import annotations

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]{24,}"), ("token", "[A-Za-z0-9+/_=-]{20,}"))


def _matches(kind: str, pattern: str, rank: int) -> str:
    """Matches with their positions: running sums of the lengths of what is between and of them."""
    value = f"regexp_extract(m, '{pattern}', 1)" if kind == "assign" else "m"
    return f"""
    SELECT row, doc_id, source, '{kind}' AS kind, {rank} AS rank, s AS start, s + length(m) AS stop, {value} AS v
    FROM (SELECT row, doc_id, source, ms[i] AS m,
            (list_sum(list_transform(cuts[1:i], lambda c: length(c))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda c: length(c))), 0))::BIGINT AS s
          FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i
                FROM (SELECT row, doc_id, source, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS cuts FROM texts)))"""


SECRETS = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_matches(k, p, i) for i, (k, p) in enumerate(KINDS))}),
base AS (SELECT * FROM found WHERE CASE kind WHEN 'assign' THEN length(v) >= 6 WHEN 'access' THEN length(v) >= 20 WHEN 'hex' THEN true END),
tokens AS (SELECT * FROM found f WHERE kind = 'token' AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
  AND len(list_distinct(string_split(v, ''))) >= 10
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = f.row AND b.start < f.stop AND f.start < b.stop)),
both_ AS (SELECT * FROM base UNION ALL SELECT * FROM tokens),
usage AS (SELECT v, count(DISTINCT source) >= 3 AS copied, bool_or(kind <> 'token') AS named FROM both_ GROUP BY v),
kept AS (SELECT b.*, copied FROM both_ b JOIN usage USING (v) WHERE kind <> 'token' OR NOT copied OR named),
spans AS (SELECT row, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'token'), '') AS base,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied FROM kept GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM texts LEFT JOIN spans USING (row)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY h)"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v))::BIGINT AS p FROM every JOIN size USING (lang)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (m + 5)) // (sum(m) OVER (PARTITION BY lang) + 5 * v))::BIGINT AS q
      FROM (SELECT lang, term, sum(n) AS m FROM every GROUP BY ALL) JOIN size USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) GROUP BY ALL),
both_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM (SELECT DISTINCT lang, source FROM d) a JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_) WHERE part = 'pair' OR rank <= 50"""

HARD_NEGATIVES = """
WITH x AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM x a JOIN x b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor, anchor_id, r, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY pos.anchor, pos.r ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM pos JOIN s USING (anchor, anchor_id) WHERE NOT same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score
QUALIFY rank <= 5"""
