"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from treelens.llm.quality import ALPHA, CUTOFFS, DELTA

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SCORES = {
    "word_length": "word_chars::DOUBLE / greatest(n_words, 1)",
    "symbol_share": "n_symbols::DOUBLE / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines * 5.0::DOUBLE / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
}
_TESTS = ", ".join(f"('{rule}', {x}::DOUBLE)" for rule, xs in CUTOFFS.items() for x in xs)
_RULES = ", ".join(f"{{'rule': '{rule}', 'score': {score}}}" for rule, score in _SCORES.items())
_SHARE = ALPHA / len(CUTOFFS)

ORACLES = {
    "op1_suffix_dedup": rf"""
WITH w50 AS (SELECT doc_id, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i
  FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents))),
far AS (SELECT k FROM w50 GROUP BY k HAVING min(doc_id) <> max(doc_id)),
share AS (SELECT DISTINCT doc_id FROM w50 SEMI JOIN far USING (k)),
d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, s, md5(b[s + 1 : s + 400]) AS k FROM (SELECT r, b, unnest(range(octet_length(b) - 399)) AS s FROM d)),
rep AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
n AS (SELECT r, s, coalesce(s - lag(s) OVER (PARTITION BY r ORDER BY s) > 400, true) AS fresh FROM rep),
g AS (SELECT r, s, sum(fresh::INT) OVER (PARTITION BY r ORDER BY s) AS g FROM n),
runs AS (SELECT r, min(s) AS s, max(s) + 400 AS e FROM g GROUP BY r, g),
gaps AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS z FROM runs),
kept AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(hex(b[z + 1 : s]), '' ORDER BY s) || hex(any_value(b)[max(e) + 1 : octet_length(any_value(b))]) AS h
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(coalesce(unhex(h), b)) AS kept_sha256, doc_id IN (SELECT doc_id FROM share) AS shares_50_words FROM d LEFT JOIN kept USING (r)""",
    "op6_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS k FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) + any_value(b.n) AS n FROM x a JOIN x b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n - c)),
t AS (SELECT doc_id AS id, doc_id AS root FROM sets UNION SELECT b, root FROM t JOIN links ON a = id),
c AS (SELECT id, min(root) AS component_id FROM t GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN c ON id = doc_id""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
i AS (SELECT r, i, md5(array_to_string(ws[i : i + 4], ' ')) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM i) WHERE c > 1),
rep AS (SELECT r, sum(n)::BIGINT AS n_repeat_words FROM (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM twice) GROUP BY 1),
m AS (SELECT doc_id, lang, r, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
   - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
s AS (SELECT r, doc_id, lang, u.rule, u.score FROM (SELECT r, doc_id, lang, unnest([{_RULES}]) AS u FROM b WHERE NOT base_failed)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1 AND max(quality) = 1),
tests(rule, x) AS (VALUES {_TESTS}),
k AS (SELECT lang, rule, x, count(*) AS n, count(*) FILTER (WHERE score > x) AS k FROM s JOIN good USING (doc_id) JOIN tests USING (rule) GROUP BY 1, 2, 3),
ok AS (SELECT lang, rule, min(x) AS x FROM k WHERE k < {_SHARE}::DOUBLE * n AND list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
  + j * ln({_SHARE}::DOUBLE) + (n - j) * ln(1 - {_SHARE}::DOUBLE)))) <= {DELTA}::DOUBLE / ((SELECT count(DISTINCT coalesce(lang, '')) + 0 FROM k) * (SELECT count(*) FROM tests)) GROUP BY 1, 2),
bad AS (SELECT DISTINCT r FROM s JOIN ok ON s.rule = ok.rule AND s.lang IS NOT DISTINCT FROM ok.lang WHERE score > x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM b LEFT JOIN bad ON b.r = bad.r""",
    "op3_url_filters": r"""
WITH rules(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, url,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id, url
  ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS n
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) m USING (page_id)""",
    "op7_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1]::DOUBLE AS weight,
  [0.0, 0.5, -0.5][(rank - 1) % 3 + 1]::DOUBLE AS slope,
  sum(source_size) OVER ()::DOUBLE * 1.5 AS total, source_size * 2.0::DOUBLE AS most FROM s),
f AS (SELECT *, most * sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (total - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full FROM w),
t AS (SELECT source, source_size, slope, CASE WHEN is_full THEN most ELSE
  (total - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) * weight / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target FROM f),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
  (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::DOUBLE - size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 THEN greatest(ceil((target - middle) / greatest(source_size, 1)), 0) ELSE 0 END AS copies FROM m)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN middle / target ELSE
    (sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * (middle / target)) - (1.0::DOUBLE - slope)) / (2.0::DOUBLE * slope) END, 9) END AS first_position
FROM c""",
}
