"""SQL for the queries that SQL can express."""

_PLAIN = r"regexp_matches(trim(last_rate_inr), '^[0-9][0-9,]*(\.[0-9]+)?$')"
_VALUES = f"SELECT category_hint, file_id, CAST(replace(trim(last_rate_inr), ',', '') AS DOUBLE) AS v FROM iocl_materials WHERE {_PLAIN}"

P4 = """
WITH RECURSIVE k AS (SELECT DISTINCT cpse || '|' || upper(trim(material_code)) AS k FROM iocl_materials WHERE trim(material_code) <> ''),
e AS (
  SELECT DISTINCT a_cpse || '|' || upper(trim(a_code)) AS a, b_cpse || '|' || upper(trim(b_code)) AS b FROM match_pairs
  WHERE starts_with(lower(trim(reason)), 'match')
),
ok AS (SELECT a, b FROM e WHERE a <> b AND a IN (SELECT k FROM k) AND b IN (SELECT k FROM k)),
s AS (SELECT a, b FROM ok UNION SELECT b, a FROM ok),
g(node, label) USING KEY (node) AS (
  SELECT a, min(least(a, b)) FROM s GROUP BY a
  UNION
  SELECT s.b, min(g.label) FROM g JOIN s ON s.a = g.node JOIN recurring.g AS r ON r.node = s.b
  WHERE g.label < r.label GROUP BY s.b
)
SELECT split_part(node, '|', 1) AS cpse, substr(node, strpos(node, '|') + 1) AS material_code, label AS group_id FROM g
"""

_P5 = """
WITH v AS ({values}),
r AS (SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY v) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM v)
SELECT {by}, max(n) AS n,
  max(CASE WHEN i = greatest(1, ceil(0.5::DOUBLE * n)) THEN v END) AS p50,
  max(CASE WHEN i = greatest(1, ceil(0.9::DOUBLE * n)) THEN v END) AS p90,
  max(CASE WHEN i = greatest(1, ceil(0.95::DOUBLE * n)) THEN v END) AS p95,
  max(CASE WHEN i = greatest(1, ceil(0.99::DOUBLE * n)) THEN v END) AS p99
FROM r GROUP BY {by}
"""
P5 = _P5.format(values=_VALUES, by="category_hint")
P5_FILES = _P5.format(values=_VALUES, by="category_hint, file_id")

P6 = r"""
WITH m AS (
  SELECT m.cpse, upper(trim(material_code)) AS material_code, rec_id, description, uom, trim(last_rate_inr) AS rate,
    coalesce(f.trust, -1) AS tr, coalesce(epoch_us(extracted_at), -9000000000000000000) AS ts,
    length(regexp_replace(coalesce(description, ''), '[^\p{L}\p{Nd}]', '', 'g')) AS fill
  FROM iocl_materials m LEFT JOIN extract_files f USING (file_id) WHERE trim(material_code) <> ''
),
g AS (SELECT cpse, material_code FROM m GROUP BY ALL HAVING count(*) > 1),
a AS (SELECT m.* FROM m JOIN g USING (cpse, material_code)),
d AS (SELECT cpse, material_code, rec_id AS desc_rec FROM a WHERE trim(coalesce(description, '')) <> ''
  QUALIFY row_number() OVER (PARTITION BY cpse, material_code ORDER BY fill DESC, ts DESC, rec_id) = 1),
u AS (SELECT cpse, material_code, rec_id AS uom_rec FROM a WHERE trim(coalesce(uom, '')) <> ''
  QUALIFY row_number() OVER (PARTITION BY cpse, material_code ORDER BY tr DESC, ts DESC, rec_id) = 1),
r AS (SELECT cpse, material_code, rec_id AS rate_rec FROM a WHERE regexp_matches(rate, '^[0-9][0-9,]*(\.[0-9]+)?$') AND regexp_matches(rate, '[1-9]')
  QUALIFY row_number() OVER (PARTITION BY cpse, material_code ORDER BY ts DESC, rec_id) = 1)
SELECT cpse, material_code, coalesce(desc_rec, 0) AS desc_rec, coalesce(uom_rec, 0) AS uom_rec, coalesce(rate_rec, 0) AS rate_rec
FROM g LEFT JOIN d USING (cpse, material_code) LEFT JOIN u USING (cpse, material_code) LEFT JOIN r USING (cpse, material_code)
"""

ORACLE = {"p4_found": P4, "p5_percentiles": P5, "p5_file_percentiles": P5_FILES, "p6_found": P6}
