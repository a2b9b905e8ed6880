"""SQL for the core's queries that SQL can express."""

from weftline.plans import catalogue_queries, match_queries

_F = r'(?:"(?:[^"]|"")*"|[^",]*)'
_FIELD = r'("(?:[^"]|"")*"|[^",]*)'
_SEVEN = "^" + ",".join([_FIELD] * 7) + "$"
_RAW = rf"""
WITH x AS (SELECT line_id, coalesce(raw_line, '') AS l FROM raw_lines),
s AS (
  SELECT line_id, regexp_full_match(l, '{_F}(?:,{_F})*', 's') AS sound, regexp_full_match(l, '{"," .join([_F] * 7)}', 's') AS seven,
    regexp_extract(l, '{_SEVEN}', ['f0', 'f1', 'f2', 'f3', 'f4', 'f5', 'f6'], 's') AS f
  FROM x
),
u AS (
  SELECT line_id, sound, seven,
    {", ".join(f"CASE WHEN f.f{k} LIKE '\"%' THEN replace(substr(f.f{k}, 2, length(f.f{k}) - 2), '\"\"', '\"') ELSE f.f{k} END AS c{k}" for k in range(7))}
  FROM s
),
v AS (
  SELECT *, CASE WHEN NOT sound THEN 'broken_quoting' WHEN NOT seven THEN 'column_count'
    WHEN NOT regexp_full_match(trim(c1), '[A-Za-z0-9./-]+') THEN 'bad_code'
    WHEN NOT regexp_matches(c2, '\p{{L}}') THEN 'bad_description'
    WHEN NOT (trim(c6) IN ('', 'N/A', '-') OR regexp_full_match(trim(c6), '[0-9][0-9,]*(\.[0-9]+)?')) THEN 'bad_rate' END AS reason
  FROM u
)
"""

P1_FOUND = _RAW + "SELECT line_id, reason FROM v WHERE reason IS NOT NULL"
P1_VALID = (
    _RAW
    + """SELECT line_id, nullif(trim(c0), '') AS cpse, nullif(trim(c1), '') AS material_code, nullif(trim(c2), '') AS description,
  nullif(trim(c3), '') AS uom, nullif(trim(c4), '') AS category_hint, nullif(trim(c5), '') AS hsn_code,
  TRY_CAST(replace(trim(c6), ',', '') AS DECIMAL(38, 6)) AS last_rate_inr FROM v WHERE reason IS NULL"""
)

ORACLE = {"p1_found": P1_FOUND, "p1_valid": P1_VALID, **catalogue_queries.ORACLE, **match_queries.ORACLE}
