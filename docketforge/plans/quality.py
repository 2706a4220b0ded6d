"""Registered queries of the column profile."""

from __future__ import annotations

from docketforge.operators import profile
from docketforge.sources.tables import table


def _p6_found(s, d):
    return profile.found(table(s, d, "pair_records"), table(s, d, "subjects"))


def _p6_profile(s, d):
    return profile.pair_profile(table(s, d, "pair_records"), table(s, d, "subjects"))


QUERIES = {"p6_found": _p6_found, "p6_profile": _p6_profile}
SQL = {
    "p6_found": """
WITH r AS (
  SELECT load_id, 'question_type' AS column_name, question_type AS v, NULL AS x, question_type IN ('facts','procedural','legal_principle','holding','outcome') AS ok FROM pair_records
  UNION ALL SELECT load_id, 'category', category, NULL, category IN (SELECT subject FROM subjects) FROM pair_records
  UNION ALL SELECT load_id, 'span_start', CAST(span_start AS VARCHAR), span_start, coalesce(span_start >= 0 AND span_start < span_end, false) FROM pair_records
), b AS (
  SELECT load_id, column_name, count(*) AS n, count(v) AS there, count(*) FILTER (WHERE v IS NOT NULL AND NOT ok) AS bad, median(x) FILTER (WHERE ok) AS med FROM r GROUP BY ALL
), c AS (
  SELECT *, 1 - there / n AS nr, lag(1 - there / n) OVER w AS was_nr, lag(med) OVER w AS was_med, row_number() OVER w AS k FROM b WINDOW w AS (PARTITION BY column_name ORDER BY load_id)
), vs AS (
  SELECT b.load_id, b.column_name, d.v, coalesce(s.m, 0) / nullif(b.there - b.bad, 0) AS share
  FROM b JOIN (SELECT DISTINCT column_name, v FROM r WHERE ok AND column_name <> 'span_start') d USING (column_name)
  LEFT JOIN (SELECT load_id, column_name, v, count(*) AS m FROM r WHERE ok GROUP BY ALL) s ON s.load_id = b.load_id AND s.column_name = b.column_name AND s.v = d.v
), vc AS (
  SELECT load_id, column_name, abs(share - lag(share) OVER (PARTITION BY column_name, v ORDER BY load_id)) AS moved FROM vs
)
SELECT load_id, column_name, CASE WHEN column_name = 'span_start' THEN 'value_range' ELSE 'pattern' END AS issue FROM c WHERE bad / nullif(there, 0) >= 0.01
UNION SELECT load_id, column_name, 'null_rate' FROM c WHERE abs(nr - was_nr) > 0.10
UNION SELECT load_id, column_name, 'distribution' FROM vc WHERE moved > 0.15
UNION SELECT load_id, column_name, 'distribution' FROM c WHERE was_med > 0 AND (med / was_med > 1.6 OR med / was_med < 1 / 1.6)
"""
}
