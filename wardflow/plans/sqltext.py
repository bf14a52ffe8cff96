"""Shared DuckDB text for the oracle queries (the driver runs them on its views)."""

from __future__ import annotations

from wardflow.functions.scalar import lehmer_sql
from wardflow.sources.standins import EPOCH, EVENT_VITALS, ICU_SEGMENTS, SENTINEL_EVERY, TIME_BUCKET_MIN


def values_list(items, alias: str, col: str) -> str:
    vals = ", ".join(f"('{v}')" for v in items)
    return f"(VALUES {vals}) {alias}({col})"


READINGS = f"""readings AS (
  SELECT user_id AS record_id,
         CAST(((epoch_us(ts) - epoch_us(TIMESTAMP '{EPOCH}')) // 60000000 // {TIME_BUCKET_MIN}) * {TIME_BUCKET_MIN} AS INTEGER) AS t,
         event_type AS parameter,
         CASE WHEN event_id % {SENTINEL_EVERY} = 0 THEN -1.0 ELSE value END AS value
  FROM events)"""

CELLS = """cells AS (
  SELECT record_id, t, parameter, nullif(avg(value), -1.0) AS value
  FROM readings WHERE parameter IS NOT NULL GROUP BY record_id, t, parameter)"""

RECORDS = "recs AS (SELECT DISTINCT user_id AS record_id FROM events)"

ALL_RECORDS = """recs AS (SELECT user_id AS record_id FROM events UNION SELECT c_custkey AS record_id FROM customer)"""

SPINE = f"""spine AS (
  SELECT r.record_id, v.parameter FROM recs r, {values_list(EVENT_VITALS, 'v', 'parameter')})"""

AGG = """agg AS (
  SELECT s.record_id, s.parameter,
    avg(c.value) AS "mean", quantile_cont(c.value, 0.5) AS "median",
    min(c.value) AS "min", max(c.value) AS "max", stddev_pop(c.value) AS "std",
    arg_min(c.value, c.t) FILTER (WHERE c.value IS NOT NULL) AS "first",
    arg_max(c.value, c.t) FILTER (WHERE c.value IS NOT NULL) AS "last",
    CAST(CASE WHEN count(c.value) = 0 THEN 1 ELSE 0 END AS DOUBLE) AS "missing"
  FROM spine s LEFT JOIN cells c ON c.record_id = s.record_id AND c.parameter = s.parameter
  GROUP BY s.record_id, s.parameter),
agg2 AS (SELECT *, "last" - "first" AS "delta", "max" - "min" AS "range" FROM agg)"""

SUFFIX_ORDER = ("mean", "median", "min", "max", "std", "first", "last", "missing", "delta", "range")


def long_union(src: str, cols=SUFFIX_ORDER, base: str = "parameter") -> str:
    parts = [
        f"SELECT record_id, {base} || '_{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS value FROM {src}" for c in cols
    ]
    return "\n  UNION ALL ".join(parts)


LONG = f"""long AS (
  {long_union('agg2')})"""

MEDIANS = """med AS (SELECT feature, quantile_cont(value, 0.5) AS m FROM long GROUP BY feature)"""

FEATURES = """feat AS (
  SELECT l.record_id, l.feature, coalesce(l.value, med.m) AS value FROM long l LEFT JOIN med USING (feature))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


VITAL_CTES = (READINGS, CELLS, RECORDS, SPINE, AGG, LONG, MEDIANS, FEATURES)


def icu_case(col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in ICU_SEGMENTS.items())
    return f"CASE {whens} ELSE NULL END"


DESCRIPTOR_CELLS = f"""dcells AS (
  SELECT c_custkey AS record_id, 0 AS t, p.parameter,
    CASE p.parameter
      WHEN 'Weight' THEN CASE WHEN c_custkey % 10 = 9 THEN -1.0 ELSE c_acctbal END
      WHEN 'Gender' THEN CASE WHEN c_custkey % 7 = 3 THEN -1.0 ELSE CAST(c_nationkey % 2 AS DOUBLE) END
      WHEN 'Age' THEN CAST(20 + c_nationkey * 3 AS DOUBLE)
      WHEN 'Height' THEN CAST(150 + c_custkey % 50 AS DOUBLE)
      WHEN 'ICUType' THEN {icu_case('c_mktsegment')}
    END AS value
  FROM customer, {values_list(('Weight', 'Gender', 'Age', 'Height', 'ICUType'), 'p', 'parameter')}
  WHERE c_custkey IN (SELECT record_id FROM recs))"""


def split_sql(col: str) -> str:
    k = f"({lehmer_sql(col, seed=7)} % 3)"
    return f"CASE WHEN {k} = 0 THEN 'a' WHEN {k} = 1 THEN 'b' ELSE 'c' END"
