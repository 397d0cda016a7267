"""DuckDB-dialect SQL that derives the programme tables from the driver tables.

Used only by the oracle side of the correctness check: it is an independent,
plain-SQL statement of the same mapping as ``strata.sources.tables``.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2001-08-01 00:00:00'"

_BASE = """
p_region AS (SELECT CAST(r_regionkey AS BIGINT) AS region_id, r_name AS region_name FROM region),
p_city AS (SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name,
                  CAST(n_regionkey AS BIGINT) AS region_id FROM nation),
p_cust AS (
  SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation_id,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') THEN c_mktsegment
              ELSE 'unknown' END AS c_mktsegment,
         CAST(c_nationkey AS BIGINT) * 3
           + CASE WHEN c_acctbal < 2500 THEN 0 WHEN c_acctbal < 6500 THEN 1 ELSE 2 END AS community_id,
         CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                                WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 ELSE 0 END AS BIGINT) AS seg
  FROM customer),
p_community AS (SELECT DISTINCT community_id, 'C' || CAST(community_id AS VARCHAR) AS community_name,
                       nation_id AS city_id FROM p_cust),
p_product_type AS (SELECT DISTINCT seg AS product_type_id, c_mktsegment AS product_type_name FROM p_cust),
p_academy AS (SELECT DISTINCT community_id * 10 + seg AS academy_id,
                     'A' || lpad(CAST(community_id * 10 + seg AS VARCHAR), 4, '0') AS academy_code,
                     community_id, seg AS product_type_id FROM p_cust),
p_cohort AS (SELECT c_custkey AS cohort_id, community_id * 10 + seg AS academy_id FROM p_cust),
p_session AS (SELECT o_orderkey AS session_id, o_custkey AS cohort_id, CAST(o_orderdate AS DATE) AS session_date,
                     CAST(20 + (o_orderkey % 9) * 10 AS INTEGER) AS duration_minutes FROM orders),
p_attendance AS (
  SELECT CAST(NULL AS BIGINT) AS attendance_id, l_orderkey AS session_id, l_partkey AS participant_id,
         CASE WHEN l_returnflag = 'N' THEN 'Present' WHEN l_returnflag = 'R' THEN 'absent'
              WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'yes' END AS attendance_status
  FROM lineitem),
p_attendance_n AS (
  SELECT *, coalesce(upper(attendance_status) IN ('TRUE', 'PRESENT', '1', 'YES'), false) AS attended_normalized
  FROM p_attendance),
p_line_orders AS (
  SELECT l_partkey, o_orderkey, o_custkey, o_orderdate, o_orderstatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p_first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate, o_orderkey) AS rn
                 FROM p_line_orders) WHERE rn = 1),
p_last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
                 FROM p_line_orders) WHERE rn = 1),
p_participant AS (
  SELECT f.l_partkey AS participant_id, f.o_custkey AS cohort_id, CAST(f.o_orderdate AS DATE) AS enrollment_date,
         CASE z.o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'inactive' END AS is_active
  FROM p_first f JOIN p_last z ON f.l_partkey = z.l_partkey),
p_participant_n AS (
  SELECT *, coalesce(upper(is_active) IN ('TRUE', 'ACTIVE', '1', 'YES'), false) AS is_active_normalized
  FROM p_participant),
p_skill AS (
  SELECT event_id AS skill_achievement_id, user_id AS participant_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS skill_id, ts AS achieved_at
  FROM events WHERE event_type = 'purchase'),
p_hierarchy AS (
  SELECT a.academy_id, a.academy_code, a.community_id, a.product_type_id, c.community_name, c.city_id,
         ci.city_name, ci.region_id, r.region_name, pt.product_type_name
  FROM p_academy a
  LEFT JOIN p_community c ON a.community_id = c.community_id
  LEFT JOIN p_city ci ON c.city_id = ci.city_id
  LEFT JOIN p_region r ON ci.region_id = r.region_id
  LEFT JOIN p_product_type pt ON a.product_type_id = pt.product_type_id)"""

_SCOPED = """,
s_hierarchy AS (SELECT * FROM p_hierarchy WHERE {where}),
s_cohort AS (SELECT * FROM p_cohort WHERE academy_id IN (SELECT academy_id FROM s_hierarchy)),
s_participant AS (SELECT * FROM p_participant_n WHERE cohort_id IN (SELECT cohort_id FROM s_cohort)),
s_session AS (SELECT * FROM p_session WHERE cohort_id IN (SELECT cohort_id FROM s_cohort)),
s_attendance AS (SELECT * FROM p_attendance_n WHERE session_id IN (SELECT session_id FROM s_session)),
s_skill AS (SELECT * FROM p_skill WHERE participant_id IN (SELECT participant_id FROM s_participant)),
f_attendance AS (
  SELECT a.*, s.session_date, s.duration_minutes, s.cohort_id, h.*
  FROM s_attendance a JOIN s_session s ON a.session_id = s.session_id
  JOIN s_cohort c ON s.cohort_id = c.cohort_id
  JOIN s_hierarchy h ON c.academy_id = h.academy_id)"""


def with_programme(body: str, where: str = "TRUE") -> str:
    """``WITH <programme tables, scoped by where> <body>``; the body may start
    with more CTEs (``, x AS (...) SELECT``) or directly with SELECT."""
    body = body.strip()
    sep = "" if body.startswith(",") else "\n"
    return "WITH " + _BASE + _SCOPED.format(where=where) + sep + body


KPI_SQL = """
SELECT
  (SELECT count(*) FROM s_participant) AS total_participants,
  (SELECT count(*) FILTER (WHERE is_active_normalized) FROM s_participant) AS active_participants,
  (SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE round(sum(datediff('day', enrollment_date, DATE '2001-08-01')) * 1e0
          / nullif(count(enrollment_date), 0), 6) END FROM s_participant) AS avg_days_enrolled,
  (SELECT count(*) FROM s_session) AS total_sessions,
  (SELECT count(DISTINCT session_date) FROM s_session) AS unique_session_days,
  (SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE round(sum(duration_minutes) * 1e0 / nullif(count(duration_minutes), 0), 6)
          END FROM s_session) AS avg_session_duration,
  (SELECT count(*) FROM s_attendance) AS total_attendances,
  (SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE attended_normalized) * 100e0 / count(*), 6)
          END FROM s_attendance) AS attendance_rate,
  (SELECT count(DISTINCT participant_id) FROM s_attendance) AS participants_attended,
  (SELECT count(*) FROM s_skill) AS total_achievements,
  (SELECT count(DISTINCT skill_id) FROM s_skill) AS unique_skills_achieved,
  (SELECT count(DISTINCT participant_id) FROM s_skill) AS participants_with_achievements
"""
