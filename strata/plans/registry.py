"""Registered queries: one Spark builder and (where SQL can say it) one DuckDB
oracle statement per key.  Every builder reads the driver tables (or what Spark
derives from them) in full."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.operators import hierarchy as H
from strata.operators import metrics as M
from strata.operators import scope as SC
from strata.operators import trends as T
from strata.plans.oracle_base import KPI_SQL, with_programme
from strata.sources.tables import Tables, memo_slot, program_tables

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the registered queries: the reference clock ("now") of
# the dashboard data and of the skill events, and the example selections.
AS_OF = dt.datetime(2001, 8, 1)
SKILLS_AS_OF = dt.datetime(2024, 1, 31)
REGION = 0          # region 0 exercises the "id 0 is a real id" fix
ACADEMY = 301
DAYS_BACK = 90


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


class Ctx:
    """Per-call programme tables, hierarchy and scoped tables (all lazy)."""

    def __init__(self, spark: SparkSession, sf_dir: str, scope: SC.Scope | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.tables: Tables = program_tables(spark, sf_dir)
        slot = memo_slot(spark, sf_dir)
        if "hierarchy" not in slot:
            # The hierarchy has one row per academy (small) and feeds nearly
            # every query: keep it cached for the session, like the dashboard's
            # snapshot cache.  A lost block is rebuilt from lineage; ``reload``
            # drops it.
            slot["hierarchy"] = H.build_hierarchy(self.tables).persist()
        self.hierarchy = slot["hierarchy"]
        self.scope = scope or SC.Scope()
        self.scoped = SC.apply_scope(self.tables, self.hierarchy, self.scope)
        self.daily: DataFrame | None = None

    @contextmanager
    def shared_daily(self, wanted: bool = True):
        """Within the block, queries that sum attendance share one aggregate by
        academy and date (academies x days, however many rows attended)."""
        from strata.plans.workload import daily_attendance

        if wanted:
            self.daily = daily_attendance(self).persist()
        try:
            yield self
        finally:
            if wanted:
                self.daily.unpersist()
                self.daily = None

    @contextmanager
    def shared_participants(self, wanted: bool = True):
        """Within the block, queries that read participants share one derivation of them (a row per participant,
        however many rows attended): it is kept by the first that asks."""
        participants = self.tables["participant"]
        wanted = wanted and not participants.is_cached
        if wanted:
            participants.persist()
        try:
            yield self
        finally:
            if wanted:
                participants.unpersist()

    @classmethod
    def of(cls, spark: SparkSession, tables: Tables, hierarchy: DataFrame, scope: SC.Scope | None = None) -> "Ctx":
        """A context over tables that are already loaded (e.g. a dashboard's)."""
        c = cls.__new__(cls)
        c.spark, c.sf_dir, c.tables, c.hierarchy = spark, None, tables, hierarchy
        c.scope = scope or SC.Scope()
        c.scoped = SC.apply_scope(tables, hierarchy, c.scope)
        c.daily = None
        return c


# ---------------------------------------------------------------- dashboard core

@register("weekly_trend", with_programme("""
SELECT CAST(date_trunc('week', s.session_date) AS DATE) AS week,
       count(DISTINCT a.participant_id) AS unique_attendees,
       count(a.participant_id) AS total_attendances,
       round(count(*) FILTER (WHERE a.attended_normalized) * 100e0 / count(*), 6) AS attendance_rate
FROM p_attendance_n a JOIN s_session s ON a.session_id = s.session_id
WHERE CAST(s.session_date AS TIMESTAMP) >= TIMESTAMP '2001-05-03 00:00:00'
GROUP BY 1"""))
def weekly_trend(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return T.attendance_trends(c.tables, c.scoped, AS_OF, DAYS_BACK)


@register("kpi_participants", with_programme("""
SELECT count(*) AS total_participants,
       count(*) FILTER (WHERE is_active_normalized) AS active_participants,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE round(sum(datediff('day', enrollment_date, DATE '2001-08-01')) * 1e0
            / nullif(count(enrollment_date), 0), 6) END AS avg_days_enrolled
FROM s_participant"""))
def kpi_participants(spark, sf_dir):
    return M.participant_kpis(Ctx(spark, sf_dir).scoped, AS_OF)


@register("kpi_sessions", with_programme("""
SELECT count(*) AS total_sessions, count(DISTINCT session_date) AS unique_session_days,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE round(sum(duration_minutes) * 1e0 / nullif(count(duration_minutes), 0), 6)
       END AS avg_session_duration
FROM s_session"""))
def kpi_sessions(spark, sf_dir):
    return M.session_kpis(Ctx(spark, sf_dir).scoped)


@register("kpi_attendance", with_programme("""
SELECT count(*) AS total_attendances,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE attended_normalized) * 100e0 / count(*), 6)
       END AS attendance_rate,
       count(DISTINCT participant_id) AS participants_attended
FROM s_attendance"""))
def kpi_attendance(spark, sf_dir):
    return M.attendance_kpis(Ctx(spark, sf_dir).scoped)


@register("kpi_skills", with_programme("""
SELECT count(*) AS total_achievements, count(DISTINCT skill_id) AS unique_skills_achieved,
       count(DISTINCT participant_id) AS participants_with_achievements
FROM s_skill"""))
def kpi_skills(spark, sf_dir):
    return M.skill_kpis(Ctx(spark, sf_dir).scoped)


@register("kpi_overall", with_programme(KPI_SQL))
def kpi_overall(spark, sf_dir):
    return M.kpis(Ctx(spark, sf_dir).scoped, AS_OF)


@register("drilldown_region", with_programme(KPI_SQL, where=f"region_id = {REGION}"))
def drilldown_region(spark, sf_dir):
    return M.kpis(Ctx(spark, sf_dir, SC.Scope(region_id=REGION)).scoped, AS_OF)


@register("drilldown_academy", with_programme(KPI_SQL, where=f"academy_id = {ACADEMY}"))
def drilldown_academy(spark, sf_dir):
    return M.kpis(Ctx(spark, sf_dir, SC.Scope(academy_id=ACADEMY)).scoped, AS_OF)


CITY, COMMUNITY = 7, 22


@register("drilldown_city", with_programme(KPI_SQL, where=f"city_id = {CITY}"))
def drilldown_city(spark, sf_dir):
    return M.kpis(Ctx(spark, sf_dir, SC.Scope(city_id=CITY)).scoped, AS_OF)


@register("drilldown_community", with_programme(KPI_SQL, where=f"region_id = 2 AND community_id = {COMMUNITY}"))
def drilldown_community(spark, sf_dir):
    """Two filters combined (region and community), as the cascade allows."""
    return M.kpis(Ctx(spark, sf_dir, SC.Scope(region_id=2, community_id=COMMUNITY)).scoped, AS_OF)


@register("weekly_trend_region", with_programme("""
SELECT CAST(date_trunc('week', s.session_date) AS DATE) AS week,
       count(DISTINCT a.participant_id) AS unique_attendees,
       count(a.participant_id) AS total_attendances,
       round(count(*) FILTER (WHERE a.attended_normalized) * 100e0 / count(*), 6) AS attendance_rate
FROM p_attendance_n a JOIN s_session s ON a.session_id = s.session_id
WHERE CAST(s.session_date AS TIMESTAMP) >= TIMESTAMP '2000-08-01 00:00:00'
GROUP BY 1""", where=f"region_id = {REGION}"))
def weekly_trend_region(spark, sf_dir):
    """Region 0 over the longest window the dashboard offers (365 days)."""
    c = Ctx(spark, sf_dir, SC.Scope(region_id=REGION))
    return T.attendance_trends(c.tables, c.scoped, AS_OF, 365)


_ROLLUP_SQL = """,
r_p AS (
  SELECT h.region_id, h.city_id, h.community_id, h.academy_id,
         CAST(GROUPING(h.region_id, h.city_id, h.community_id, h.academy_id) AS BIGINT) AS gid,
         count(*) AS total_participants, count(*) FILTER (WHERE p.is_active_normalized) AS active_participants,
         sum(datediff('day', p.enrollment_date, DATE '2001-08-01')) AS days_sum, count(p.enrollment_date) AS days_n
  FROM p_participant_n p JOIN p_cohort c ON p.cohort_id = c.cohort_id JOIN p_hierarchy h ON c.academy_id = h.academy_id
  GROUP BY ROLLUP (h.region_id, h.city_id, h.community_id, h.academy_id)),
r_s AS (
  SELECT h.region_id, h.city_id, h.community_id, h.academy_id,
         CAST(GROUPING(h.region_id, h.city_id, h.community_id, h.academy_id) AS BIGINT) AS gid,
         count(*) AS total_sessions, count(DISTINCT s.session_date) AS unique_session_days,
         sum(s.duration_minutes) AS dur_sum, count(s.duration_minutes) AS dur_n
  FROM p_session s JOIN p_cohort c ON s.cohort_id = c.cohort_id JOIN p_hierarchy h ON c.academy_id = h.academy_id
  GROUP BY ROLLUP (h.region_id, h.city_id, h.community_id, h.academy_id)),
r_a AS (
  SELECT h.region_id, h.city_id, h.community_id, h.academy_id,
         CAST(GROUPING(h.region_id, h.city_id, h.community_id, h.academy_id) AS BIGINT) AS gid,
         count(*) AS total_attendances, count(*) FILTER (WHERE a.attended_normalized) AS flags_sum,
         count(DISTINCT a.participant_id) AS participants_attended
  FROM p_attendance_n a JOIN p_session s ON a.session_id = s.session_id JOIN p_cohort c ON s.cohort_id = c.cohort_id
  JOIN p_hierarchy h ON c.academy_id = h.academy_id
  GROUP BY ROLLUP (h.region_id, h.city_id, h.community_id, h.academy_id)),
r_k AS (
  SELECT h.region_id, h.city_id, h.community_id, h.academy_id,
         CAST(GROUPING(h.region_id, h.city_id, h.community_id, h.academy_id) AS BIGINT) AS gid,
         count(*) AS total_achievements, count(DISTINCT k.skill_id) AS unique_skills_achieved,
         count(DISTINCT k.participant_id) AS participants_with_achievements
  FROM p_skill k JOIN p_participant_n p ON k.participant_id = p.participant_id
  JOIN p_cohort c ON p.cohort_id = c.cohort_id JOIN p_hierarchy h ON c.academy_id = h.academy_id
  GROUP BY ROLLUP (h.region_id, h.city_id, h.community_id, h.academy_id)),
r_h AS (
  SELECT region_id, city_id, community_id, academy_id,
         CAST(GROUPING(region_id, city_id, community_id, academy_id) AS BIGINT) AS gid
  FROM p_hierarchy GROUP BY ROLLUP (region_id, city_id, community_id, academy_id))
SELECT CASE r_h.gid WHEN 0 THEN 'academy' WHEN 1 THEN 'community' WHEN 3 THEN 'city' WHEN 7 THEN 'region'
                    WHEN 15 THEN 'all' END AS level,
       r_h.region_id, r_h.city_id, r_h.community_id, r_h.academy_id, r_h.gid,
       CAST(coalesce(r_p.total_participants, 0) AS BIGINT) AS total_participants,
       CAST(coalesce(r_p.active_participants, 0) AS BIGINT) AS active_participants,
       CASE WHEN coalesce(r_p.total_participants, 0) = 0 THEN 0.0
            ELSE round(r_p.days_sum * 1e0 / nullif(r_p.days_n, 0), 6) END AS avg_days_enrolled,
       CAST(coalesce(r_s.total_sessions, 0) AS BIGINT) AS total_sessions,
       CAST(coalesce(r_s.unique_session_days, 0) AS BIGINT) AS unique_session_days,
       CASE WHEN coalesce(r_s.total_sessions, 0) = 0 THEN 0.0
            ELSE round(r_s.dur_sum * 1e0 / nullif(r_s.dur_n, 0), 6) END AS avg_session_duration,
       CAST(coalesce(r_a.total_attendances, 0) AS BIGINT) AS total_attendances,
       CASE WHEN coalesce(r_a.total_attendances, 0) = 0 THEN 0.0
            ELSE round(r_a.flags_sum * 100e0 / r_a.total_attendances, 6) END AS attendance_rate,
       CAST(coalesce(r_a.participants_attended, 0) AS BIGINT) AS participants_attended,
       CAST(coalesce(r_k.total_achievements, 0) AS BIGINT) AS total_achievements,
       CAST(coalesce(r_k.unique_skills_achieved, 0) AS BIGINT) AS unique_skills_achieved,
       CAST(coalesce(r_k.participants_with_achievements, 0) AS BIGINT) AS participants_with_achievements
FROM r_h
LEFT JOIN r_p ON r_p.gid = r_h.gid AND r_p.region_id IS NOT DISTINCT FROM r_h.region_id
  AND r_p.city_id IS NOT DISTINCT FROM r_h.city_id AND r_p.community_id IS NOT DISTINCT FROM r_h.community_id
  AND r_p.academy_id IS NOT DISTINCT FROM r_h.academy_id
LEFT JOIN r_s ON r_s.gid = r_h.gid AND r_s.region_id IS NOT DISTINCT FROM r_h.region_id
  AND r_s.city_id IS NOT DISTINCT FROM r_h.city_id AND r_s.community_id IS NOT DISTINCT FROM r_h.community_id
  AND r_s.academy_id IS NOT DISTINCT FROM r_h.academy_id
LEFT JOIN r_a ON r_a.gid = r_h.gid AND r_a.region_id IS NOT DISTINCT FROM r_h.region_id
  AND r_a.city_id IS NOT DISTINCT FROM r_h.city_id AND r_a.community_id IS NOT DISTINCT FROM r_h.community_id
  AND r_a.academy_id IS NOT DISTINCT FROM r_h.academy_id
LEFT JOIN r_k ON r_k.gid = r_h.gid AND r_k.region_id IS NOT DISTINCT FROM r_h.region_id
  AND r_k.city_id IS NOT DISTINCT FROM r_h.city_id AND r_k.community_id IS NOT DISTINCT FROM r_h.community_id
  AND r_k.academy_id IS NOT DISTINCT FROM r_h.academy_id"""


@register("kpi_rollup", with_programme(_ROLLUP_SQL))
def kpi_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    out = M.kpis_rollup(c.tables, c.hierarchy, AS_OF)
    return out.withColumn("gid", F.col("gid").cast("long"))


# ---------------------------------------------------------------- hierarchy, options, scope

@register("hierarchy", with_programme("SELECT * FROM p_hierarchy"))
def hierarchy(spark, sf_dir):
    return Ctx(spark, sf_dir).hierarchy


@register("drilldown_options", with_programme(f"""
SELECT 'region' AS level, 0 AS level_order, region_name AS option_name, min(region_id) AS option_id
FROM p_hierarchy WHERE region_id IS NOT NULL AND region_name IS NOT NULL GROUP BY region_name
UNION ALL
SELECT 'city', 1, city_name, min(city_id) FROM p_hierarchy
WHERE region_id = {REGION} AND city_id IS NOT NULL AND city_name IS NOT NULL GROUP BY city_name
UNION ALL
SELECT 'community', 2, community_name, min(community_id) FROM p_hierarchy
WHERE region_id = {REGION} AND community_id IS NOT NULL AND community_name IS NOT NULL GROUP BY community_name
UNION ALL
SELECT 'academy', 3, academy_code, min(academy_id) FROM p_hierarchy
WHERE region_id = {REGION} AND academy_id IS NOT NULL AND academy_code IS NOT NULL GROUP BY academy_code"""))
def drilldown_options(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return H.drilldown_options(c.hierarchy, SC.Scope(region_id=REGION))


@register("resolve_name", with_programme("""
SELECT academy_code AS option_name, min(academy_id) AS option_id FROM p_hierarchy
WHERE academy_id IS NOT NULL AND academy_code IS NOT NULL GROUP BY academy_code"""))
def resolve_name(spark, sf_dir):
    return H.resolve_names(Ctx(spark, sf_dir).hierarchy, "academy")


@register("attendance_normalized", with_programme("SELECT * FROM p_attendance_n"))
def attendance_normalized(spark, sf_dir):
    return SC.attendance_normalized(Ctx(spark, sf_dir).tables)


@register("participants_normalized", with_programme("SELECT * FROM p_participant_n"))
def participants_normalized(spark, sf_dir):
    return SC.participants_normalized(Ctx(spark, sf_dir).tables)


_REGION_WHERE = f"region_id = {REGION}"


@register("scoped_cohorts", with_programme("SELECT * FROM s_cohort", where=_REGION_WHERE))
def scoped_cohorts(spark, sf_dir):
    return Ctx(spark, sf_dir, SC.Scope(region_id=REGION)).scoped.cohorts


@register("scoped_participants", with_programme("SELECT * FROM s_participant", where=_REGION_WHERE))
def scoped_participants(spark, sf_dir):
    return Ctx(spark, sf_dir, SC.Scope(region_id=REGION)).scoped.participants


@register("scoped_sessions", with_programme("SELECT * FROM s_session", where=_REGION_WHERE))
def scoped_sessions(spark, sf_dir):
    return Ctx(spark, sf_dir, SC.Scope(region_id=REGION)).scoped.sessions


@register("scoped_attendance", with_programme("SELECT * FROM s_attendance", where=_REGION_WHERE))
def scoped_attendance(spark, sf_dir):
    return Ctx(spark, sf_dir, SC.Scope(region_id=REGION)).scoped.attendance


@register("scoped_skills", with_programme("SELECT * FROM s_skill", where=_REGION_WHERE))
def scoped_skills(spark, sf_dir):
    return Ctx(spark, sf_dir, SC.Scope(region_id=REGION)).scoped.skills


@register("sessions_in_range", with_programme("""
SELECT * FROM s_session WHERE session_date BETWEEN DATE '2001-07-01' AND DATE '2001-07-31'"""))
def sessions_in_range(spark, sf_dir):
    return SC.sessions_in_range(Ctx(spark, sf_dir).scoped.sessions, dt.date(2001, 7, 1), dt.date(2001, 7, 31))


@register("product_mix", with_programme("""
SELECT product_type_name, count(*) AS academy_count
FROM (SELECT DISTINCT academy_id, product_type_name FROM s_hierarchy) WHERE product_type_name IS NOT NULL
GROUP BY product_type_name"""))
def product_mix(spark, sf_dir):
    return T.product_mix(Ctx(spark, sf_dir).scoped)


@register("product_mix_share", with_programme("""
SELECT product_type_name, count(*) AS academy_count,
       round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS share_pct
FROM (SELECT DISTINCT academy_id, product_type_name FROM s_hierarchy) WHERE product_type_name IS NOT NULL
GROUP BY product_type_name"""))
def product_mix_share(spark, sf_dir):
    return T.product_mix_share(Ctx(spark, sf_dir).scoped)


@register("top_academies_by_cohorts", with_programme("""
SELECT c.academy_id, h.academy_code, count(*) AS cohort_count
FROM s_cohort c LEFT JOIN (SELECT DISTINCT academy_id, academy_code FROM s_hierarchy) h ON c.academy_id = h.academy_id
GROUP BY c.academy_id, h.academy_code ORDER BY cohort_count DESC, c.academy_id LIMIT 10"""))
def top_academies_by_cohorts(spark, sf_dir):
    return T.top_academies_by_cohorts(Ctx(spark, sf_dir).scoped, 10)
