"""The dashboard's example questions, answered by real queries (K1-K13).

F = attendance -> session -> cohort -> hierarchy.  Attendance is first reduced
to one row per session (rows, present rows): a map-side combined aggregation,
so a session holding a third of all rows still ships one row per task, and the
join to sessions then meets one row per key on both sides.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from strata.functions.dates import as_datetime, month_index, wall_clock
from strata.operators.metrics import kpis, stack_parts
from strata.operators.scope import Scope, apply_scope, attendance_in, attendance_normalized, sessions_since
from strata.plans.oracle_base import with_programme
from strata.plans.registry import AS_OF, SKILLS_AS_OF, Ctx, register

# Weekday names in Spark's weekday() order (Monday = 0).
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _pct(num, den) -> F.Column:
    return F.round(F.try_divide(F.col(num).cast("double") * 100, F.col(den)), 6)


def session_attendance(c: Ctx) -> DataFrame:
    """Per scoped session: attendance rows and present rows, with the session's
    cohort, date and academy."""
    sessions = c.scoped.sessions.select("session_id", "cohort_id", "session_date")
    rows = attendance_normalized(c.tables)
    if c.scope != Scope():  # a scope cuts the rows before they are aggregated
        rows = rows.join(sessions.select("session_id"), "session_id", "left_semi")
    per_session = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("attended_normalized").alias("flags"))
    return (per_session.join(sessions, "session_id")
            .join(c.scoped.cohorts.select("cohort_id", "academy_id"), "cohort_id"))


def daily_attendance(c: Ctx) -> DataFrame:
    """Attendance rows and present rows per (academy, session date)."""
    return (session_attendance(c).groupBy("academy_id", "session_date")
            .agg(F.sum("rows").alias("rows"), F.sum("flags").alias("flags")))


def _attendance(c: Ctx) -> DataFrame:
    """Partial counts with academy and date: the shared aggregate if there is one."""
    return c.daily if c.daily is not None else session_attendance(c)


def academy_rates(c: Ctx) -> DataFrame:
    per_academy = (_attendance(c).groupBy("academy_id")
                   .agg(F.sum("rows").alias("attendance_rows"), F.sum("flags").alias("flags")))
    return (per_academy.join(c.scoped.hierarchy.select("academy_id", "academy_code"), "academy_id")
            .select("academy_id", "academy_code", "attendance_rows",
                    _pct("flags", "attendance_rows").alias("attendance_rate")))


_ACADEMY_RATE_SQL = """
SELECT academy_id, academy_code, count(*) AS attendance_rows,
       round(count(*) FILTER (WHERE attended_normalized) * 100e0 / count(*), 6) AS attendance_rate
FROM f_attendance GROUP BY academy_id, academy_code
ORDER BY attendance_rate {dir}, academy_code LIMIT 1"""


@register("k01_attendance_highest", with_programme(_ACADEMY_RATE_SQL.format(dir="DESC")))
def k01_attendance_highest(spark, sf_dir):
    return k01_in(Ctx(spark, sf_dir))


def k01_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    return academy_rates(c).orderBy(F.desc("attendance_rate"), "academy_code").limit(1)


@register("k02_attendance_lowest", with_programme(_ACADEMY_RATE_SQL.format(dir="ASC")))
def k02_attendance_lowest(spark, sf_dir):
    return k02_in(Ctx(spark, sf_dir))


def k02_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    return academy_rates(c).orderBy(F.asc("attendance_rate"), "academy_code").limit(1)


def inactive_participants(c: Ctx, as_of, days: int = 30) -> DataFrame:
    """Participants of the scope with no present attendance, in any session of
    the programme, in the last ``days`` days.  The scope narrows the
    participants, not the evidence.  The recent side is filtered by date, then
    de-duplicated: the right side of an anti join is never split, so a hot
    participant must not fill it."""
    everywhere = apply_scope(c.tables, c.hierarchy).sessions
    recent = (attendance_in(c.tables, sessions_since(everywhere, as_of, days), as_of, days).filter("attended_normalized")
              .select("participant_id").distinct())
    return (c.scoped.participants.join(recent, "participant_id", "left_anti")
            .select("participant_id", "cohort_id", "enrollment_date", "is_active"))


@register("k03_inactive_participants", with_programme("""
SELECT participant_id, cohort_id, enrollment_date, is_active FROM s_participant p
WHERE NOT EXISTS (SELECT 1 FROM f_attendance f WHERE f.participant_id = p.participant_id AND f.attended_normalized
                  AND CAST(f.session_date AS TIMESTAMP) >= TIMESTAMP '2001-07-02 00:00:00')"""))
def k03_inactive_participants(spark, sf_dir):
    return k03_in(Ctx(spark, sf_dir))


def k03_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    return inactive_participants(c, as_of, 30)


@register("k03_inactive_region", with_programme("""
, everywhere AS (SELECT a.participant_id FROM p_attendance_n a JOIN p_session s ON a.session_id = s.session_id
    JOIN p_cohort c ON s.cohort_id = c.cohort_id JOIN p_hierarchy h ON c.academy_id = h.academy_id
    WHERE a.attended_normalized AND CAST(s.session_date AS TIMESTAMP) >= TIMESTAMP '2001-07-02 00:00:00')
SELECT participant_id, cohort_id, enrollment_date, is_active FROM s_participant p
WHERE participant_id NOT IN (SELECT participant_id FROM everywhere WHERE participant_id IS NOT NULL)""", where="region_id = 0"))
def k03_inactive_region(spark, sf_dir):
    from strata.operators.scope import Scope

    return k03_in(Ctx(spark, sf_dir, Scope(region_id=0)))


@register("k04_duration_by_region", with_programme("""
SELECT h.region_id, h.region_name, count(*) AS sessions,
       round(sum(s.duration_minutes) * 1e0 / nullif(count(s.duration_minutes), 0), 6) AS avg_duration,
       round(count(*) FILTER (WHERE s.duration_minutes < 30) * 100e0 / nullif(count(s.duration_minutes), 0), 6)
         AS pct_short,
       round(count(*) FILTER (WHERE s.duration_minutes BETWEEN 30 AND 60) * 100e0
             / nullif(count(s.duration_minutes), 0), 6) AS pct_standard,
       round(count(*) FILTER (WHERE s.duration_minutes > 60) * 100e0 / nullif(count(s.duration_minutes), 0), 6)
         AS pct_extended
FROM s_session s JOIN s_cohort c ON s.cohort_id = c.cohort_id JOIN s_hierarchy h ON c.academy_id = h.academy_id
GROUP BY h.region_id, h.region_name"""))
def k04_duration_by_region(spark, sf_dir):
    return k04_in(Ctx(spark, sf_dir))


def k04_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    d = F.col("duration_minutes")
    per_cohort = c.scoped.sessions.groupBy("cohort_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(d).alias("dur_sum"), F.count(d).alias("dur_n"),
        F.count_if(d < 30).alias("short"), F.count_if(d.between(30, 60)).alias("standard"),
        F.count_if(d > 60).alias("extended"))
    per_region = (per_cohort.join(c.scoped.cohorts.select("cohort_id", "academy_id"), "cohort_id")
                  .join(c.scoped.hierarchy.select("academy_id", "region_id", "region_name"), "academy_id")
                  .groupBy("region_id", "region_name")
                  .agg(*[F.sum(x).alias(x) for x in ("sessions", "dur_sum", "dur_n", "short", "standard",
                                                     "extended")]))
    return per_region.select(
        "region_id", "region_name", "sessions",
        F.round(F.try_divide(F.col("dur_sum").cast("double"), F.col("dur_n")), 6).alias("avg_duration"),
        _pct("short", "dur_n").alias("pct_short"), _pct("standard", "dur_n").alias("pct_standard"),
        _pct("extended", "dur_n").alias("pct_extended"))


@register("k05_top_skilled", with_programme("""
SELECT participant_id, count(DISTINCT skill_id) AS skills_achieved, count(*) AS achievements
FROM s_skill GROUP BY participant_id ORDER BY skills_achieved DESC, participant_id LIMIT 5"""))
def k05_top_skilled(spark, sf_dir):
    return k05_in(Ctx(spark, sf_dir))


def k05_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    return (c.scoped.skills.groupBy("participant_id")
            .agg(F.count_distinct("skill_id").alias("skills_achieved"), F.count(F.lit(1)).alias("achievements"))
            .orderBy(F.desc("skills_achieved"), "participant_id").limit(5))


@register("k06_lowest_skill_rate", with_programme("""
, per_p AS (SELECT participant_id, count(*) AS n FROM s_skill GROUP BY participant_id)
SELECT c.academy_id, h.academy_code, count(*) AS participants, CAST(coalesce(sum(pp.n), 0) AS BIGINT) AS achievements,
       round(coalesce(sum(pp.n), 0) * 1e0 / count(*), 6) AS skill_rate
FROM s_participant p LEFT JOIN per_p pp ON p.participant_id = pp.participant_id
JOIN s_cohort c ON p.cohort_id = c.cohort_id JOIN s_hierarchy h ON c.academy_id = h.academy_id
GROUP BY c.academy_id, h.academy_code ORDER BY skill_rate, h.academy_code LIMIT 5"""))
def k06_lowest_skill_rate(spark, sf_dir):
    return k06_in(Ctx(spark, sf_dir))


def k06_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    per_participant = c.scoped.skills.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"))
    per_academy = (c.scoped.participants.select("participant_id", "cohort_id")
                   .join(per_participant, "participant_id", "left")
                   .join(c.scoped.cohorts.select("cohort_id", "academy_id"), "cohort_id")
                   .groupBy("academy_id")
                   .agg(F.count(F.lit(1)).alias("participants"),
                        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("achievements")))
    return (per_academy.join(c.scoped.hierarchy.select("academy_id", "academy_code"), "academy_id")
            .select("academy_id", "academy_code", "participants", "achievements",
                    F.round(F.col("achievements").cast("double") / F.col("participants"), 6).alias("skill_rate"))
            .orderBy("skill_rate", "academy_code").limit(5))


@register("k07_top_skills", with_programme("""
SELECT skill_id, count(*) AS achievements FROM s_skill
WHERE achieved_at >= TIMESTAMP '2024-01-01 00:00:00' AND achieved_at < TIMESTAMP '2024-01-31 00:00:00'
GROUP BY skill_id ORDER BY achievements DESC, skill_id LIMIT 5"""))
def k07_top_skills(spark, sf_dir):
    return k07_in(Ctx(spark, sf_dir))


def k07_in(c: Ctx, as_of=SKILLS_AS_OF) -> DataFrame:
    as_of = as_datetime(as_of)
    start = dt.datetime(as_of.year, as_of.month, 1)
    return (c.scoped.skills
            .filter((F.col("achieved_at") >= wall_clock(start)) & (F.col("achieved_at") < wall_clock(as_of)))
            .groupBy("skill_id").agg(F.count(F.lit(1)).alias("achievements"))
            .orderBy(F.desc("achievements"), "skill_id").limit(5))


def last_week_bounds(as_of) -> tuple[dt.date, dt.date]:
    d = as_datetime(as_of).date()
    start = d - dt.timedelta(days=d.weekday() + 7)
    return start, start + dt.timedelta(days=6)


@register("k08_last_week", with_programme("""
, w AS (SELECT * FROM s_session WHERE session_date BETWEEN DATE '2001-07-23' AND DATE '2001-07-29'),
  sa AS (SELECT count(*) AS attendance_rows, count(DISTINCT a.session_id) AS sessions_with_attendance,
                count(*) FILTER (WHERE a.attended_normalized) AS present_rows
         FROM p_attendance_n a JOIN w ON a.session_id = w.session_id)
SELECT (SELECT count(*) FROM w) AS sessions_scheduled, sa.sessions_with_attendance, sa.attendance_rows,
       round(sa.attendance_rows * 1e0 / nullif(sa.sessions_with_attendance, 0), 6) AS avg_attendance_per_session,
       round(sa.present_rows * 100e0 / nullif(sa.attendance_rows, 0), 6) AS attendance_rate,
       round(coalesce((SELECT sum(duration_minutes) FROM w), 0) / 60e0, 6) AS contact_hours
FROM sa"""))
def k08_last_week(spark, sf_dir):
    return k08_in(Ctx(spark, sf_dir))


def k08_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    start, end = last_week_bounds(as_of)
    week = sessions_since(c.scoped.sessions, start, 0, until=end)
    s = week.agg(F.count(F.lit(1)).alias("sessions_scheduled"), F.sum("duration_minutes").alias("dur_sum"))
    # Only the week's months are read, and only its sessions' rows are counted.
    rows = attendance_in(c.tables, None, start, 0, until=end).join(week.select("session_id"), "session_id", "left_semi")
    per_session = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("attended_normalized").alias("flags"))
    a = (per_session
         .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("attendance_rows"),
              F.count(F.lit(1)).alias("sessions_with_attendance"),
              F.coalesce(F.sum("flags"), F.lit(0)).alias("present_rows")))
    both = stack_parts([s, a])
    return both.select(
        "sessions_scheduled", "sessions_with_attendance", "attendance_rows",
        F.round(F.try_divide(F.col("attendance_rows").cast("double"), F.col("sessions_with_attendance")), 6)
        .alias("avg_attendance_per_session"),
        _pct("present_rows", "attendance_rows").alias("attendance_rate"),
        F.round(F.coalesce(F.col("dur_sum"), F.lit(0)).cast("double") / 60, 6).alias("contact_hours"))


@register("k09_active_communities", with_programme("""
SELECT h.community_id, h.community_name, count(*) FILTER (WHERE p.is_active_normalized) AS active_participants
FROM s_participant p JOIN s_cohort c ON p.cohort_id = c.cohort_id JOIN s_hierarchy h ON c.academy_id = h.academy_id
GROUP BY h.community_id, h.community_name ORDER BY active_participants DESC, h.community_id LIMIT 3"""))
def k09_active_communities(spark, sf_dir):
    return k09_in(Ctx(spark, sf_dir))


def k09_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    per_cohort = c.scoped.participants.groupBy("cohort_id").agg(
        F.count_if("is_active_normalized").alias("active"))
    return (per_cohort.join(c.scoped.cohorts.select("cohort_id", "academy_id"), "cohort_id")
            .join(c.scoped.hierarchy.select("academy_id", "community_id", "community_name"), "academy_id")
            .groupBy("community_id", "community_name").agg(F.sum("active").alias("active_participants"))
            .orderBy(F.desc("active_participants"), "community_id").limit(3))


@register("k09b_active_14d", with_programme("""
SELECT participant_id, count(DISTINCT session_id) AS attended_sessions FROM f_attendance
WHERE attended_normalized AND participant_id IS NOT NULL
  AND CAST(session_date AS TIMESTAMP) >= TIMESTAMP '2001-07-18 00:00:00'
GROUP BY participant_id HAVING count(DISTINCT session_id) >= 2"""))
def k09b_active_14d(spark, sf_dir):
    return k09b_in(Ctx(spark, sf_dir))


def k09b_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    recent = sessions_since(c.scoped.sessions, as_of, 14)
    return (attendance_in(c.tables, recent, as_of, 14)
            .filter(F.col("attended_normalized") & F.col("participant_id").isNotNull())
            .groupBy("participant_id").agg(F.count_distinct("session_id").alias("attended_sessions"))
            .filter(F.col("attended_sessions") >= 2))


def _quarter_start(d: dt.datetime, back: int = 0) -> dt.date:
    q = (d.month - 1) // 3 - back
    year = d.year + q // 4
    return dt.date(year, (q % 4) * 3 + 1, 1)


@register("k10_attendance_by_product", with_programme("""
SELECT product_type_name, count(*) AS attendance_rows,
       round(count(*) FILTER (WHERE attended_normalized) * 100e0 / count(*), 6) AS attendance_rate,
       count(*) FILTER (WHERE date_trunc('quarter', session_date) = DATE '2001-07-01') AS rows_this_quarter,
       round(count(*) FILTER (WHERE attended_normalized AND date_trunc('quarter', session_date) = DATE '2001-07-01')
             * 100e0 / nullif(count(*) FILTER (WHERE date_trunc('quarter', session_date) = DATE '2001-07-01'), 0), 6)
         AS rate_this_quarter,
       round(count(*) FILTER (WHERE attended_normalized AND date_trunc('quarter', session_date) = DATE '2001-04-01')
             * 100e0 / nullif(count(*) FILTER (WHERE date_trunc('quarter', session_date) = DATE '2001-04-01'), 0), 6)
         AS rate_prev_quarter,
       round(count(*) FILTER (WHERE attended_normalized AND date_trunc('quarter', session_date) = DATE '2001-07-01')
             * 100e0 / nullif(count(*) FILTER (WHERE date_trunc('quarter', session_date) = DATE '2001-07-01'), 0)
             - count(*) FILTER (WHERE attended_normalized AND date_trunc('quarter', session_date) = DATE '2001-04-01')
             * 100e0 / nullif(count(*) FILTER (WHERE date_trunc('quarter', session_date) = DATE '2001-04-01'), 0), 6)
         AS change_pct_points
FROM f_attendance GROUP BY product_type_name"""))
def k10_attendance_by_product(spark, sf_dir):
    return k10_in(Ctx(spark, sf_dir))


def k10_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    as_of = as_datetime(as_of)
    q0, q1 = _quarter_start(as_of, 0), _quarter_start(as_of, 1)
    quarter = F.trunc("session_date", "quarter")
    f = _attendance(c).join(c.scoped.hierarchy.select("academy_id", "product_type_name"), "academy_id")
    agg = f.groupBy("product_type_name").agg(
        F.sum("rows").alias("attendance_rows"), F.sum("flags").alias("flags"),
        F.sum(F.when(quarter == F.lit(q0), F.col("rows"))).alias("r0"),
        F.sum(F.when(quarter == F.lit(q0), F.col("flags"))).alias("f0"),
        F.sum(F.when(quarter == F.lit(q1), F.col("rows"))).alias("r1"),
        F.sum(F.when(quarter == F.lit(q1), F.col("flags"))).alias("f1"))
    rate0 = F.try_divide(F.col("f0").cast("double") * 100, F.col("r0"))
    rate1 = F.try_divide(F.col("f1").cast("double") * 100, F.col("r1"))
    return agg.select(
        "product_type_name", "attendance_rows", _pct("flags", "attendance_rows").alias("attendance_rate"),
        F.coalesce(F.col("r0"), F.lit(0)).alias("rows_this_quarter"),
        F.round(rate0, 6).alias("rate_this_quarter"), F.round(rate1, 6).alias("rate_prev_quarter"),
        F.round(rate0 - rate1, 6).alias("change_pct_points"))


@register("k11_quarter_trend", with_programme("""
, q AS (SELECT CAST(date_trunc('quarter', session_date) AS DATE) AS quarter, count(*) AS attendance_rows,
               count(*) FILTER (WHERE attended_normalized) * 100e0 / count(*) AS rate
        FROM f_attendance GROUP BY 1)
SELECT quarter, attendance_rows, round(rate, 6) AS attendance_rate,
       round(rate - max(rate) OVER (ORDER BY year(quarter) * 4 + quarter(quarter)
                                    RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 6) AS change_pct_points
FROM q"""))
def k11_quarter_trend(spark, sf_dir):
    return k11_in(Ctx(spark, sf_dir))


def k11_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    per_q = (_attendance(c).groupBy(F.trunc("session_date", "quarter").alias("quarter"))
             .agg(F.sum("rows").alias("attendance_rows"), F.sum("flags").alias("flags")))
    rate = F.col("flags").cast("double") * 100 / F.col("attendance_rows")
    per_q = per_q.withColumn("rate", rate).withColumn("qidx", F.year("quarter") * 4 + F.quarter("quarter"))
    # The window runs over the per-quarter aggregate (one row per quarter).
    prev = F.max("rate").over(Window.orderBy("qidx").rangeBetween(-1, -1))
    return per_q.select("quarter", "attendance_rows", F.round("rate", 6).alias("attendance_rate"),
                        F.round(F.col("rate") - prev, 6).alias("change_pct_points"))


@register("k12_weekday", with_programme("""
, d AS (SELECT isodow(session_date) - 1 AS weekday, count(*) AS attendance_rows,
               count(*) FILTER (WHERE attended_normalized) * 100e0 / count(*) AS rate
        FROM f_attendance GROUP BY 1)
SELECT weekday, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][weekday + 1] AS day_name,
       attendance_rows, round(rate, 6) AS attendance_rate,
       row_number() OVER (ORDER BY round(rate, 6) DESC, weekday) AS rank
FROM d"""))
def k12_weekday(spark, sf_dir):
    return k12_in(Ctx(spark, sf_dir))


def k12_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    per_day = (_attendance(c).groupBy(F.weekday("session_date").cast("long").alias("weekday"))
               .agg(F.sum("rows").alias("attendance_rows"), F.sum("flags").alias("flags")))
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    day_name = F.element_at(names, (F.col("weekday") + 1).cast("int")).alias("day_name")
    out = per_day.select("weekday", day_name, "attendance_rows",
                         _pct("flags", "attendance_rows").alias("attendance_rate"))
    # the window runs over the 7-row per-weekday aggregate
    rank = F.row_number().over(Window.orderBy(F.desc("attendance_rate"), "weekday")).cast("long")
    return out.withColumn("rank", rank)


@register("k13_enrollment_growth", with_programme("""
, m AS (SELECT CAST(date_trunc('month', enrollment_date) AS DATE) AS month, count(*) AS new_participants
        FROM s_participant WHERE enrollment_date IS NOT NULL GROUP BY 1),
  w AS (SELECT month, new_participants,
               CAST(sum(new_participants) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    AS BIGINT) AS running_total,
               max(new_participants) OVER (ORDER BY year(month) * 12 + month(month) - 1
                                           RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev_month,
               max(new_participants) OVER (ORDER BY year(month) * 12 + month(month) - 1
                                           RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS prev_year
        FROM m)
SELECT month, new_participants, running_total,
       round((new_participants - prev_month) * 100e0 / prev_month, 6) AS mom_pct,
       round((new_participants - prev_year) * 100e0 / prev_year, 6) AS yoy_pct
FROM w"""))
def k13_enrollment_growth(spark, sf_dir):
    return k13_in(Ctx(spark, sf_dir))


def k13_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    per_month = (c.scoped.participants.filter(F.col("enrollment_date").isNotNull())
                 .groupBy(F.trunc("enrollment_date", "month").alias("month"))
                 .agg(F.count(F.lit(1)).alias("new_participants"))
                 .withColumn("midx", month_index("month")))
    # Windows over the per-month aggregate; RANGE frames on the month index
    # find exactly the month before / the same month a year before (or NULL).
    by_month = Window.orderBy("midx")
    prev_m = F.max("new_participants").over(by_month.rangeBetween(-1, -1))
    prev_y = F.max("new_participants").over(by_month.rangeBetween(-12, -12))
    running = F.sum("new_participants").over(by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def growth(prev):
        return F.round(F.try_divide((F.col("new_participants") - prev).cast("double") * 100, prev), 6)

    return per_month.select("month", "new_participants", running.alias("running_total"),
                            growth(prev_m).alias("mom_pct"), growth(prev_y).alias("yoy_pct"))


def snapshot_in(c: Ctx, as_of=AS_OF) -> DataFrame:
    """The fallback answer: all KPIs of the scope."""
    return kpis(c.scoped, as_of)


# Intent (see functions/routing.py) -> query over a context, for any scope.
INTENT_FUNCTIONS = {
    "attendance_highest": k01_in, "attendance_lowest": k02_in, "inactive": k03_in, "session_duration": k04_in,
    "top_skilled": k05_in, "lowest_skill_rate": k06_in, "top_skills": k07_in, "last_week": k08_in, "active_communities": k09_in,
    "attendance_by_product": k10_in, "quarter_trend": k11_in, "weekday": k12_in, "enrollment_growth": k13_in,
    "snapshot": snapshot_in,
}
