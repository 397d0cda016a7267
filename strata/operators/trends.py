"""Weekly attendance trend and the small distribution views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strata.functions.dates import week_start
from strata.operators.scope import Scoped, attendance_in, sessions_since
from strata.sources.tables import Tables


def attendance_trends(tables: Tables, scoped: Scoped, as_of, days_back: int = 90,
                      until=None) -> DataFrame:
    """Per Monday week over sessions dated on/after ``as_of - days_back``:
    ``unique_attendees`` (distinct non-null participants, present or not),
    ``total_attendances`` (non-null participants), ``attendance_rate`` (share of
    all rows marked present, x100).  Weeks without rows are absent.

    One join: attendance with the scoped, date-filtered sessions (this inner
    join also does the scope's semi join).  The filter is on the small side;
    the distinct count runs as a two-level aggregation keyed (week, participant),
    so no single task sees a whole week.
    """
    s = sessions_since(scoped.sessions, as_of, days_back)
    if until is not None:
        s = s.filter(F.col("session_date") <= F.lit(until))
    rows = attendance_in(tables, s, as_of, days_back, ("session_id", "session_date"))
    return (rows.groupBy(week_start("session_date").alias("week"))
            .agg(F.count_distinct("participant_id").alias("unique_attendees"),
                 F.count("participant_id").alias("total_attendances"),
                 F.round(F.count_if(F.col("attended_normalized")).cast("double") * 100 / F.count(F.lit(1)), 6)
                 .alias("attendance_rate"))
            .orderBy("week"))


def product_mix(scoped: Scoped) -> DataFrame:
    """Academies per product type (distinct academy/type pairs, NULL types out),
    most first."""
    return (scoped.hierarchy.select("academy_id", "product_type_name").distinct()
            .na.drop(subset=["product_type_name"])
            .groupBy("product_type_name").agg(F.count(F.lit(1)).alias("academy_count"))
            .orderBy(F.desc("academy_count"), "product_type_name"))


def product_mix_share(scoped: Scoped) -> DataFrame:
    """``product_mix`` with each slice's share of the total (pie chart data).
    The window runs over the tiny per-type aggregate, not over facts."""
    mix = product_mix(scoped)
    total = F.sum("academy_count").over(Window.partitionBy())
    return (mix.withColumn("share_pct", F.round(F.col("academy_count") * 100.0 / total, 6))
            .orderBy(F.desc("academy_count"), "product_type_name"))


def top_academies_by_cohorts(scoped: Scoped, n: int = 10) -> DataFrame:
    """Cohorts per academy, top ``n`` by count, ties by ascending academy id
    (planned as a top-k: TakeOrderedAndProject)."""
    counts = scoped.cohorts.groupBy("academy_id").agg(F.count(F.lit(1)).alias("cohort_count"))
    labels = scoped.hierarchy.select("academy_id", "academy_code").distinct()
    return (counts.join(labels, "academy_id", "left")
            .orderBy(F.desc("cohort_count"), F.asc("academy_id")).limit(n)
            .select("academy_id", "academy_code", "cohort_count"))
