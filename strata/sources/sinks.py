"""Sinks: materialised rollups and answer records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.functions.dates import on_or_after, week_start
from strata.operators.scope import Scope, attendance_normalized
from strata.sources.tables import Tables


def weekly_rollup(tables: Tables, hierarchy: DataFrame, with_sketch: bool = False) -> DataFrame:
    """Attendance per (academy, week): rows, present rows, non-null attendees,
    exact distinct attendees, and optionally a mergeable HLL sketch of the
    attendees so coarser levels can be re-aggregated from the rollup alone.

    Attendance meets session->academy in one join (skew on a hot session is
    split by AQE), which holds the sessions of a task and streams its attendance,
    several times their number, unsorted; the grouping is two-level for the distinct count.
    """
    session_academy = (tables["session"].select("session_id", "cohort_id", "session_date")
                       .join(tables["cohort"].select("cohort_id", "academy_id"), "cohort_id")
                       .join(hierarchy.select("academy_id"), "academy_id"))
    rows = attendance_normalized(tables).join(session_academy.hint("shuffle_hash"), "session_id")
    aggs = [F.count(F.lit(1)).alias("attendance_rows"), F.count_if("attended_normalized").alias("present_rows"),
            F.count("participant_id").alias("total_attendances"),
            F.count_distinct("participant_id").alias("unique_attendees")]
    if with_sketch:
        aggs.append(F.hll_sketch_agg("participant_id").alias("attendee_sketch"))
    return rows.groupBy("academy_id", week_start("session_date").alias("week")).agg(*aggs)


def write_weekly_rollup(rollup: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the rollup as parquet partitioned by week (so trend reads prune to
    the weeks they need); the committer makes the write atomic per job.

    The rollup has one row per (academy, week), so a week is small: shuffling
    by week first gives one file per week instead of one per task and week."""
    rollup.repartition("week").write.mode(mode).partitionBy("week").parquet(path)


def trend_from_rollup(spark: SparkSession, path: str, hierarchy: DataFrame, scope: Scope | None, as_of,
                      days_back: int = 90) -> DataFrame:
    """Weekly trend read back from a written rollup: counts and rate exact; if
    the rollup was written with sketches, distinct attendees estimated by
    merging them (distinct counts of academies cannot be added).

    The rollup holds whole weeks, so the week containing the cutoff is
    complete here, while the live trend cuts it at the cutoff."""
    r = spark.read.parquet(path)
    r = r.filter(on_or_after("week", as_of, days_back + 6))  # prunes the week partitions
    academies = (scope or Scope()).filter(hierarchy).select("academy_id")
    r = r.join(academies, "academy_id", "left_semi")
    aggs = [F.sum("total_attendances").alias("total_attendances"),
            F.round(F.sum("present_rows").cast("double") * 100 / F.sum("attendance_rows"), 6).alias("attendance_rate")]
    if "attendee_sketch" in r.columns:
        aggs.append(F.hll_sketch_estimate(F.hll_union_agg("attendee_sketch")).alias("unique_attendees_est"))
    return r.groupBy("week").agg(*aggs)


def write_records_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result records as JSON lines (one object per row)."""
    df.write.mode(mode).json(path)
