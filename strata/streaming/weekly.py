"""Incremental weekly attendance trend with Structured Streaming.

Replaces the dashboard's polling reload: new attendance files are picked up by a
file stream, joined to the (static) scoped sessions for their date, and counted
per Monday-aligned 7-day window.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.functions.dates import utc_date, utc_midnight, week_start
from strata.functions.flags import attended
from strata.operators.hierarchy import build_hierarchy
from strata.operators.scope import Scope, apply_scope
from strata.schemas import conform
from strata.session import shared_dir
from strata.sources.tables import Tables, attendance_from_lines, driver_tables, program_tables

# 1970-01-01 was a Thursday: windows offset by 4 days start on Mondays.
WEEK, MONDAY_OFFSET = "7 days", "4 days"


def attendance_table_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                            max_files_per_trigger: int | None = None) -> DataFrame:
    """Attendance rows from a file stream over the attendance table's folder:
    files that are there, then those that arrive."""
    reader = spark.readStream.format(fmt).schema(spark.read.format(fmt).load(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _rows(conform(reader.load(path), "attendance"))


def attendance_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same over the driver's line files in ``sf_dir`` (every file matching
    ``lineitem*.parquet``, old and new)."""
    reader = spark.readStream.schema(driver_tables(spark, sf_dir)["lineitem"].schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _rows(attendance_from_lines(reader.parquet(os.path.join(sf_dir, "lineitem*.parquet"))))


def _rows(attendance: DataFrame) -> DataFrame:
    return attendance.select("session_id", "participant_id", attended().alias("attended_normalized"))


def weekly_window_counts(rows: DataFrame, watermark: str) -> DataFrame:
    """Per week: rows, non-null attendees, present rows, approximate distinct
    attendees (exact distinct is not supported on streams)."""
    return (rows.withWatermark("session_ts", watermark)
            .groupBy(F.window("session_ts", WEEK, WEEK, MONDAY_OFFSET).alias("w"))
            .agg(F.count(F.lit(1)).alias("attendance_rows"), F.count("participant_id").alias("total_attendances"),
                 F.count_if("attended_normalized").alias("present_rows"),
                 F.approx_count_distinct("participant_id").alias("unique_attendees_approx")))


def exact_weekly_counts(rows: DataFrame, watermark: str) -> DataFrame:
    """Per week: rows, non-null attendees, present rows and exact distinct attendees, by two chained
    aggregations: per (week, participant), which leaves its state when the watermark closes the week, then
    per week.  State is one row per participant of an open week, spread by participant."""
    week = F.window("session_ts", WEEK, WEEK, MONDAY_OFFSET)
    people = (rows.withWatermark("session_ts", watermark).groupBy(week.alias("w"), "participant_id")
              .agg(F.count(F.lit(1)).alias("n"), F.count("participant_id").alias("known"), F.count_if("attended_normalized").alias("present")))
    return (people.groupBy(F.window(F.window_time("w"), WEEK, WEEK, MONDAY_OFFSET).alias("w"))
            .agg(F.sum("n").alias("attendance_rows"), F.sum("known").alias("total_attendances"),
                 F.sum("present").alias("present_rows"), F.count("participant_id").alias("unique_attendees")))


def exact_weekly_trend_of(tables: Tables, stream: DataFrame, scope: Scope | None = None, sink_path: str | None = None,
                          checkpoint: str | None = None, watermark: str = "14 days", progress: list | None = None) -> DataFrame:
    """The weeks that the watermark has closed, with exact distinct attendees.

    Runs over everything available; with the same ``checkpoint`` and ``sink_path`` the next run goes on where
    this one ended.  A week is written once, when a session ``watermark`` after its end has been seen;
    rows for a closed week are late, and counted in ``progress`` (see ``rows_dropped_by_watermark``).  The file sink
    records what it wrote, so a replayed batch adds nothing.
    """
    spark = stream.sparkSession
    sessions = apply_scope(tables, build_hierarchy(tables), scope or Scope()).sessions
    static = sessions.select("session_id", utc_midnight("session_date").alias("session_ts"))
    counts = exact_weekly_counts(stream.join(static, "session_id"), watermark)
    out = sink_path or shared_dir(spark, "weekly-exact-stream")
    weeks = counts.select(utc_date(F.col("w.start")).alias("week"), "attendance_rows", "total_attendances", "present_rows", "unique_attendees")
    query = (weeks.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint or shared_dir(spark, "weekly-exact-stream-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    return spark.read.schema(weeks.schema).parquet(out)


def arriving(spark: SparkSession, path: str, table: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A programme table's files as a stream, with ``arrived``, the time of the file that brought a row."""
    reader = spark.readStream.format(fmt).schema(spark.read.format(fmt).load(path).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    return conform(raw, table, extra=("arrived",))


PARTIAL = "week date, participant_id bigint, attendance_rows bigint, present_rows bigint"


def weekly_trend_of_streams(tables: Tables, attendance: DataFrame, sessions: DataFrame, scope: Scope | None = None, sink_path: str | None = None,
                            checkpoint: str | None = None, patience: str = "30 days", progress: list | None = None) -> DataFrame:
    """The weekly trend when sessions arrive as a stream too (both sides from ``arriving``).

    A stream-stream join by session id: a row of either side waits at most ``patience`` for its partner,
    by the arrival times of their files, then the watermark drops it, so the state holds what arrived within
    that time.  A session that comes after its attendance is counted with it.  Each epoch writes what it
    matched, aggregated per (week, participant), into a folder of its own (overwritten if the epoch is
    replayed); the trend, distinct attendees included, is the exact sum of these parts.
    Rows without a session id match nothing, and a session without a date has no week.
    """
    spark = attendance.sparkSession
    academies = (scope or Scope()).filter(build_hierarchy(tables)).select("academy_id")
    cohorts = tables["cohort"].join(academies, "academy_id", "left_semi").select("cohort_id")
    left = attendance.select("session_id", "participant_id", attended().alias("attended_normalized"), "arrived").withWatermark("arrived", patience)
    right = (sessions.join(cohorts, "cohort_id", "left_semi").select(F.col("session_id").alias("of_session"), "session_date", F.col("arrived").alias("session_arrived"))
             .withWatermark("session_arrived", patience))
    wait = F.expr(f"interval {patience}")
    matched = left.join(right, (F.col("session_id") == F.col("of_session")) & (F.col("arrived") >= F.col("session_arrived") - wait) & (F.col("arrived") <= F.col("session_arrived") + wait))
    out = sink_path or shared_dir(spark, "weekly-two-streams")

    def write(batch: DataFrame, epoch_id: int) -> None:
        part = (batch.filter("session_date is not null").groupBy(week_start("session_date").alias("week"), "participant_id")
                .agg(F.count(F.lit(1)).alias("attendance_rows"), F.count_if("attended_normalized").alias("present_rows")))
        part.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch_id}"))

    query = (matched.select("session_date", "participant_id", "attended_normalized").writeStream.outputMode("append").foreachBatch(write)
             .option("checkpointLocation", checkpoint or shared_dir(spark, "weekly-two-streams-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    parts = spark.read.schema(PARTIAL).parquet(out)
    people = parts.groupBy("week", "participant_id").agg(F.sum("attendance_rows").alias("n"), F.sum("present_rows").alias("present"))
    return (people.groupBy("week").agg(F.count("participant_id").alias("unique_attendees"),
                                       F.sum(F.when(F.col("participant_id").isNotNull(), F.col("n")).otherwise(0)).alias("total_attendances"),
                                       F.round(F.sum("present").cast("double") * 100 / F.sum("n"), 6).alias("attendance_rate")).orderBy("week"))


def state_rows(progress: list) -> list[int]:
    """Rows held in state after each batch."""
    return [sum(op.get("numRowsTotal", 0) for op in (p.get("stateOperators") or [])) for p in progress]


def stream_weekly_trend(spark: SparkSession, sf_dir: str, scope: Scope | None = None, sink_path: str | None = None,
                        checkpoint: str | None = None, watermark: str = "14 days",
                        output_mode: str = "complete", progress: list | None = None) -> DataFrame:
    """``weekly_trend_of`` over the driver's tables."""
    return weekly_trend_of(program_tables(spark, sf_dir), attendance_stream(spark, sf_dir), scope, sink_path, checkpoint,
                           watermark, output_mode, progress)


def weekly_trend_of(tables: Tables, stream: DataFrame, scope: Scope | None = None, sink_path: str | None = None,
                    checkpoint: str | None = None, watermark: str = "14 days",
                    output_mode: str = "complete", progress: list | None = None) -> DataFrame:
    """Run the stream over everything available (``availableNow``) and return
    the weekly table it wrote.  With the same ``checkpoint`` and ``sink_path``
    the next run reads only the files that arrived since.

    ``complete`` mode keeps one state row per week (small; grows with the
    number of weeks, not rows) and is exact for out-of-order files.  ``append``
    emits a week once the watermark passes it and drops later rows for it:
    use it only for time-ordered input; pass a list as ``progress`` to get the
    query's progress reports (``stateOperators[].numRowsDroppedByWatermark``
    counts what was dropped).  Output goes through ``foreachBatch``
    to parquet in the shared checkpoint folder (overwritten per epoch, so a
    replayed epoch is harmless); state and offsets live in ``checkpoint``.
    """
    spark = stream.sparkSession
    sessions = apply_scope(tables, build_hierarchy(tables), scope or Scope()).sessions
    static = sessions.select("session_id", utc_midnight("session_date").alias("session_ts"))
    rows = stream.join(static, "session_id")
    counts = weekly_window_counts(rows, watermark)
    out_path = sink_path or shared_dir(spark, "weekly-trend-stream")
    ckpt = checkpoint or shared_dir(spark, "weekly-trend-stream-state")

    def write(batch: DataFrame, epoch_id: int) -> None:
        (batch.select(utc_date(F.col("w.start")).alias("week"), "attendance_rows", "total_attendances",
                      "present_rows", "unique_attendees_approx")
         .write.mode("overwrite" if output_mode == "complete" else "append").parquet(out_path))

    query = (counts.writeStream.outputMode(output_mode).foreachBatch(write)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    return spark.read.parquet(out_path)


def rows_dropped_by_watermark(progress: list) -> int:
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in progress
               for op in (p.get("stateOperators") or []))
