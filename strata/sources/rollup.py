"""A weekly rollup that is kept up to date by recomputing only the weeks that changed.

The facts lie in the written layout (``layout``), partitioned by session month.  Beside the rollup stands
a manifest: the files (path, size, time) it was computed from.  A refresh compares today's listing
with it, takes the months of files that came, went or changed, and recomputes the weeks that these months
touch; the rollup is partitioned by week and overwritten partition by partition.  A file of a dimension table
has no month: when one changed, all weeks are computed again.

Distinct attendees are kept as bitmaps, one long per (academy, week, block of 64 ids), so the distinct count of any
scope follows from the rollup alone, exactly: bitmaps of its academies are united, and bits counted.  A block has
a row only where it has an attendee, so the bitmaps grow with the attendance and not with the range of the ids.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.functions.bits import bit_of, block_of
from strata.functions.dates import on_or_after, week_start
from strata.operators.hierarchy import build_hierarchy
from strata.operators.scope import MONTH_COLUMN, Scope
from strata.schemas import DIMENSIONS
from strata.sources.sinks import weekly_rollup
from strata.sources.tables import Tables, load_tables

FACTS_OF_ROLLUP = ("session", "attendance")
FILES = "file string, length bigint, modified timestamp, month date"


def attendee_bitmaps(tables: Tables, hierarchy: DataFrame) -> DataFrame:
    """Distinct attendees per (academy, week) as bitmaps: one row per block of 64 neighbouring ids
    that has any.  Aggregated map-side, so a hot academy ships each of its blocks once per task."""
    sessions = (tables["session"].select("session_id", "cohort_id", "session_date")
                .join(tables["cohort"].select("cohort_id", "academy_id"), "cohort_id")
                .join(hierarchy.select("academy_id"), "academy_id"))
    rows = tables["attendance"].filter("participant_id is not null").select("session_id", "participant_id").join(sessions.hint("shuffle_hash"), "session_id")
    return (rows.groupBy("academy_id", week_start("session_date").alias("week"), block_of("participant_id").alias("block"))
            .agg(F.bit_or(bit_of("participant_id")).alias("bitmap")))


def unite(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Exact distinct attendees per ``keys``, from bitmaps of any finer grain."""
    each = bitmaps.groupBy(*keys, "block").agg(F.bit_or("bitmap").alias("bitmap"))
    return each.groupBy(*keys).agg(F.sum(F.bit_count("bitmap")).alias("unique_attendees"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """The layout's files, as ``FILES``.  They are listed now; their contents are not read."""
    found = []
    for name in (*FACTS_OF_ROLLUP, *DIMENSIONS):
        try:
            df = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(os.path.join(root, name))
        except AnalysisException:  # a table that is not there
            continue
        month = F.col(MONTH_COLUMN).cast("date") if MONTH_COLUMN in df.columns else F.lit(None).cast("date")
        found.append(df.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), month.alias("month"),
                               F.lit(name in FACTS_OF_ROLLUP).alias("by_month")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def changed_months(now: DataFrame, before: DataFrame) -> tuple[list, bool]:
    """Months of fact files that differ between two listings, and whether a dimension's file does.  One row per
    month comes back, however many files there are."""
    same = ["file", "length", "modified"]
    moved = now.join(before, same, "left_anti").unionByName(before.join(now, same, "left_anti"))
    rows = moved.select("month", "by_month").distinct().collect()
    months = [r["month"] for r in rows if r["by_month"]]  # None: undated sessions, and rows without a session
    return sorted(months, key=lambda m: (m is not None, m)), any(not r["by_month"] for r in rows)


def _affected(months: list) -> Column:
    """Weeks (their Mondays) that any of the months touches; undated rows make a week of their own."""
    hit = F.lit(False)
    for month in months:
        if month is None:
            hit = hit | F.col("week").isNull()
        else:
            hit = hit | F.col("week").between(week_start(F.lit(month)), week_start(F.last_day(F.lit(month))))
    return F.coalesce(hit, F.lit(False))


def _months_around(df: DataFrame, months: list) -> DataFrame:
    """Rows of the months and of their neighbours, which share weeks with them (partitions are pruned)."""
    wanted = {m for month in months if month for m in (_shift(month, -1), month, _shift(month, 1))}
    kept = F.col(MONTH_COLUMN).isin(sorted(wanted))
    return df.filter(kept | F.col(MONTH_COLUMN).isNull() if None in months else kept)


def _shift(month, by: int):
    at = month.year * 12 + month.month - 1 + by
    return month.replace(year=at // 12, month=at % 12 + 1)


def _write(tables: Tables, hierarchy: DataFrame, target: str, months: list | None) -> None:
    """Write both tables, or only their weeks that the months touch."""
    spark = hierarchy.sparkSession
    for name, made in (("weeks", weekly_rollup(tables, hierarchy)), ("bitmaps", attendee_bitmaps(tables, hierarchy))):
        path = os.path.join(target, name)
        if months is not None:  # each week also gets a row without academy, so that one that lost its rows is overwritten
            old = [r["week"] for r in spark.read.parquet(path).select("week").distinct().filter(_affected(months)).collect()]
            made = made.filter(_affected(months))
            fill = {c: F.lit(None if c in ("academy_id", "bitmap") else 0).cast(made.schema[c].dataType) for c in made.columns if c != "week"}
            made = made.unionByName(spark.createDataFrame([(w,) for w in old], "week date").withColumns(fill))
        # a fixed number of parts: many small weeks are written side by side, each by one task
        writer = made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "week").write.mode("overwrite").partitionBy("week")
        if months is not None:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(path)


def build(tables: Tables, hierarchy: DataFrame, target: str) -> None:
    """The rollup of any tables, written in full (without a manifest)."""
    _write(tables, hierarchy, target, None)


def refresh(spark: SparkSession, root: str, target: str) -> dict:
    """Bring the rollup at ``target`` up to date with the layout at ``root``.

    Writes ``target/weeks`` (the weekly rollup) and ``target/bitmaps`` (its distinct attendees), both
    partitioned by week, and then ``target/files``, the manifest; if the run is lost before that, the
    next one repeats it.  Returns ``{"full": bool, "months": [...]}``.  A recomputed week keeps one row
    without academy and with zero counts, which readers drop.  Only months and weeks reach the driver.
    """
    now = list_files(spark, root)
    manifest = os.path.join(target, "files")
    try:
        before = spark.read.parquet(manifest)
        months, full = changed_months(now, before)
        full = full or "block" not in read_bitmaps(spark, target).columns  # a rollup with bitmaps of another form
    except AnalysisException:  # the first run
        months, full = [], True
    if not months and not full:
        return {"full": False, "months": []}
    tables = load_tables(spark, root)
    hierarchy = build_hierarchy(tables)
    if not full:
        frames = {n: _months_around(df, months) if n in FACTS_OF_ROLLUP else df for n, df in tables.frames.items()}
        tables = Tables(frames)
    _write(tables, hierarchy, target, None if full else months)
    now.write.mode("overwrite").parquet(manifest)
    return {"full": full, "months": months}


def read_weeks(spark: SparkSession, target: str) -> DataFrame:
    """The rollup as ``weekly_rollup`` computes it."""
    df = spark.read.parquet(os.path.join(target, "weeks")).filter("academy_id is not null")
    return df.select("academy_id", F.col("week").cast("date").alias("week"), "attendance_rows", "present_rows", "total_attendances", "unique_attendees")


def read_bitmaps(spark: SparkSession, target: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(target, "bitmaps")).filter("academy_id is not null")
    return df.withColumn("week", F.col("week").cast("date"))


def trend(spark: SparkSession, target: str, hierarchy: DataFrame, scope: Scope | None, as_of, days_back: int = 90) -> DataFrame:
    """The weekly trend of a scope from the rollup alone, attendance untouched: ``attendance_trends`` over
    the whole weeks of the window (the week of the cutoff is complete here)."""
    academies = (scope or Scope()).filter(hierarchy).select("academy_id")
    recent = on_or_after("week", as_of, days_back + 6)  # prunes the week partitions
    weeks = read_weeks(spark, target).filter(recent).join(academies, "academy_id", "left_semi").groupBy("week").agg(
        F.sum("total_attendances").alias("total_attendances"),
        F.round(F.sum("present_rows").cast("double") * 100 / F.sum("attendance_rows"), 6).alias("attendance_rate"))
    unique = unite(read_bitmaps(spark, target).filter(recent).join(academies, "academy_id", "left_semi"), "week")
    return weeks.join(unique, "week", "left").withColumn("unique_attendees", F.coalesce("unique_attendees", F.lit(0).cast("bigint"))).select("week", "unique_attendees", "total_attendances", "attendance_rate").orderBy("week")


def participants_attended(spark: SparkSession, target: str, hierarchy: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Distinct attendees of a scope over all weeks, from the bitmaps alone."""
    academies = (scope or Scope()).filter(hierarchy).select("academy_id")
    found = unite(read_bitmaps(spark, target).join(academies, "academy_id", "left_semi"))
    return found.select(F.coalesce("unique_attendees", F.lit(0).cast("bigint")).alias("participants_attended"))


def append_attendance(tables: Tables, root: str) -> None:
    """Add the attendance of ``tables`` to a written layout: new files in the months of its sessions."""
    from strata.sources.layout import _by_month, with_session_month

    _by_month(with_session_month(tables, "attendance")).write.mode("append").partitionBy(MONTH_COLUMN).parquet(os.path.join(root, "attendance"))
