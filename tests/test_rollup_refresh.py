"""Incremental refresh of the weekly rollup, and exact distinct counts from bitmaps."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from strata.operators.hierarchy import build_hierarchy
from strata.operators.scope import Scope, apply_scope
from strata.operators.trends import attendance_trends
from strata.sources import rollup as R
from strata.sources.layout import write_program_tables
from strata.sources.sinks import weekly_rollup
from strata.sources.tables import Tables, load_tables

D = dt.date


@pytest.fixture
def layout(mini, tmp_path):
    root, target = str(tmp_path / "programme"), str(tmp_path / "rollup")
    write_program_tables(mini, root)
    return root, target


def rows(df):
    return sorted(map(str, df.collect()))


def live(spark, root):
    t = load_tables(spark, root)
    return rows(weekly_rollup(t, build_hierarchy(t)).select("academy_id", "week", "attendance_rows", "present_rows", "total_attendances", "unique_attendees"))


def files(target, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(os.path.join(target, name)) for f in names if f.endswith(".parquet")}


def late_row(mini, spark, session_id, participant_id, status="Present"):
    row = spark.createDataFrame([(900, session_id, participant_id, status)], mini["attendance"].schema)
    return Tables({**mini.frames, "attendance": row})


def test_first_run_then_nothing_to_do(spark, mini, layout):
    root, target = layout
    assert R.refresh(spark, root, target)["full"]
    assert rows(R.read_weeks(spark, target)) == live(spark, root)
    before = files(target, "weeks") | files(target, "bitmaps")
    assert R.refresh(spark, root, target) == {"full": False, "months": []}
    assert files(target, "weeks") | files(target, "bitmaps") == before


def test_a_new_file_rewrites_only_its_weeks(spark, mini, layout):
    root, target = layout
    R.refresh(spark, root, target)
    before = files(target, "weeks") | files(target, "bitmaps")
    R.append_attendance(late_row(mini, spark, 1, 77), root)  # session 1: 1 January 2024
    assert R.refresh(spark, root, target) == {"full": False, "months": [D(2024, 1, 1)]}
    after = files(target, "weeks") | files(target, "bitmaps")
    kept = {f for f in before if after.get(f) == before[f]}
    assert kept and {f.split("week=")[1][:10] for f in set(before) - kept} == {"2024-01-01"}
    assert {f.split("week=")[1][:10] for f in set(after) - kept} == {"2024-01-01"}
    assert rows(R.read_weeks(spark, target)) == live(spark, root)
    first = [r for r in R.read_weeks(spark, target).collect() if r["week"] == D(2024, 1, 1) and r["academy_id"] == 1000][0]
    assert (first["attendance_rows"], first["unique_attendees"]) == (2, 2)


def test_a_week_over_two_months(spark, mini, layout):
    """30 March to 2 April: a file of either month recomputes the weeks of both sides."""
    root, target = layout
    R.refresh(spark, root, target)
    R.append_attendance(late_row(mini, spark, 4, 78), root)  # 2 April
    assert R.refresh(spark, root, target)["months"] == [D(2024, 4, 1)]
    assert rows(R.read_weeks(spark, target)) == live(spark, root)
    R.append_attendance(late_row(mini, spark, 3, 79), root)  # 31 March
    R.append_attendance(late_row(mini, spark, 6, 80), root)  # undated
    assert R.refresh(spark, root, target)["months"] == [None, D(2024, 3, 1)]
    assert rows(R.read_weeks(spark, target)) == live(spark, root)


def test_rows_that_went(spark, mini, layout):
    """A month whose files go leaves no rows behind."""
    import shutil

    root, target = layout
    R.refresh(spark, root, target)
    assert any(r["week"] == D(2024, 1, 1) for r in R.read_weeks(spark, target).collect())
    shutil.rmtree(os.path.join(root, "attendance", "session_month=2024-01-01"))
    assert R.refresh(spark, root, target)["months"] == [D(2024, 1, 1)]
    assert rows(R.read_weeks(spark, target)) == live(spark, root)
    assert not any(r["week"] == D(2024, 1, 1) for r in R.read_weeks(spark, target).collect())
    assert R.read_bitmaps(spark, target).filter("week = '2024-01-01'").count() == 0


def test_a_dimension_file_recomputes_all(spark, mini, layout):
    root, target = layout
    R.refresh(spark, root, target)
    moved = mini["cohort"].withColumn("academy_id", F.when(F.col("cohort_id") == 1, 1001).otherwise(F.col("academy_id")))
    moved.write.mode("overwrite").parquet(os.path.join(root, "cohort"))
    spark.catalog.refreshByPath(os.path.join(root, "cohort"))
    assert R.refresh(spark, root, target)["full"]
    assert rows(R.read_weeks(spark, target)) == live(spark, root)


def test_months_and_weeks_are_pruned(spark, mini, layout):
    """A refresh reads the changed months and their neighbours only."""
    root, _ = layout
    t = load_tables(spark, root)
    plan = R._months_around(t["attendance"], [D(2024, 1, 1)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2023-12-01" in plan and "2024-02-01" in plan


def test_bitmaps_equal_the_live_trend(spark, mini, layout):
    """Any scope's distinct attendees follow from the rollup alone; ids may be negative or large."""
    root, target = layout
    extra = spark.createDataFrame([(900, 2, -5, "Present"), (901, 2, 1 << 40, None)], mini["attendance"].schema)
    R.append_attendance(Tables({**mini.frames, "attendance": extra}), root)
    R.refresh(spark, root, target)
    t = load_tables(spark, root)
    h = build_hierarchy(t)
    for scope in (Scope(), Scope(region_id=0), Scope(academy_id=1000), Scope(region_id=99)):
        scoped = apply_scope(t, h, scope)
        got = R.trend(spark, target, h, scope, D(2024, 4, 7), 365 * 2)
        assert rows(got) == rows(attendance_trends(t, scoped, D(2024, 4, 7), 365 * 2)), scope
        assert os.path.join(root, "attendance") not in "".join(got.inputFiles())
        everyone = scoped.attendance.agg(F.count_distinct("participant_id")).first()[0]
        assert R.participants_attended(spark, target, h, scope).first()[0] == everyone, scope


def test_bitmaps_grow_with_the_attendees(spark, mini):
    """Far-apart ids take one fixed-width row each, hashed and not sorted; neighbours share one."""
    ids = [None, -130, -1, 0, 63, 64, 5_000_000, (1 << 40) + 7, (1 << 62) + 1]
    some = spark.createDataFrame([(900 + k, 2, i, "Present") for k, i in enumerate(ids + ids)], mini["attendance"].schema)
    t = Tables({**mini.frames, "attendance": some})
    made = R.attendee_bitmaps(t, build_hierarchy(t))
    assert made.schema["bitmap"].dataType.simpleString() == "bigint"
    got = {r["block"]: r["bitmap"] & (1 << 64) - 1 for r in made.collect()}
    assert got == {-3: 1 << 62, -1: 1 << 63, 0: 1 | 1 << 63, 1: 1, 78125: 1, 1 << 34: 1 << 7, 1 << 56: 2}
    assert R.unite(made, "academy_id", "week").first()["unique_attendees"] == len(ids) - 1
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ShuffledHashJoin" in plan


def test_a_rollup_of_another_form_is_computed_again(spark, mini, layout):
    root, target = layout
    R.refresh(spark, root, target)
    old = spark.read.parquet(os.path.join(target, "bitmaps")).withColumnRenamed("block", "bucket").withColumn("bitmap", F.lit(b"\0")).collect()
    spark.createDataFrame(old, "academy_id long, bucket long, bitmap binary, week date").write.mode("overwrite").partitionBy("week").parquet(os.path.join(target, "bitmaps"))
    R.append_attendance(late_row(mini, spark, 1, 77), root)
    assert R.refresh(spark, root, target)["full"]
    assert "block" in R.read_bitmaps(spark, target).columns
    assert rows(R.read_weeks(spark, target)) == live(spark, root)
