"""Exact weekly distinct attendees on a stream, and sessions that arrive as a stream."""

import datetime as dt
import os

from pyspark.sql import functions as F

from strata.operators.hierarchy import build_hierarchy
from strata.operators.scope import Scope, apply_scope
from strata.operators.trends import attendance_trends
from strata.sources.tables import Tables
from strata.streaming import weekly as W

D = dt.date


def put(spark, df, folder, name, day=None):
    """One file, as if it had arrived at noon of ``day``."""
    import shutil
    import tempfile

    made = tempfile.mkdtemp(prefix="strata-put-")
    df.coalesce(1).write.mode("overwrite").parquet(made)
    part = [f for f in os.listdir(made) if f.endswith(".parquet")][0]
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.parquet")
    shutil.move(os.path.join(made, part), path)
    if day:
        at = dt.datetime(day.year, day.month, day.day, 12).timestamp()
        os.utime(path, (at, at))


def ordered_programme(mini, spark):
    """Ten weeks of sessions, one a day, with repeated and null attendees."""
    first = D(2024, 1, 1)
    sessions = [(k, 1 + k % 3, first + dt.timedelta(days=k), 30) for k in range(70)]
    rows = [(9 * k + j, k, None if j == 8 else (k * j) % 11, ["Present", "absent", None][j % 3]) for k in range(70) for j in range(9)]
    tables = Tables({**mini.frames, "session": spark.createDataFrame(sessions, mini["session"].schema)})
    return tables, spark.createDataFrame(rows, mini["attendance"].schema)


def batch(tables, attendance, scope=None, until=D(2024, 12, 31)):
    t = Tables({**tables.frames, "attendance": attendance})
    out = attendance_trends(t, apply_scope(t, build_hierarchy(t), scope or Scope()), until, 365)
    return {r["week"]: (r["unique_attendees"], r["total_attendances"]) for r in out.collect()}


def test_closed_weeks_have_exact_distinct_attendees(spark, mini, tmp_path):
    tables, attendance = ordered_programme(mini, spark)
    folder, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in range(2):  # two runs over ordered input
        put(spark, attendance.filter((F.col("session_id") >= part * 35) & (F.col("session_id") < (part + 1) * 35)), folder, f"p{part}")
        progress: list = []
        got = W.exact_weekly_trend_of(tables, W.attendance_table_stream(spark, folder), sink_path=sink, checkpoint=ckpt, progress=progress)
        rows = {r["week"]: (r["unique_attendees"], r["total_attendances"]) for r in got.collect()}
        assert got.count() == len(rows)
        newest = D(2024, 1, 1) + dt.timedelta(days=35 * (part + 1) - 1)
        want = {w: v for w, v in batch(tables, attendance).items() if w + dt.timedelta(days=7) <= newest - dt.timedelta(days=14)}
        assert rows == want and want
        assert W.rows_dropped_by_watermark(progress) == 0
    # a row for a closed week is late: reported, not counted
    put(spark, spark.createDataFrame([(9999, 0, 777, "Present")], mini["attendance"].schema), folder, "late")
    progress = []
    got = W.exact_weekly_trend_of(tables, W.attendance_table_stream(spark, folder), sink_path=sink, checkpoint=ckpt, progress=progress)
    assert {r["week"]: (r["unique_attendees"], r["total_attendances"]) for r in got.collect()} == want
    assert W.rows_dropped_by_watermark(progress) == 1


def test_sessions_that_arrive_later_are_counted(spark, mini, tmp_path):
    tables, attendance = ordered_programme(mini, spark)
    a, s, sink, ckpt = (str(tmp_path / n) for n in ("attendance", "session", "out", "state"))
    sessions = tables["session"]

    def run(progress=None):
        out = W.weekly_trend_of_streams(tables, W.arriving(spark, a, "attendance"), W.arriving(spark, s, "session"), sink_path=sink, checkpoint=ckpt, patience="30 days", progress=progress)
        return {r["week"]: (r["unique_attendees"], r["total_attendances"]) for r in out.collect()}

    put(spark, attendance, a, "a0", D(2024, 4, 1))
    put(spark, sessions.filter("session_id < 40"), s, "s0", D(2024, 4, 1))
    assert run() == batch(Tables({**tables.frames, "session": sessions.filter("session_id < 40")}), attendance)
    # the other sessions arrive in a second run, after their attendance
    put(spark, sessions.filter("session_id >= 40 and session_id < 60"), s, "s1", D(2024, 4, 20))
    assert run() == batch(Tables({**tables.frames, "session": sessions.filter("session_id < 60")}), attendance)
    # much later files move the watermark: what waited longer than that is dropped, in both states
    put(spark, attendance.limit(0).unionByName(spark.createDataFrame([(1, 5000, 1, "Present")], mini["attendance"].schema)), a, "a1", D(2024, 9, 1))
    put(spark, spark.createDataFrame([(5000, 1, D(2024, 8, 30), 30)], mini["session"].schema), s, "s2", D(2024, 9, 1))
    progress: list = []
    run(progress)
    assert W.state_rows(progress)[-1] <= 2
    before = run()
    put(spark, sessions.filter("session_id >= 60"), s, "s3", D(2024, 9, 2))
    assert run() == before  # their attendance has waited 150 days
    assert before[D(2024, 8, 26)] == (1, 1)


def test_scope_of_two_streams(spark, mini, tmp_path):
    tables, attendance = ordered_programme(mini, spark)
    a, s = str(tmp_path / "attendance"), str(tmp_path / "session")
    put(spark, attendance, a, "a0")
    put(spark, tables["session"], s, "s0")
    got = W.weekly_trend_of_streams(tables, W.arriving(spark, a, "attendance"), W.arriving(spark, s, "session"), scope=Scope(academy_id=1001))
    assert {r["week"]: (r["unique_attendees"], r["total_attendances"]) for r in got.collect()} == batch(tables, attendance, Scope(academy_id=1001))
