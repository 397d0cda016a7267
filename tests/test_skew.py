"""A session holding a third of all attendance rows: the join is split by AQE
and the results stay whole and exact."""

import datetime as dt

from pyspark.sql import functions as F

from strata.operators.scope import Scoped
from strata.operators.trends import attendance_trends
from strata.sources.tables import Tables


def test_hot_session_is_split_and_exact(spark):
    n, hot = 300_000, 7
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        ids = spark.range(n)
        attendance = ids.select(
            F.lit(None).cast("long").alias("attendance_id"),
            F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id") % 20_000).cast("long").alias("session_id"),
            (F.col("id") % 5_000).alias("participant_id"),
            F.when(F.col("id") % 2 == 0, "Present").otherwise("absent").alias("attendance_status"))
        sessions = spark.range(20_000).select(
            F.col("id").alias("session_id"), (F.col("id") % 50).alias("cohort_id"),
            F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 60).cast("int")).alias("session_date"),
            F.lit(60).alias("duration_minutes"))
        tables = Tables({"attendance": attendance, "session": sessions})
        scoped = Scoped(None, None, None, sessions, None, None)
        trend = attendance_trends(tables, scoped, dt.datetime(2024, 3, 31), 365)
        got = {r.week: (r.unique_attendees, r.total_attendances, r.attendance_rate) for r in trend.collect()}
        plan = trend._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan

        # Brute force on the same rows, no join: every row is kept.
        joined = attendance.join(sessions.select("session_id", "session_date"), "session_id")
        want = {r.week: (r.u, r.t, r.rate) for r in joined.groupBy(F.trunc("session_date", "week").alias("week"))
                .agg(F.count_distinct("participant_id").alias("u"), F.count("participant_id").alias("t"),
                     F.round(F.avg(F.when(F.col("attendance_status") == "Present", 1.0).otherwise(0.0)) * 100, 6)
                     .alias("rate")).collect()}
        assert got == want
        assert sum(v[1] for v in got.values()) == n
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
