"""Properties on the driver data (sf0.001) and plan-shape checks."""

import datetime as dt

import pytest

import __spark_entry__ as E
from strata.operators import hierarchy as H
from strata.operators import metrics as M
from strata.operators import scope as SC
from strata.sources.tables import program_tables

SF = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2001, 8, 1)
ADDITIVE = ("total_participants", "active_participants", "total_sessions", "total_attendances", "total_achievements")
DISTINCT = ("unique_session_days", "participants_attended", "unique_skills_achieved", "participants_with_achievements")


@pytest.fixture(scope="module")
def rollup(spark):
    t = program_tables(spark, SF)
    return [r.asDict() for r in M.kpis_rollup(t, H.build_hierarchy(t), AS_OF).collect()]


def test_rollup_children_sum_to_parent(rollup):
    regions = [r for r in rollup if r["level"] == "region"]
    total = [r for r in rollup if r["level"] == "all"][0]
    for col in ADDITIVE:
        assert sum(r[col] for r in regions) == total[col]
    for col in DISTINCT:
        assert max(r[col] for r in regions) <= total[col] <= sum(r[col] for r in regions)
    for city in [r for r in rollup if r["level"] == "city"]:
        kids = [r for r in rollup if r["level"] == "community" and r["city_id"] == city["city_id"]]
        for col in ADDITIVE:
            assert sum(k[col] for k in kids) == city[col]


def test_rollup_matches_scoped_kpis(spark, rollup):
    t = program_tables(spark, SF)
    h = H.build_hierarchy(t)
    for level, scope in (("all", SC.Scope()), ("region", SC.Scope(region_id=2))):
        want = M.kpis(SC.apply_scope(t, h, scope), AS_OF).first().asDict()
        row = [r for r in rollup if r["level"] == level and (level == "all" or r["region_id"] == 2)][0]
        for k, v in want.items():
            assert row[k] == pytest.approx(v), k


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_python_udf_and_prune(spark):
    qs = E.queries()
    for key in ("weekly_trend", "kpi_overall", "k01_attendance_highest", "extract_sql", "route_questions"):
        text = plan_of(qs[key](spark, SF))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, key
    fe = qs["filter_equals"](spark, SF)
    formatted = fe._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in formatted
    top = qs["top_n"](spark, SF)
    assert "TakeOrderedAndProject" in plan_of(top)
    trend = qs["weekly_trend"](spark, SF)
    formatted = trend._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_returnflag:string,l_linestatus:string>" in formatted


def test_stream_equals_batch(spark):
    from strata.streaming.weekly import stream_weekly_trend
    streamed = {r.week: (r.attendance_rows, r.total_attendances) for r in stream_weekly_trend(spark, SF).collect()}
    qs = E.queries()
    batch = qs["weekly_rollup"](spark, SF).groupBy("week").sum("attendance_rows", "total_attendances").collect()
    assert streamed == {r[0]: (r[1], r[2]) for r in batch}


def test_stream_append_mode_reports_late_rows(spark, tmp_path):
    from strata.streaming.weekly import rows_dropped_by_watermark, stream_weekly_trend
    progress = []
    complete = stream_weekly_trend(spark, SF)
    appended = stream_weekly_trend(spark, SF, output_mode="append", watermark="0 seconds", progress=progress)
    assert progress and rows_dropped_by_watermark(progress) >= 0
    # append emits a week only once the watermark passes it: never more than complete mode
    assert appended.count() <= complete.count()
    got = {r.week: r.attendance_rows for r in appended.collect()}
    full = {r.week: r.attendance_rows for r in complete.collect()}
    assert all(got[w] <= full[w] for w in got)


def test_questions_frame_accepts_reference_inputs(spark):
    import pandas as pd
    from strata.plans.questions import questions_frame, route_questions
    for obj in ("Which day of the week has the best attendance?",
                ["Which day of the week has the best attendance?"],
                {"question": ["Which day of the week has the best attendance?"]},
                pd.DataFrame({"question": ["Which day of the week has the best attendance?"]}),
                spark.createDataFrame([("Which day of the week has the best attendance?",)], "question string")):
        rows = route_questions(questions_frame(spark, obj)).collect()
        assert [r.intent for r in rows] == ["weekday"]


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow", "FlatMapCoGroupsInArrow")


def test_no_registered_plan_has_cross_joins_or_python(spark):
    """The rule of the core queries; training-data operators may run Arrow tasks."""
    from strata.plans.registry import QUERIES

    bad = {}
    for key, build in QUERIES.items():
        text = plan_of(build(spark, SF))
        hits = [f for f in FORBIDDEN if f in text]
        if hits:
            bad[key] = hits
    assert not bad


def test_last_week_reads_its_months_only(spark, mini, tmp_path):
    """Both bounds of the week reach the partitions of both fact tables, whatever came later."""
    import datetime as dt

    from strata.operators.hierarchy import build_hierarchy
    from strata.plans.registry import Ctx
    from strata.plans.workload import k08_in
    from strata.sources.layout import write_program_tables
    from strata.sources.tables import load_tables

    write_program_tables(mini, str(tmp_path))
    t = load_tables(spark, str(tmp_path))
    out = k08_in(Ctx.of(spark, t, build_hierarchy(t)), dt.datetime(2024, 4, 1))
    formatted = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pruned = [line for line in formatted.splitlines() if "PartitionFilters" in line and "session_month" in line]
    assert len(pruned) >= 2 and all(">= 2024-03-01" in line and "<= 2024-03-01" in line for line in pruned)
    got = out.first()
    assert (got["sessions_scheduled"], got["attendance_rows"]) == (2, 4)


def test_scoped_session_counts_read_the_scope_first(spark):
    """With a scope, attendance meets the scope's sessions before it is aggregated."""
    from strata.operators.scope import Scope
    from strata.plans.registry import Ctx
    from strata.plans.workload import session_attendance

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(session_attendance(Ctx(spark, SF, Scope(academy_id=301))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in text[text.index("partial_count"):]
