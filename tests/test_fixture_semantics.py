"""Operator semantics on the mini-fixture (expected values: FIXTURES.md)."""

import datetime as dt

import pytest

from strata.functions.flags import ACTIVE_WORDS, ATTENDED_WORDS, truthy
from strata.operators import hierarchy as H
from strata.operators import metrics as M
from strata.operators import scope as SC
from strata.operators import trends as T

AS_OF = dt.datetime(2024, 3, 31)


def kpi_tuple(row):
    r = row.asDict()
    return (r["total_participants"], r["active_participants"], r["avg_days_enrolled"],
            r["total_sessions"], r["unique_session_days"], r["avg_session_duration"],
            r["total_attendances"], r["attendance_rate"], r["participants_attended"],
            r["total_achievements"], r["unique_skills_achieved"], r["participants_with_achievements"])


@pytest.mark.parametrize("scope,expected", [
    (SC.Scope(), (5, 2, 44.75, 5, 4, 50.0, 7, 71.428571, 5, 4, 2, 3)),
    (SC.Scope(region_id=0), (4, 2, 59.666667, 4, 3, 36.666667, 6, 66.666667, 4, 4, 2, 3)),
    (SC.Scope(region_id=1), (1, 0, 0.0, 1, 1, 90.0, 1, 100.0, 1, 0, 0, 0)),
    (SC.Scope(academy_id=1003), (0, 0, 0.0, 0, 0, 0.0, 0, 0.0, 0, 0, 0, 0)),
])
def test_kpis(mini, scope, expected):
    h = H.build_hierarchy(mini)
    got = kpi_tuple(M.kpis(SC.apply_scope(mini, h, scope), AS_OF).first())
    assert got == pytest.approx(expected)


def test_single_fact_kpis_agree_with_overall(mini):
    scoped = SC.apply_scope(mini, H.build_hierarchy(mini))
    p = M.participant_kpis(scoped, AS_OF).first()
    s = M.session_kpis(scoped).first()
    a = M.attendance_kpis(scoped).first()
    k = M.skill_kpis(scoped).first()
    assert (p.total_participants, s.total_sessions, a.total_attendances, k.total_achievements) == (5, 5, 7, 4)


def trend_rows(df):
    return [(r.week, r.unique_attendees, r.total_attendances, r.attendance_rate) for r in df.orderBy("week").collect()]


def test_weekly_trend_midnight_and_noon(mini):
    h = H.build_hierarchy(mini)
    scoped = SC.apply_scope(mini, h)
    d = dt.date
    assert trend_rows(T.attendance_trends(mini, scoped, AS_OF, 90)) == [
        (d(2024, 1, 1), 1, 1, 100.0), (d(2024, 3, 25), 3, 3, 50.0), (d(2024, 4, 1), 1, 1, 100.0)]
    noon = dt.datetime(2024, 3, 31, 12)
    assert trend_rows(T.attendance_trends(mini, scoped, noon, 90)) == [
        (d(2024, 3, 25), 3, 3, 50.0), (d(2024, 4, 1), 1, 1, 100.0)]
    region0 = SC.apply_scope(mini, h, SC.Scope(region_id=0))
    assert trend_rows(T.attendance_trends(mini, region0, AS_OF, 90)) == [
        (d(2024, 1, 1), 1, 1, 100.0), (d(2024, 3, 25), 3, 3, 50.0)]


def test_product_mix_and_cohorts(mini):
    scoped = SC.apply_scope(mini, H.build_hierarchy(mini))
    mix = {r.product_type_name: r.academy_count for r in T.product_mix(scoped).collect()}
    assert mix == {"Youth": 2, "Elite": 1}
    share = {r.product_type_name: r.share_pct for r in T.product_mix_share(scoped).collect()}
    assert share["Youth"] == pytest.approx(66.666667)
    top = [(r.academy_id, r.cohort_count) for r in T.top_academies_by_cohorts(scoped).collect()]
    assert top == [(1000, 2), (1001, 1), (1002, 1)]


def test_hierarchy_nulls(mini):
    rows = {r.academy_code: r for r in H.build_hierarchy(mini).collect()}
    assert rows["AC4"].community_name is None and rows["AC4"].city_id is None and rows["AC4"].region_id is None
    assert rows["AC3"].product_type_name is None
    assert rows["AC1"].region_name == "North"


def test_missing_product_type_gives_unknown(mini):
    from strata.sources.tables import Tables
    t = Tables(dict(mini.frames), missing={"product_type"})
    assert {r.product_type_name for r in H.build_hierarchy(t).collect()} == {"Unknown"}


def test_drilldown_options_cascade(mini):
    h = H.build_hierarchy(mini)
    opts = H.drilldown_options(h, SC.Scope(region_id=0)).collect()
    by_level = {}
    for r in opts:
        by_level.setdefault(r.level, set()).add((r.option_name, r.option_id))
    assert by_level["region"] == {("North", 0), ("South", 1)}
    assert by_level["city"] == {("Alpha", 10)}
    assert by_level["academy"] == {("AC1", 1000), ("AC2", 1001)}
    assert H.resolve_name(h, "region", "North") == 0


@pytest.mark.parametrize("value,expected", [
    (True, True), (1, True), ("present", True), ("yes", True),
    (1.0, False), (" Present", False), ("Y", False), (None, False)])
def test_truthy(spark, value, expected):
    from pyspark.sql import types as Ty
    if isinstance(value, bool):
        t = Ty.BooleanType()
    elif isinstance(value, int):
        t = Ty.LongType()
    elif isinstance(value, float):
        t = Ty.DoubleType()
    else:
        t = Ty.StringType()
    df = spark.createDataFrame([(value,)], Ty.StructType([Ty.StructField("v", t)]))
    assert df.select(truthy("v", ATTENDED_WORDS).alias("b")).first().b is expected
    assert df.select(truthy("v", ACTIVE_WORDS).alias("b")).first().b is (expected and value != "present")


def test_apply_scope_idempotent_and_semi_joins_never_add_rows(mini):
    h = H.build_hierarchy(mini)
    scope = SC.Scope(region_id=0)
    once = SC.apply_scope(mini, h, scope)
    assert once.attendance.count() <= mini["attendance"].count()
    again = SC.apply_scope(mini, once.hierarchy, scope)
    assert sorted(once.sessions.collect()) == sorted(again.sessions.collect())


def test_rollup_on_fixture(mini):
    out = M.kpis_rollup(mini, H.build_hierarchy(mini), AS_OF).collect()
    total = [r for r in out if r.level == "all"][0]
    assert (total.total_participants, total.total_attendances, total.attendance_rate) == (5, 7, 71.428571)
    region0 = [r for r in out if r.level == "region" and r.region_id == 0][0]
    assert (region0.total_participants, region0.total_sessions, region0.participants_attended) == (4, 4, 4)
    ac4 = [r for r in out if r.level == "academy" and r.academy_id == 1003][0]
    assert ac4.total_participants == 0 and ac4.avg_days_enrolled == 0.0
