"""
of this code, on the same fixture mapping)."""

import datetime as dt

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
D = dt.date


@pytest.fixture(scope="module")
def q(spark):
    qs = E.queries()
    return lambda key: [r.asDict() for r in qs[key](spark, SF).collect()]


def test_kpis_no_scope_and_region0(q):
    k = q("kpi_overall")[0]
    assert [k[c] for c in ("total_participants", "active_participants", "total_sessions", "unique_session_days",
                           "total_attendances", "participants_attended", "total_achievements",
                           "unique_skills_achieved", "participants_with_achievements")] == \
        [2000, 602, 15000, 2399, 60000, 2000, 1981, 100, 150]
    assert k["avg_days_enrolled"] == pytest.approx(2323.522, abs=1e-3)
    assert k["avg_session_duration"] == pytest.approx(59.994, abs=1e-3)
    assert k["attendance_rate"] == pytest.approx(49.9183, abs=1e-4)
    r = q("drilldown_region")[0]
    assert [r[c] for c in ("total_participants", "active_participants", "total_sessions", "unique_session_days",
                           "total_attendances", "participants_attended", "total_achievements",
                           "unique_skills_achieved", "participants_with_achievements")] == \
        [392, 111, 2883, 1667, 11672, 1992, 365, 97, 29]
    assert r["avg_days_enrolled"] == pytest.approx(2320.8597, abs=1e-4)
    assert r["attendance_rate"] == pytest.approx(50.0857, abs=1e-4)


def test_trend_mix_and_top_academies(q):
    trend = sorted(q("weekly_trend"), key=lambda r: r["week"])
    assert len(trend) == 14
    first = trend[0]
    assert (first["week"], first["unique_attendees"], first["total_attendances"]) == (D(2001, 4, 30), 102, 103)
    assert first["attendance_rate"] == pytest.approx(56.3107, abs=1e-4)
    mix = {r["product_type_name"]: r["academy_count"] for r in q("product_mix")}
    assert mix == {"BUILDING": 74, "MACHINERY": 74, "FURNITURE": 73, "HOUSEHOLD": 73, "AUTOMOBILE": 72}
    top = [(r["academy_id"], r["cohort_count"]) for r in q("top_academies_by_cohorts")]
    assert top == [(301, 11), (345, 11), (365, 11), (322, 10), (461, 9), (703, 9), (71, 8), (115, 8), (213, 8),
                   (231, 8)]


def test_workload_golden(q):
    k1, k2 = q("k01_attendance_highest")[0], q("k02_attendance_lowest")[0]
    assert (k1["academy_code"], k1["attendance_rows"]) == ("A0085", 61)
    assert k1["attendance_rate"] == pytest.approx(62.2951, abs=1e-4)
    assert (k2["academy_code"], k2["attendance_rows"]) == ("A0655", 22)
    assert k2["attendance_rate"] == pytest.approx(31.8182, abs=1e-4)
    assert len(q("k03_inactive_participants")) == 1636
    assert len(q("k09b_active_14d")) == 11
    assert [(r["participant_id"], r["skills_achieved"]) for r in q("k05_top_skilled")] == \
        [(41, 24), (20, 19), (30, 19), (88, 19), (33, 18)]
    assert [(r["skill_id"], r["achievements"]) for r in q("k07_top_skills")] == \
        [(19, 30), (99, 30), (8, 29), (36, 27), (37, 27)]
    k8 = q("k08_last_week")[0]
    assert (k8["sessions_scheduled"], k8["sessions_with_attendance"], k8["attendance_rows"]) == (52, 50, 195)
    assert k8["avg_attendance_per_session"] == pytest.approx(3.9)
    assert [(r["community_name"], r["active_participants"]) for r in q("k09_active_communities")] == \
        [("C22", 19), ("C70", 18), ("C55", 17)]
    k11 = {r["quarter"]: r["attendance_rate"] for r in q("k11_quarter_trend")}
    assert k11[D(2001, 7, 1)] == pytest.approx(51.8652, abs=1e-4)
    assert k11[D(2001, 4, 1)] == pytest.approx(50.0, abs=1e-4)
    assert k11[D(2001, 1, 1)] == pytest.approx(49.1138, abs=1e-4)
