"""Broken values and lines do not stop a load; they are kept apart."""

import datetime as dt
import json

from strata.operators.metrics import kpis
from strata.operators.hierarchy import build_hierarchy
from strata.operators.scope import apply_scope
from strata.sources.lenient import load_lenient, quarantine_report, split_rows

SESSIONS = """session_id,cohort_id,session_date,duration_minutes
1,10,2024-01-01,60
2,10,2024-13-45,60
3,x,2024-01-02,60
4,10, 2024-01-03 ,45.0
5,10,2024-01-04 18:30:00,45.5
6,10
7,10,,
8,10,2024-01-05,30,surplus
9,"10",2024-01-06,"30"
"""


def test_good_rows_load_and_bad_ones_are_listed(spark, tmp_path):
    (tmp_path / "session.csv").write_text(SESSIONS)
    (tmp_path / "region.csv").write_text("region_id,region\n1,North\n,Nowhere\nabc,South\n")
    tables, bad = load_lenient(spark, str(tmp_path))
    got = {r["session_id"]: (r["cohort_id"], r["session_date"], r["duration_minutes"]) for r in tables["session"].collect()}
    assert got == {1: (10, dt.date(2024, 1, 1), 60), 4: (10, dt.date(2024, 1, 3), 45), 7: (10, None, None), 9: (10, dt.date(2024, 1, 6), 30)}
    assert [tuple(r) for r in tables["region"].collect()] == [(1, "North")]
    found = {tuple(r["problems"]): r["row"] for r in bad["session"].filter("problems[0] <> '_corrupt_record'").collect()}
    assert set(found) == {("session_date",), ("cohort_id",), ("duration_minutes",)}
    assert json.loads(found["cohort_id",])["cohort_id"] == "x"
    lines = {r["row"] for r in bad["session"].filter("problems[0] = '_corrupt_record'").collect()}
    assert lines == {"6,10", "8,10,2024-01-05,30,surplus"}
    report = {(r["table_name"], r["problem"]): r["bad_rows"] for r in quarantine_report(bad).collect()}
    assert report["session", "_corrupt_record"] == 2 and report["region", "region_id"] == 2 and report["session", "session_date"] == 1
    # every line is on one side
    assert tables["session"].count() + bad["session"].count() == 9
    assert "attendance" in tables.missing and bad["attendance"].count() == 0
    assert kpis(apply_scope(tables, build_hierarchy(tables)), dt.datetime(2024, 2, 1)).first()["total_sessions"] == 0


def test_json_lines(spark, tmp_path):
    (tmp_path / "cohort.json").write_text('{"cohort_id": 1, "academy_id": 5}\n{"cohort_id": "two", "academy_id": 5}\n{broken\n{"cohort_id": 3, "academy_id": 7.5}\n')
    tables, bad = load_lenient(spark, str(tmp_path), fmt="json", names=("cohort",))
    assert [tuple(r) for r in tables["cohort"].collect()] == [(1, 5)]
    assert sorted(r["problems"][0] for r in bad["cohort"].collect()) == ["_corrupt_record", "academy_id", "cohort_id"]


def test_typed_tables_pass_unchanged(spark, mini):
    for name, df in mini.frames.items():
        good, bad = split_rows(df, name)
        assert bad.count() == 0 and good.schema.simpleString() == df.schema.simpleString()
        assert sorted(map(str, good.collect())) == sorted(map(str, df.collect()))
