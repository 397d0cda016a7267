"""The dashboard workflow on the mini-fixture."""

import datetime as dt

import pytest

from strata.dashboard import Dashboard
from strata.operators.scope import Scope


@pytest.fixture(scope="module")
def dash(spark, mini):
    return Dashboard(spark, mini, dt.datetime(2024, 3, 31))


def test_select_by_labels(dash):
    assert dash.select() == Scope()
    assert dash.select(region="North") == Scope(region_id=0)
    assert dash.select(region="North", city="Alpha", academy="AC2") == Scope(0, 10, None, 1001)
    with pytest.raises(ValueError):
        dash.select(region="North", city="Beta")  # Beta is not under North


def test_metrics_trends_views(dash):
    north = dash.select(region="North")
    m = dash.metrics(north).first()
    assert (m.total_participants, m.total_sessions, m.total_attendances) == (4, 4, 6)
    weeks = [(r.week, r.total_attendances) for r in dash.trends(north, 90).collect()]
    assert weeks == [(dt.date(2024, 1, 1), 1), (dt.date(2024, 3, 25), 3)]
    assert [r.week for r in dash.trends(north, 7).collect()] == [dt.date(2024, 3, 25)]
    with pytest.raises(ValueError):
        dash.trends(north, 0)
    assert [r.product_type_name for r in dash.product_mix().collect()] == ["Youth", "Elite"]
    assert [r.cohort_count for r in dash.cohort_overview().collect()] == [2, 1, 1]
    options = [(r.level, r.option_name) for r in dash.options(north).collect()]
    assert [o for lv, o in options if lv == "region"] == ["All", "North", "South"]
    assert [lv for lv, o in options if o == "All"] == ["region", "city", "community", "academy"]
    assert [o for lv, o in options if lv == "academy"] == ["All", "AC1", "AC2"]
    assert dash.all_levels().filter("level = 'all'").first().total_participants == 5


def test_ask_within_scope(dash):
    north = dash.select(region="North")
    a = dash.ask("Which academy has the highest attendance rate?", north)
    assert a["intent"] == "attendance_highest"
    assert a["rows"][0]["academy_code"] == "AC1" and a["rows"][0]["attendance_rate"] == 80.0
    assert a["answer"].startswith("Academy AC1 has the highest attendance rate: 80.0%")
    snap = dash.ask("anything else?", north)
    assert snap["intent"] == "snapshot" and snap["rows"][0]["total_participants"] == 4


def test_reload_sees_new_rows(spark, tmp_path, mini):
    from strata.sources.layout import write_program_tables
    root = str(tmp_path / "tables")
    write_program_tables(mini, root)
    d = Dashboard.load(spark, root, as_of=dt.datetime(2024, 3, 31), cache=True)
    assert d.metrics().first().total_participants == 5
    extra = spark.createDataFrame([(7, 3, dt.date(2024, 3, 2), "yes")],
                                  "participant_id long, cohort_id long, enrollment_date date, is_active string")
    extra.write.mode("append").parquet(root + "/participant")
    d.reload()
    assert d.metrics().first().total_participants == 6
