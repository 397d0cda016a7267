"""A snapshot pins its files, swaps all tables at once, and expires."""

import os

import pytest

from strata.dashboard import Dashboard
from strata.sources.layout import write_program_tables
from strata.sources.snapshot import Snapshot


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


@pytest.fixture
def place(mini, tmp_path):
    write_program_tables(mini, str(tmp_path))
    return str(tmp_path)


def grow(mini, place):
    """New files in two tables: a second copy of the participants, and of the cohorts."""
    for name in ("participant", "cohort"):
        mini[name].write.mode("append").parquet(os.path.join(place, name))


def test_files_added_later_are_unseen_until_the_snapshot_expires(spark, mini, place):
    clock = Clock()
    snap = Snapshot(spark, place, ttl=3600, clock=clock)
    n = mini["participant"].count()
    files = snap.manifest().count()
    assert snap.tables["participant"].count() == n
    grow(mini, place)
    clock.now = 3599
    assert snap.tables["participant"].count() == n and snap.version == 1 and snap.manifest().count() == files
    clock.now = 3601
    assert snap.tables["participant"].count() == 2 * n and snap.tables["cohort"].count() == 2 * mini["cohort"].count()
    assert snap.version == 2 and snap.manifest().count() > files and snap.age == 0


def test_plans_keep_their_snapshot(spark, mini, place):
    """A plan made before a reload reads the old files, one made after it the new ones."""
    snap = Snapshot(spark, place, ttl=None)
    before = snap.tables
    grow(mini, place)
    snap.reload()
    assert before["participant"].count() == mini["participant"].count()
    assert snap.tables["participant"].count() == 2 * mini["participant"].count()
    assert not snap.expired


def test_dashboard_renews_all_tables_together(spark, mini, place):
    clock = Clock()
    dash = Dashboard(spark, Snapshot(spark, place, ttl=60, clock=clock), "2024-03-31")
    first = dash.metrics().first()["total_participants"]
    hierarchy = dash.hierarchy
    grow(mini, place)
    assert dash.metrics().first()["total_participants"] == first and dash.hierarchy is hierarchy
    clock.now = 61
    assert dash.hierarchy is not hierarchy
    assert dash.metrics().first()["total_participants"] == 2 * first
    dash.reload()
    assert dash.metrics().first()["total_participants"] == 2 * first
