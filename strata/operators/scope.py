"""Scope: the optional region/city/community/academy ids, and the semi-join
chain that narrows every fact table to it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from strata.functions.dates import as_datetime, on_or_after
from strata.functions.flags import active, attended
from strata.sources.tables import Tables


@dataclass(frozen=True)
class Scope:
    """Independently combinable equality filters on the hierarchy.

    ``None`` means "All".  Id 0 is a real id (tested with ``is not None``).
    """

    region_id: int | None = None
    city_id: int | None = None
    community_id: int | None = None
    academy_id: int | None = None

    def filter(self, hierarchy: DataFrame) -> DataFrame:
        out = hierarchy
        for name in ("region_id", "city_id", "community_id", "academy_id"):
            value = getattr(self, name)
            if value is not None:
                out = out.filter(F.col(name) == F.lit(value))
        return out


@dataclass
class Scoped:
    """The six narrowed tables, all lazy, and the skills before they are narrowed (for a join that narrows
    them anyway)."""

    hierarchy: DataFrame
    cohorts: DataFrame
    participants: DataFrame
    sessions: DataFrame
    attendance: DataFrame
    skills: DataFrame
    all_skills: DataFrame | None = None


def attendance_normalized(tables: Tables) -> DataFrame:
    return tables["attendance"].withColumn("attended_normalized", attended())


def participants_normalized(tables: Tables) -> DataFrame:
    return tables["participant"].withColumn("is_active_normalized", active())


def apply_scope(tables: Tables, hierarchy: DataFrame, scope: Scope | None = None) -> Scoped:
    """Narrow the facts to the academies in ``scope``.

    cohort semi academy; participant and session semi cohort; attendance semi
    session (by session only: an attendee from elsewhere counts where the
    session was held); skill semi participant.  The cohort step applies even
    with no scope, so rows outside the hierarchy always drop.  Semi joins never
    add rows; Spark picks broadcast or shuffle per side from its size, and the
    big attendance-session semi join is skew-split by AQE.
    """
    scope = scope or Scope()
    h = scope.filter(hierarchy)
    academy_ids = h.select("academy_id")
    cohorts = tables["cohort"].join(academy_ids, "academy_id", "left_semi")
    cohort_ids = cohorts.select("cohort_id")
    participants = participants_normalized(tables).join(cohort_ids, "cohort_id", "left_semi")
    sessions = tables["session"].join(cohort_ids, "cohort_id", "left_semi")
    attendance = attendance_normalized(tables).join(sessions.select("session_id"), "session_id", "left_semi")
    skills = tables["skill_achievement"].join(participants.select("participant_id"), "participant_id", "left_semi")
    return Scoped(h, cohorts, participants, sessions, attendance, skills, tables["skill_achievement"])


# So many session ids (16 MB) may be sent to every task.
SMALL_IDS = 1 << 21


def narrow(tables: Tables, scoped: Scoped, limit: int = SMALL_IDS) -> Scoped:
    """``scoped`` with a filter of its session ids at the attendance scan, where they are few.

    A static plan cannot know how few sessions a scope leaves, so it may shuffle all attendance to meet them.
    Here the ids are found first (one job over the sessions) and counted: up to ``limit`` they are
    broadcast, and attendance outside the scope drops at the scan, before any shuffle; beyond it
    the scope stays as it is.  The ids are kept in memory until ``unpersist`` of the session's cache; a lost block
    is computed again.
    """
    ids = scoped.sessions.select("session_id").filter("session_id is not null").distinct().persist()
    if ids.limit(limit + 1).count() > limit:
        ids.unpersist()
        return scoped
    attendance = attendance_normalized(tables).join(F.broadcast(ids), "session_id", "left_semi")
    return replace(scoped, attendance=attendance)


def sessions_in_range(sessions: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Sessions with ``start <= session_date <= end`` (either bound optional)."""
    out = sessions
    if start is not None:
        out = out.filter(F.col("session_date") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("session_date") <= F.lit(end))
    return out


# The month of its session, which the written layout adds to both fact tables.
MONTH_COLUMN = "session_month"


def _recent_months(df: DataFrame, as_of, days_back: int, until: dt.date | None = None) -> DataFrame:
    """Only the months that a window can touch, where the table is partitioned by
    month: constant predicates on the partition column.  ``until`` is the window's
    last day (None: open)."""
    if MONTH_COLUMN not in df.columns:
        return df
    first = (as_datetime(as_of) - dt.timedelta(days=days_back)).date().replace(day=1)
    out = df.filter(F.col(MONTH_COLUMN) >= F.lit(first))
    return out if until is None else out.filter(F.col(MONTH_COLUMN) <= F.lit(until.replace(day=1)))


def sessions_since(sessions: DataFrame, as_of, days_back: int, until: dt.date | None = None) -> DataFrame:
    """Sessions of the window: from ``days_back`` before ``as_of`` to the day ``until``."""
    out = _recent_months(sessions, as_of, days_back, until).filter(on_or_after("session_date", as_of, days_back))
    return out if until is None else out.filter(F.col("session_date") <= F.lit(until))


def attendance_in(tables: Tables, sessions: DataFrame | None, as_of, days_back: int,
                  columns: tuple[str, ...] = ("session_id",), until: dt.date | None = None) -> DataFrame:
    """Attendance of the months that the window can touch, joined to the given
    sessions (None: not joined), with ``columns`` of theirs."""
    a = _recent_months(attendance_normalized(tables), as_of, days_back, until).drop(MONTH_COLUMN)
    return a if sessions is None else a.join(sessions.select(*columns), "session_id")
