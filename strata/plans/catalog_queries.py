"""Registered catalog queries and the materialised weekly rollup."""

from __future__ import annotations

from strata.plans.oracle_base import with_programme
from pyspark.sql import functions as F

from strata.operators.scope import Scope
from strata.plans.registry import AS_OF, REGION, Ctx, register
from strata.session import shared_dir
from strata.sources import catalog as CAT
from strata.sources import layout as LY
from strata.sources import rollup as RU
from strata.sources import sinks as SK
from strata.sources.tables import DRIVER_TABLES, driver_tables


@register("table_row_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in DRIVER_TABLES))
def table_row_counts(spark, sf_dir):
    return CAT.table_row_counts(driver_tables(spark, sf_dir))


@register("schema_context")
def schema_context(spark, sf_dir):
    """Rows-only: one line per driver table, from the tables' schemas."""
    return CAT.schema_context(CAT.describe_frames(spark, dict(driver_tables(spark, sf_dir).items())))


_ROLLUP_SQL = with_programme("""
SELECT c.academy_id, CAST(date_trunc('week', s.session_date) AS DATE) AS week, count(*) AS attendance_rows,
       count(*) FILTER (WHERE a.attended_normalized) AS present_rows, count(a.participant_id) AS total_attendances,
       count(DISTINCT a.participant_id) AS unique_attendees
FROM p_attendance_n a JOIN p_session s ON a.session_id = s.session_id JOIN p_cohort c ON s.cohort_id = c.cohort_id
JOIN p_hierarchy h ON c.academy_id = h.academy_id
GROUP BY 1, 2""")


@register("weekly_rollup", _ROLLUP_SQL)
def weekly_rollup(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return SK.weekly_rollup(c.tables, c.hierarchy)


@register("rollup_refreshed", _ROLLUP_SQL)
def rollup_refreshed(spark, sf_dir):
    """The rollup after an incremental refresh: a third of the last months' attendance arrives late, as new
    files, and only the weeks these touch are computed again."""
    c = Ctx(spark, sf_dir)
    root, target = shared_dir(spark, "programme"), shared_dir(spark, "rollup")
    sessions = c.tables["session"]
    late = sessions.filter((F.col("session_date") >= F.lit("2001-06-01").cast("date")) & (F.pmod("session_id", F.lit(3)) == 0)).select("session_id")
    on_time = {**c.tables.frames, "attendance": c.tables["attendance"].join(late, "session_id", "left_anti")}
    LY.write_program_tables(type(c.tables)(on_time), root)
    RU.refresh(spark, root, target)
    RU.append_attendance(type(c.tables)({**c.tables.frames, "attendance": c.tables["attendance"].join(late, "session_id", "left_semi")}), root)
    RU.refresh(spark, root, target)
    return RU.read_weeks(spark, target)


@register("trend_from_bitmaps", with_programme("""
SELECT CAST(date_trunc('week', s.session_date) AS DATE) AS week,
       count(DISTINCT a.participant_id) AS unique_attendees,
       count(a.participant_id) AS total_attendances,
       round(count(*) FILTER (WHERE a.attended_normalized) * 100e0 / count(*), 6) AS attendance_rate
FROM p_attendance_n a JOIN s_session s ON a.session_id = s.session_id
WHERE date_trunc('week', s.session_date) >= TIMESTAMP '2000-07-26 00:00:00'
GROUP BY 1""", where=f"region_id = {REGION}"))
def trend_from_bitmaps(spark, sf_dir):
    """Region 0's weekly trend, distinct attendees included, from the written rollup and its bitmaps."""
    c = Ctx(spark, sf_dir)
    target = shared_dir(spark, "rollup")
    RU.build(c.tables, c.hierarchy, target)
    return RU.trend(spark, target, c.hierarchy, Scope(region_id=REGION), AS_OF, 365)


@register("stream_weekly_trend", with_programme("""
SELECT CAST(date_trunc('week', s.session_date) AS DATE) AS week, count(a.participant_id) AS total_attendances,
       count(*) AS attendance_rows,
       round(count(*) FILTER (WHERE a.attended_normalized) * 100e0 / count(*), 6) AS attendance_rate
FROM p_attendance_n a JOIN s_session s ON a.session_id = s.session_id GROUP BY 1"""))
def stream_weekly_trend(spark, sf_dir):
    """Streamed weekly counts and rate (the approximate distinct is left out of
    the compared columns)."""
    from strata.streaming.weekly import stream_weekly_trend as run

    out = run(spark, sf_dir)
    return out.select("week", "total_attendances", "attendance_rows",
                      F.round(F.col("present_rows").cast("double") * 100 / F.col("attendance_rows"), 6)
                      .alias("attendance_rate"))


@register("stream_weekly_unique", with_programme("""
, w AS (SELECT CAST(date_trunc('week', s.session_date) AS DATE) AS week, a.participant_id, a.attended_normalized, max(s.session_date) OVER () AS newest
  FROM p_attendance_n a JOIN s_session s ON a.session_id = s.session_id)
SELECT week, count(*) AS attendance_rows, count(participant_id) AS total_attendances,
       count(*) FILTER (WHERE attended_normalized) AS present_rows, count(DISTINCT participant_id) AS unique_attendees
FROM w WHERE week + 7 <= newest - 14 GROUP BY week"""))
def stream_weekly_unique(spark, sf_dir):
    """Streamed weeks with exact distinct attendees: those that the watermark (14 days) has closed."""
    from strata.sources.tables import program_tables
    from strata.streaming.weekly import attendance_stream, exact_weekly_trend_of

    return exact_weekly_trend_of(program_tables(spark, sf_dir), attendance_stream(spark, sf_dir))


# how DuckDB says the values of each line item column: as a number or as text
_LINE_NUMBERS = {c: f"CAST({c} AS DOUBLE)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")} | {"l_shipdate": "epoch_us(l_shipdate) / 1e6"}


def _profile_sql(c: str) -> str:
    number, text = _LINE_NUMBERS.get(c, "CAST(NULL AS DOUBLE)"), "CAST(NULL AS VARCHAR)" if c in _LINE_NUMBERS else c
    return (f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 1e0 / count(*), 6) AS null_share, "
            f"min({number}) AS min_number, max({number}) AS max_number, min({text}) AS min_text, max({text}) AS max_text FROM lineitem")


@register("profile_columns", "\nUNION ALL\n".join(_profile_sql(c) for c in (*_LINE_NUMBERS, "l_returnflag", "l_linestatus")))
def profile_columns(spark, sf_dir):
    """Facts of every line item column in one aggregation (the estimates are left out of the compared columns)."""
    facts = CAT.profile_columns(driver_tables(spark, sf_dir)["lineitem"])
    return facts.select("column_name", "row_count", "null_count", "null_share", "min_number", "max_number", "min_text", "max_text")
