"""Registered SQL-text and question jobs: extract_sql, route_questions,
guarded_sql, answer_questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.routing import EXAMPLE_QUESTIONS
from strata.functions.sqltext import with_extracted_sql
from strata.operators.sqljobs import guarded_sql as run_guarded
from strata.plans import questions as Q
from strata.plans.oracle_base import with_programme
from strata.plans.registry import AS_OF, SKILLS_AS_OF, Ctx, register
from strata.sources.tables import driver_tables

NL = "\n"


def replies_from_events(events):
    """A model-style reply per event, in six shapes (sql fence, plain fence,
    inline statement behind prose with the word "with", prose alone, WITH in a
    plain fence, upper-case fence)."""
    eid, uid, et = (F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type"))
    shape = F.pmod(F.col("event_id"), F.lit(6))
    text = (F.when(shape == 0, F.concat(F.lit("```sql" + NL + "SELECT event_type, count(*) FROM events WHERE user_id = "),
                                        uid, F.lit(NL + "GROUP BY event_type" + NL + "```")))
            .when(shape == 1, F.concat(F.lit("Here you go:" + NL + "```" + NL + "SELECT * FROM events WHERE event_id = "),
                                       eid, F.lit(";" + NL + "```" + NL + "Done.")))
            .when(shape == 2, F.concat(F.lit("Here is a query with the values: SELECT value FROM events WHERE event_type = '"), et,
                                       F.lit("';" + NL + NL + "Hope it helps.")))
            .when(shape == 3, F.concat(F.lit("  You could go with this one, no query needed for "), et, F.lit(" "), F.col("props"), F.lit("  ")))
            .when(shape == 4, F.concat(F.lit("```" + NL + "WITH t AS (SELECT * FROM events WHERE user_id = "), uid,
                                       F.lit(") SELECT count(*) FROM t" + NL + "```")))
            .otherwise(F.concat(F.lit("```SQL" + NL + "select l.* from lineitem l where l_orderkey = "), eid,
                                F.lit(NL + "```"))))
    return events.select(F.col("event_id").alias("reply_id"), text.alias("reply"))


# Written by hand from the six shapes, not from the patterns: what each ladder must find.
_EXTRACT_SQL = """
SELECT event_id AS reply_id,
  CASE event_id % 6
    WHEN 0 THEN 'SELECT event_type, count(*) FROM events WHERE user_id = ' || CAST(user_id AS VARCHAR) || chr(10) || 'GROUP BY event_type'
    WHEN 1 THEN 'SELECT * FROM events WHERE event_id = ' || CAST(event_id AS VARCHAR) || ';'
    WHEN 2 THEN 'SELECT value FROM events WHERE event_type = ''' || event_type || ''''
    WHEN 3 THEN 'You could go with this one, no query needed for ' || event_type || ' ' || props
    WHEN 4 THEN 'SELECT * FROM events WHERE user_id = ' || CAST(user_id AS VARCHAR) || ') SELECT count(*) FROM t' || chr(10) || '```'
    ELSE 'select l.* from lineitem l where l_orderkey = ' || CAST(event_id AS VARCHAR) END AS extracted_sql_reference,
  CASE event_id % 6
    WHEN 0 THEN 'SELECT event_type, count(*) FROM events WHERE user_id = ' || CAST(user_id AS VARCHAR) || chr(10) || 'GROUP BY event_type'
    WHEN 1 THEN 'SELECT * FROM events WHERE event_id = ' || CAST(event_id AS VARCHAR) || ';'
    WHEN 2 THEN 'SELECT value FROM events WHERE event_type = ''' || event_type || ''''
    WHEN 3 THEN 'You could go with this one, no query needed for ' || event_type || ' ' || props
    WHEN 4 THEN 'WITH t AS (SELECT * FROM events WHERE user_id = ' || CAST(user_id AS VARCHAR) || ') SELECT count(*) FROM t'
    ELSE 'select l.* from lineitem l where l_orderkey = ' || CAST(event_id AS VARCHAR) END AS extracted_sql
FROM events"""


@register("extract_sql", _EXTRACT_SQL)
def extract_sql_query(spark, sf_dir):
    replies = replies_from_events(driver_tables(spark, sf_dir)["events"])
    return with_extracted_sql(replies, "reply").select("reply_id", "extracted_sql_reference", "extracted_sql")


_Q_LIST = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in EXAMPLE_QUESTIONS) + "]"
_QUESTION_SQL = (f"CASE WHEN event_type = 'error' THEN upper({_Q_LIST}[(event_id % {len(EXAMPLE_QUESTIONS)}) + 1]) "
                 f"ELSE {_Q_LIST}[(event_id % {len(EXAMPLE_QUESTIONS)}) + 1] END")


# Written by hand: the intent of each example question, in their order.
_INTENTS_SQL = """['attendance_highest', 'inactive', 'session_duration', 'top_skilled', 'top_skilled', 'top_skills', 'last_week',
  'active_communities', 'attendance_by_product', 'quarter_trend', 'weekday', 'enrollment_growth', 'snapshot']"""
_CORRECTED_SQL = """['attendance_highest', 'inactive', 'session_duration', 'top_skilled', 'lowest_skill_rate', 'top_skills', 'last_week',
  'active_communities', 'attendance_by_product', 'quarter_trend', 'weekday', 'enrollment_growth', 'attendance_highest']"""


@register("route_questions", f"""
SELECT event_id AS question_id, {_QUESTION_SQL} AS question, {_INTENTS_SQL}[(event_id % 13) + 1] AS intent,
  {_CORRECTED_SQL}[(event_id % 13) + 1] AS intent_corrected FROM events""")
def route_questions_query(spark, sf_dir):
    return Q.route_questions(Q.questions_from_events(driver_tables(spark, sf_dir)["events"]))


GUARDED_TEXT = "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey;"


@register("guarded_sql", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
                         "ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def guarded_sql_query(spark, sf_dir):
    return run_guarded(spark, GUARDED_TEXT, max_rows=100, tables={"orders": driver_tables(spark, sf_dir)["orders"]}).df


def _as_of(intent: str):
    return SKILLS_AS_OF if intent == "top_skills" else AS_OF


@register("answer_questions")
def answer_questions_query(spark, sf_dir):
    """Rows-only: one envelope per question derived from the events."""
    questions = Q.questions_from_events(driver_tables(spark, sf_dir)["events"])
    return Q.answer_questions(questions, Ctx(spark, sf_dir), _as_of)


# How many rows each example question's answer has (by hand: fixed sizes, or counted below).
@register("answer_envelopes", with_programme(f"""
, sizes AS (SELECT
    (SELECT count(*) FROM s_participant p WHERE NOT EXISTS (SELECT 1 FROM f_attendance f WHERE f.participant_id = p.participant_id
      AND f.attended_normalized AND CAST(f.session_date AS TIMESTAMP) >= TIMESTAMP '2001-07-02 00:00:00')) AS inactive,
    (SELECT count(DISTINCT h.region_id) FROM s_session s JOIN s_cohort c ON s.cohort_id = c.cohort_id JOIN s_hierarchy h ON c.academy_id = h.academy_id) AS regions,
    (SELECT count(DISTINCT product_type_name) FROM f_attendance) AS products,
    (SELECT count(DISTINCT date_trunc('quarter', session_date)) FROM f_attendance) AS quarters,
    (SELECT count(DISTINCT isodow(session_date)) FROM f_attendance) AS days,
    (SELECT count(DISTINCT date_trunc('month', enrollment_date)) FROM s_participant WHERE enrollment_date IS NOT NULL) AS months,
    (SELECT least(count(DISTINCT skill_id), 5) FROM s_skill WHERE achieved_at >= TIMESTAMP '2024-01-01 00:00:00' AND achieved_at < TIMESTAMP '2024-01-31 00:00:00') AS skills)
SELECT event_id AS question_id, {_QUESTION_SQL} AS question, {_CORRECTED_SQL}[(event_id % 13) + 1] AS intent, 'success' AS status,
  CAST(NULL AS VARCHAR) AS error,
  CAST([1, inactive, regions, 5, 5, skills, 1, 3, products, quarters, days, months, 1][(event_id % 13) + 1] AS BIGINT) AS row_count
FROM events, sizes"""))
def answer_envelopes(spark, sf_dir):
    """The envelopes without their time stamps, texts and previews."""
    return answer_questions_query(spark, sf_dir).select("question_id", "question", "intent", "status", "error", "row_count")
