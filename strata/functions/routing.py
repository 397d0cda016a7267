"""Route plain-language questions to intents: an ordered keyword ladder over
the lower-cased question, first match wins (a CASE expression, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The dashboard's keyword ladder, in order.  Each rule is
# (intent, all-of groups); a group matches when any of its phrases occurs.
LADDER = [
    ("attendance_highest", [["attendance rate"], ["highest"]]),
    ("attendance_lowest", [["attendance rate"], ["lowest", "worst"]]),
    ("inactive", [["haven't attended", "inactive"]]),
    ("session_duration", [["average session duration"]]),
    ("top_skilled", [["most skills", "skill achievement"]]),
    ("top_skills", [["top 5 skills", "top skills"]]),
    ("last_week", [["scheduled last week", "sessions last week"]]),
    ("active_communities", [["most active participants"]]),
    ("attendance_by_product", [["compare attendance"], ["product type"]]),
    ("quarter_trend", [["improving or declining", "trend"]]),
    ("weekday", [["day of the week"]]),
    ("enrollment_growth", [["enrollment"], ["growth"]]),
]
DEFAULT_INTENT = "snapshot"

# Ours: questions that the ladder above sends to the wrong answer, tried first.
CORRECTIONS = [
    ("lowest_skill_rate", [["skill achievement"], ["lowest", "worst"]]),
    ("attendance_highest", [["attendance rate"], ["best"]]),
]

# The dashboard's example questions, then its input placeholder.
EXAMPLE_QUESTIONS = [
    "Which academy has the highest attendance rate?",
    "Show me participants who haven't attended in the last 30 days",
    "What's the average session duration by region?",
    "Which participants have achieved the most skills?",
    "List academies with the lowest skill achievement rates",
    "Show me the top 5 skills being learned this month",
    "How many sessions were scheduled last week?",
    "Which communities have the most active participants?",
    "Compare attendance rates between product types",
    "Is attendance improving or declining this quarter?",
    "Which day of the week has the best attendance?",
    "Show me growth in participant enrollment over time",
    "Which academy has the best attendance rate?",
]


def route_corrected(question: Column) -> Column:
    """The ladder with our corrections in front of it."""
    return route(question, CORRECTIONS + LADDER)


def route(question: Column, ladder: list | None = None) -> Column:
    q = F.lower(question)
    expr = None
    for intent, groups in ladder or LADDER:
        cond = None
        for group in groups:
            any_of = None
            for phrase in group:
                hit = q.contains(phrase)
                any_of = hit if any_of is None else (any_of | hit)
            cond = any_of if cond is None else (cond & any_of)
        expr = F.when(cond, F.lit(intent)) if expr is None else expr.when(cond, F.lit(intent))
    return expr.otherwise(F.lit(DEFAULT_INTENT))
