"""Question tables: derive them, route them, answer them."""

from __future__ import annotations

import datetime as dt
import os
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from strata.functions.routing import EXAMPLE_QUESTIONS, route, route_corrected

ANSWER_SCHEMA = ("intent string, status string, answer string, sql string, row_count long, seconds double, "
                 "preview_json string, results string, error string")

# The order in which an intent's rows are shown (and its answer is phrased from
# the first one); answers with an order of their own repeat it here.
INTENT_ORDER = {
    "attendance_highest": "attendance_rate DESC, academy_code",
    "attendance_lowest": "attendance_rate, academy_code",
    "inactive": "participant_id",
    "session_duration": "region_id",
    "top_skilled": "skills_achieved DESC, participant_id",
    "lowest_skill_rate": "skill_rate, academy_code",
    "top_skills": "achievements DESC, skill_id",
    "last_week": "sessions_scheduled",
    "active_communities": "active_participants DESC, community_id",
    "attendance_by_product": "product_type_name",
    "quarter_trend": "quarter DESC",
    "weekday": "rank",
    "enrollment_growth": "month DESC",
    "snapshot": "total_participants",
}
# Intents that are sums of the same (academy, date) attendance counts.
DAILY_INTENTS = ("attendance_highest", "attendance_lowest", "attendance_by_product", "quarter_trend", "weekday")
# Intents that read the participants, or the skills of those in scope.
PARTICIPANT_INTENTS = ("inactive", "top_skilled", "lowest_skill_rate", "top_skills", "active_communities", "enrollment_growth", "snapshot")

PREVIEW_ROWS = 15  # rows shown with an answer; the full rows are DataFrames (``answer_results``)


def questions_from_events(events: DataFrame) -> DataFrame:
    """A question per event: the example question picked by event id, upper-
    cased for error events (so routing must be case-insensitive)."""
    pick = F.element_at(F.array(*[F.lit(q) for q in EXAMPLE_QUESTIONS]),
                        (F.pmod(F.col("event_id"), F.lit(len(EXAMPLE_QUESTIONS))) + 1).cast("int"))
    text = F.when(F.col("event_type") == "error", F.upper(pick)).otherwise(pick)
    return events.select(F.col("event_id").alias("question_id"), text.alias("question"))


def questions_frame(spark: SparkSession, model_input) -> DataFrame:
    """Coerce the batch scorer's input into a ``question_id, question`` table:
    a DataFrame with a ``question`` column, a pandas DataFrame, a dict of
    lists, a list of strings or one string (the forms the reference accepts).
    Only the caller's own question list passes through the driver here."""
    if isinstance(model_input, DataFrame):
        df = model_input
        if "question_id" not in df.columns:
            df = df.withColumn("question_id", F.monotonically_increasing_id())
        return df.select(F.col("question_id").cast("long"), F.col("question").cast("string"))
    if hasattr(model_input, "to_dict") and hasattr(model_input, "columns"):  # pandas
        model_input = model_input.to_dict(orient="list")
    if isinstance(model_input, dict):
        items = list(model_input.get("question", []))
    elif isinstance(model_input, str):
        items = [model_input]
    else:
        items = list(model_input)
    return spark.createDataFrame([(i, str(q)) for i, q in enumerate(items)], "question_id long, question string")


def route_questions(questions: DataFrame) -> DataFrame:
    """``intent`` by the dashboard's ladder and ``intent_corrected`` by ours."""
    q = F.col("question")
    return questions.withColumn("intent", route(q)).withColumn("intent_corrected", route_corrected(q))


def _change(value, unit: str) -> str:
    return "" if value is None else f" ({value:+.1f} {unit})"


def answer_text(intent: str, n: int, r: dict | None) -> str:
    """Deterministic answer sentence from the row count and the first row in
    the intent's order."""
    if n == 0 or r is None:
        return "The query returned no results."
    texts = {
        "attendance_highest": lambda: f"Academy {r['academy_code']} has the highest attendance rate: "
                                      f"{r['attendance_rate']:.1f}% over {r['attendance_rows']:,} records.",
        "attendance_lowest": lambda: f"Academy {r['academy_code']} has the lowest attendance rate: "
                                     f"{r['attendance_rate']:.1f}% over {r['attendance_rows']:,} records.",
        "inactive": lambda: f"{n:,} participants have not attended in the last 30 days.",
        "session_duration": lambda: f"Average session duration by region ({n:,} regions); e.g. {r['region_name']}: "
                                    f"{r['avg_duration']:.0f} minutes.",
        "top_skilled": lambda: f"Participant {r['participant_id']} leads with {r['skills_achieved']:,} distinct skills.",
        "lowest_skill_rate": lambda: f"Academy {r['academy_code']} has the lowest skill achievement rate: "
                                     f"{r['skill_rate']:.2f} per participant.",
        "top_skills": lambda: f"Most achieved skill this month: {r['skill_id']} ({r['achievements']:,} achievements).",
        "last_week": lambda: f"Last week: {r['sessions_scheduled']:,} sessions scheduled, {r['attendance_rows']:,} "
                             f"attendance records, {r['contact_hours']:,.1f} contact hours.",
        "active_communities": lambda: f"Community {r['community_name']} has the most active participants "
                                      f"({r['active_participants']:,}).",
        "attendance_by_product": lambda: f"Attendance by product type ({n:,} types); e.g. {r['product_type_name']}: "
                                         f"{r['attendance_rate']:.1f}%.",
        "quarter_trend": lambda: "Attendance is " + (
            "steady" if not r["change_pct_points"] else "improving" if r["change_pct_points"] > 0 else "declining")
        + f": {r['attendance_rate']:.1f}% in the quarter from {r['quarter']}{_change(r['change_pct_points'], 'points')}, "
          f"over {n:,} quarters.",
        "weekday": lambda: f"Best day: {r['day_name']} at {r['attendance_rate']:.1f}%.",
        "enrollment_growth": lambda: f"{r['new_participants']:,} participants enrolled in the month from {r['month']}"
                                     f"{_change(r['mom_pct'], '% on the month before')}, {r['running_total']:,} in "
                                     f"{n:,} months.",
        "snapshot": lambda: f"Snapshot: {r['total_participants']:,} participants, {r['total_sessions']:,} sessions, "
                            f"attendance rate {r['attendance_rate']:.1f}%, {r['total_achievements']:,} skill achievements.",
    }
    try:
        return texts[intent]()
    except (TypeError, KeyError, ValueError):  # a NULL value (e.g. all durations missing) or an unexpected row shape
        return f"The query returned {n:,} rows."


def answer_results(ctx, intents: list[str], as_of) -> dict[str, DataFrame]:
    """The full answer of each intent as a lazy DataFrame.  ``as_of`` is one
    clock, or a function of the intent."""
    from strata.plans.workload import INTENT_FUNCTIONS

    return {i: INTENT_FUNCTIONS[i](ctx, as_of(i) if callable(as_of) else as_of) for i in intents}


def answer_intent(ctx, intent: str, as_of, preview_rows: int = PREVIEW_ROWS, results_dir: str | None = None, results_format: str = "parquet") -> dict:
    """One intent's answer: rows are counted and the first ``preview_rows`` in
    its order taken in one pass (a top-k), as rows and as JSON made by Spark.  With
    ``results_dir`` all rows are written below it, as ``parquet`` or ``json``
    lines.  A failure becomes an answer with status "error"."""
    begun = time.perf_counter()
    out = dict.fromkeys(("answer", "row_count", "preview_json", "results", "error"))
    out |= {"intent": intent, "status": "success", "sql": f"query:{intent}", "rows": []}
    try:
        res = answer_results(ctx, [intent], as_of)[intent]
        if results_dir:
            out["results"] = os.path.join(results_dir, intent)
            kept = {"ignoreNullFields": "false"} if results_format == "json" else {}
            res.write.mode("overwrite").format(results_format).options(**kept).save(out["results"])
            res = ctx.spark.read.schema(res.schema).format(results_format).load(out["results"])
        seen = Observation()
        # each key within a struct: an answer that is sorted already would else be cut before all its rows are counted
        order = [F.struct(F.expr(c.removesuffix(" DESC"))).desc() if c.endswith(" DESC") else F.struct(F.expr(c)).asc()
                 for c in INTENT_ORDER[intent].split(", ")]
        shown = res.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order).limit(preview_rows).collect()
        out["rows"] = [r.asDict() for r in shown]
        as_json = F.to_json(F.struct(*res.columns), {"ignoreNullFields": "false"}).alias("row_json")
        lines = ctx.spark.createDataFrame(shown, res.schema).select(as_json).collect() if shown else []
        n = seen.get["n"]
        out |= {"row_count": n, "answer": answer_text(intent, n, out["rows"][0] if out["rows"] else None),
                "preview_json": "[" + ", ".join(r["row_json"] for r in lines) + "]"}
    except Exception as exc:  # one failing intent must not lose the batch
        out |= {"status": "error", "error": f"{type(exc).__name__}: {exc}", "answer": f"Error executing query: {exc}"}
    return out | {"seconds": round(time.perf_counter() - begun, 6)}


def answer_questions(questions: DataFrame, ctx, as_of: dt.datetime | Callable[[str], dt.datetime],
                     envelope: str = "standard", parallelism: int = 4, preview_rows: int = PREVIEW_ROWS,
                     results_dir: str | None = None, results_format: str = "parquet") -> DataFrame:
    """Envelope per question over any tables and scope (a ``Ctx``): status,
    question, answer, sql, row_count, execution_time, timestamp, error.
    ``envelope="extended"`` gives the other shape: result_count,
    execution_time_seconds, model, sql_query and raw_results (the folder that
    holds all rows, if ``results_dir`` is given; Parquet, or JSON lines with
    ``results_format="json"``).

    The questions are routed first and only the intents that occur are run, each
    once, from a few threads; what several of them derive (daily attendance, participants) is derived once and kept
    while they run.  The driver sees a bounded preview per intent; that
    answer table (at most one row per intent of the ladder) is broadcast."""
    routed = route_questions(questions).withColumn("intent", F.col("intent_corrected")).drop("intent_corrected")
    intents = sorted(r["intent"] for r in routed.select("intent").distinct().collect())
    shared = [sum(i in group for i in intents) > 1 for group in (DAILY_INTENTS, PARTICIPANT_INTENTS)]
    with ctx.shared_daily(shared[0]), ctx.shared_participants(shared[1]):
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            rows = list(pool.map(lambda i: answer_intent(ctx, i, as_of, preview_rows, results_dir, results_format), intents))
    names = [c.split()[0] for c in ANSWER_SCHEMA.split(", ")]
    answers = ctx.spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ANSWER_SCHEMA)
    out = routed.join(F.broadcast(answers), "intent", "left")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    if envelope == "extended":
        return out.select(
            "question_id", "status", "question", "intent", "answer", F.col("row_count").alias("result_count"),
            F.col("seconds").alias("execution_time_seconds"), F.lit(None).cast("string").alias("model"),
            F.col("sql").alias("sql_query"), F.col("results").alias("raw_results"), "preview_json", stamp, "error")
    return out.select("question_id", "status", "question", "intent", "answer", "sql", "row_count",
                      F.col("seconds").alias("execution_time"), stamp, "error", "preview_json")


__all__ = ["questions_from_events", "questions_frame", "route_questions", "answer_questions", "answer_intent",
           "answer_results", "answer_text"]
