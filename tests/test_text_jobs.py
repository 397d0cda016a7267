"""SQL extraction, question routing, guarded SQL."""

import pytest
from pyspark.sql import functions as F

from strata.functions.routing import EXAMPLE_QUESTIONS, route
from strata.functions.sqltext import extract_sql, extract_sql_reference
from strata.operators.sqljobs import guarded_sql

EXPECTED_INTENTS = [
    "attendance_highest", "inactive", "session_duration", "top_skilled", "top_skilled", "top_skills",
    "last_week", "active_communities", "attendance_by_product", "quarter_trend", "weekday", "enrollment_growth", "snapshot",
]


def test_router_examples(spark):
    df = spark.createDataFrame([(q,) for q in EXAMPLE_QUESTIONS], "question string")
    got = [r.intent for r in df.select(route(F.col("question")).alias("intent")).collect()]
    assert got == EXPECTED_INTENTS


@pytest.mark.parametrize("q,intent", [
    ("WHICH ACADEMY HAS THE LOWEST ATTENDANCE RATE?", "attendance_lowest"),
    ("worst attendance rate please", "attendance_lowest"),
    ("show the trend", "quarter_trend"),
    ("most active participants by community", "active_communities"),
    ("inactive attendance rate highest", "attendance_highest"),  # order matters: rule 1 first
])
def test_router_order(spark, q, intent):
    df = spark.createDataFrame([(q,)], "question string")
    assert df.select(route(F.col("question")).alias("i")).first().i == intent


CASES = [
    ("```sql\nSELECT 1\n```", "SELECT 1", "SELECT 1"),
    ("```SQL\nselect a from t\n```", "select a from t", "select a from t"),
    ("x\n```\nSELECT b FROM t;\n```\n", "SELECT b FROM t;", "SELECT b FROM t;"),
    ("Use SELECT c FROM t; thanks", "SELECT c FROM t", "SELECT c FROM t"),
    ("Use select d from t\n\nmore", "select d from t", "select d from t"),
    ("```\nWITH w AS (SELECT 1) SELECT * FROM w\n```", "SELECT 1) SELECT * FROM w\n```",
     "WITH w AS (SELECT 1) SELECT * FROM w"),
    ("  nothing here  ", "nothing here", "nothing here"),
    ("Here is a query with the counts per type: SELECT a FROM t;", "SELECT a FROM t", "SELECT a FROM t"),
    ("Run SELECT ';' AS a, 'x\n\ny' AS b FROM t; done", "SELECT '", "SELECT ';' AS a, 'x\n\ny' AS b FROM t"),
    ("Run SELECT a /* one; two */ FROM t -- no; end\nWHERE b = 1;", "SELECT a /* one", "SELECT a /* one; two */ FROM t -- no; end\nWHERE b = 1"),
    ("SELECT it's from t; rest", "SELECT it's from t", "SELECT it's from t"),
    ("You can select a chart from the list; then go.", "select a chart from the list", "You can select a chart from the list; then go."),
    ("Please select one of these options.", "select one of these options.", "Please select one of these options."),
    ("Try select 1 + 1", "select 1 + 1", "select 1 + 1"),
    ("select count(*), 'the' from orders; ok", "select count(*), 'the' from orders", "select count(*), 'the' from orders"),
    ("I select from the menu and leave", "select from the menu and leave", "I select from the menu and leave"),
    ("You could go with this one.", "You could go with this one.", "You could go with this one."),
    ("Try WITH w (a, b) AS (SELECT 1, 2) SELECT a FROM w; ok", "SELECT 1, 2) SELECT a FROM w", "WITH w (a, b) AS (SELECT 1, 2) SELECT a FROM w"),
]


@pytest.mark.parametrize("text,reference,ours", CASES)
def test_extract_sql(spark, text, reference, ours):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(extract_sql_reference(F.col("t")).alias("a"), extract_sql(F.col("t")).alias("b")).first()
    assert r.a == reference
    assert r.b == ours


def test_guarded_sql(spark):
    spark.range(500).createOrReplaceTempView("nums")
    ok = guarded_sql(spark, "SELECT id AS credit_limit FROM nums ORDER BY id;")
    assert ok.ok and ok.df.count() == 100
    bad = guarded_sql(spark, "SELECT no_such_col FROM nums")
    assert not bad.ok and bad.df.columns == ["error", "sql"]
    assert "no_such_col" in bad.df.first().error
    parse = guarded_sql(spark, "SELEC 1")
    assert not parse.ok
    runtime = guarded_sql(spark, "SELECT CAST('x' AS INT) AS v", eager=True)
    assert not runtime.ok


def test_shared_ladder_equals_column_functions(spark):
    from strata.functions.sqltext import with_extracted_sql
    df = spark.createDataFrame([(t,) for t, _, _ in CASES], "t string")
    got = with_extracted_sql(df, "t", "a", "b").select("t", "a", "b").collect()
    assert [(r.a, r.b) for r in got] == [(ref, ours) for _, ref, ours in CASES]


def test_answer_envelopes(spark):
    from strata.plans.questions import answer_questions, questions_frame
    from strata.plans.registry import AS_OF, Ctx
    c = Ctx(spark, "/root/testdata/sf0.001")
    qs = ["Which day of the week has the best attendance?", "What is going on?",
          "How many sessions were scheduled last week?"]
    out = answer_questions(questions_frame(spark, qs), c, AS_OF)
    rows = {r.question: r for r in out.collect()}
    assert len(rows) == 3 and all(r.status == "success" and r.error is None for r in rows.values())
    assert rows[qs[0]].intent == "weekday" and rows[qs[0]].answer.startswith("Best day: ")
    assert rows[qs[1]].intent == "snapshot" and "participants" in rows[qs[1]].answer
    assert rows[qs[2]].answer.startswith("Last week: ")
    assert set(out.columns) >= {"status", "question", "answer", "sql", "row_count", "execution_time", "timestamp",
                                "error"}
    assert all(r.execution_time > 0 for r in rows.values())
    ext = answer_questions(questions_frame(spark, qs[:1]), c, AS_OF, envelope="extended")
    assert {"result_count", "execution_time_seconds", "model", "sql_query", "raw_results"} <= set(ext.columns)
    assert ext.first().result_count == 7


def test_full_answers_leave_as_tables(spark, tmp_path):
    from strata.plans.questions import PREVIEW_ROWS, answer_questions, answer_results, questions_frame
    from strata.plans.registry import AS_OF, Ctx
    c = Ctx(spark, "/root/testdata/sf0.001")
    q = questions_frame(spark, ["Show me participants who haven't attended in the last 30 days"])
    r = answer_questions(q, c, AS_OF, envelope="extended", results_dir=str(tmp_path)).first()
    assert r.result_count > PREVIEW_ROWS
    assert spark.read.parquet(r.raw_results).count() == r.result_count == answer_results(c, ["inactive"], AS_OF)["inactive"].count()
    import json
    shown = [x["participant_id"] for x in json.loads(r.preview_json)]
    assert len(shown) == PREVIEW_ROWS and shown == sorted(shown)


def test_one_failing_intent_keeps_the_rest(spark, monkeypatch):
    from strata.plans import workload
    from strata.plans.questions import answer_questions, questions_frame
    from strata.plans.registry import AS_OF, Ctx

    def broken(c, as_of):
        raise ValueError("no such table")

    monkeypatch.setitem(workload.INTENT_FUNCTIONS, "weekday", broken)
    qs = ["Which day of the week has the best attendance?", "What is going on?"]
    rows = {r.intent: r for r in answer_questions(questions_frame(spark, qs), Ctx(spark, "/root/testdata/sf0.001"), AS_OF).collect()}
    assert rows["weekday"].status == "error" and rows["weekday"].answer == "Error executing query: no such table"
    assert "no such table" in rows["weekday"].error and rows["snapshot"].status == "success"


def test_only_routed_intents_run(spark, monkeypatch):
    from strata.plans import workload
    from strata.plans.questions import answer_questions, questions_frame
    from strata.plans.registry import AS_OF, Ctx
    ran = []
    for name, fn in list(workload.INTENT_FUNCTIONS.items()):
        monkeypatch.setitem(workload.INTENT_FUNCTIONS, name, lambda c, a, n=name, f=fn: (ran.append(n), f(c, a))[1])
    answer_questions(questions_frame(spark, ["Which academy has the best attendance rate?", "quarter trend"]), Ctx(spark, "/root/testdata/sf0.001"), AS_OF)
    assert sorted(ran) == ["attendance_highest", "quarter_trend"]


def test_corrected_router(spark):
    from strata.functions.routing import route_corrected
    qs = ["List academies with the lowest skill achievement rates", "Which academy has the best attendance rate?", "Which participants have achieved the most skills?"]
    got = [r.i for r in spark.createDataFrame([(q,) for q in qs], "question string").select(route_corrected(F.col("question")).alias("i")).collect()]
    assert got == ["lowest_skill_rate", "attendance_highest", "top_skilled"]


def test_guarded_sql_refuses_statements_that_write(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("guard_keep")
    try:
        for text in ("DROP TABLE guard_keep", "  -- note\n insert into guard_keep values (9)",
                     "SELECT 1; DROP TABLE guard_keep", "SET spark.sql.shuffle.partitions=1",
                     "WITH t AS (SELECT 1 AS a) INSERT INTO guard_keep SELECT * FROM t",
                     "FROM (SELECT 2 AS a) INSERT INTO guard_keep SELECT a", "WITH t AS (SELECT 1 AS a) DELETE FROM guard_keep",
                     "UPDATE guard_keep SET id = 1", "MERGE INTO guard_keep USING guard_keep AS s ON true WHEN MATCHED THEN DELETE",
                     "CREATE TABLE guard_new AS SELECT 1 AS a", "CACHE TABLE guard_keep", "SELECT 1) INSERT INTO guard_keep (SELECT 2",
                     "INSERT INTO guard_keep VALUES (1) --", "TRUNCATE TABLE guard_keep"):
            g = guarded_sql(spark, text)
            assert not g.ok and g.df.first().error, text
        assert sorted(r.id for r in spark.table("guard_keep").collect()) == [0, 1, 2]
        assert guarded_sql(spark, "(SELECT 1 AS one)").df.first().one == 1
        assert guarded_sql(spark, "SELECT ';' AS x;").df.first().x == ";"
        assert guarded_sql(spark, "SELECT 1 AS one -- the end").df.first().one == 1
        assert guarded_sql(spark, "SELECT id FROM {t} ORDER BY id DESC", tables={"t": spark.range(5)}).df.first().id == 4
        many = guarded_sql(spark, "SELECT id FROM range(500) ORDER BY id DESC", eager=True)
        assert many.truncated and many.df.count() == 100 and many.df.first().id == 499
        every = guarded_sql(spark, "SELECT id FROM range(500)", max_rows=None, eager=True)
        assert every.truncated is False and every.df.count() == 500
        ok = guarded_sql(spark, "/* c */ WITH t AS (SELECT * FROM guard_keep) SELECT count(*) AS n FROM t")
        assert ok.ok and ok.df.first().n == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS guard_keep")


@pytest.mark.parametrize("text,expected", [
    ("```sql\nSELECT 1\n```", "SELECT 1"),
    ("```sql  \nSELECT 1\n```", "SELECT 1\n```"),        # no whitespace tolerated after the fence word
    ("Use SELECT c FROM t; thanks", "SELECT c FROM t"),
    ("Use select d from t\n\nmore", "select d from t\n\nmore"),  # a blank line does not stop it
    ("```\nSELECT b FROM t\n```", "SELECT b FROM t\n```"),  # no plain-fence step
])
def test_extract_sql_short(spark, text, expected):
    from strata.functions.sqltext import extract_sql_short
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(extract_sql_short(F.col("t")).alias("s")).first().s == expected


def test_guarded_sql_error_shapes_and_run_sql(spark):
    from strata.operators.sqljobs import run_sql
    for cols in (("error", "sql"), ("error", "query"), ("error",)):
        g = guarded_sql(spark, "SELECT nope FROM nowhere_t", error_columns=cols)
        assert not g.ok and tuple(g.df.columns) == cols
    assert run_sql(spark, "SELECT nope FROM nowhere_t").columns == []
    assert run_sql(spark, "SELECT 1 AS one").first().one == 1


def test_answer_text_survives_nulls():
    from strata.plans.questions import answer_text
    assert answer_text("session_duration", 2, {"region_name": "X", "avg_duration": None}) == \
        "The query returned 2 rows."
    assert answer_text("weekday", 0, None) == "The query returned no results."
    assert answer_text("weekday", 7, {"day_name": "Monday", "attendance_rate": 51.25}) == "Best day: Monday at 51.2%."


def test_answers_within_a_scope(spark):
    from strata.operators.scope import Scope
    from strata.plans.questions import answer_questions, questions_frame
    from strata.plans.registry import AS_OF, Ctx
    q = questions_frame(spark, ["Give me a snapshot"])
    everything = answer_questions(q, Ctx(spark, "/root/testdata/sf0.001"), AS_OF).first()
    region1 = answer_questions(q, Ctx(spark, "/root/testdata/sf0.001", Scope(region_id=1)), AS_OF).first()
    assert everything.intent == region1.intent == "snapshot"
    assert everything.answer != region1.answer  # fewer participants within region 1


def test_long_replies_with_many_parts(spark):
    """Hundreds of thousands of lines, quotes and comments are read without recursion."""
    body = "SELECT a\n" + "  , 'x;' AS b -- c;\n" * 100_000 + "FROM t"
    df = spark.createDataFrame([("Go: " + body + "; done",)], "t string")
    assert df.select(extract_sql(F.col("t")).alias("s")).first().s == body


def test_full_answers_leave_as_json_lines(spark, tmp_path):
    import json

    from strata.plans.questions import answer_questions, questions_frame
    from strata.plans.registry import AS_OF, Ctx
    c = Ctx(spark, "/root/testdata/sf0.001")
    q = questions_frame(spark, ["Show me participants who haven't attended in the last 30 days"])
    r = answer_questions(q, c, AS_OF, envelope="extended", results_dir=str(tmp_path), results_format="json").first()
    lines = [json.loads(x["value"]) for x in spark.read.text(r.raw_results).collect()]
    assert len(lines) == r.result_count and all(set(x) == {"participant_id", "cohort_id", "enrollment_date", "is_active"} for x in lines)
    preview = json.loads(r.preview_json)
    assert all(x in lines for x in preview) and preview == sorted(preview, key=lambda x: x["participant_id"])


def test_sorted_answers_are_counted_whole(spark):
    """An answer whose rows already stand in the preview's order is still counted to its end."""
    from strata.plans.questions import PREVIEW_ROWS, answer_intent, answer_results
    from strata.plans.registry import AS_OF, Ctx
    c = Ctx(spark, "/root/testdata/sf0.01")
    got = answer_intent(c, "inactive", AS_OF)
    assert got["row_count"] == answer_results(c, ["inactive"], AS_OF)["inactive"].count() > PREVIEW_ROWS == len(got["rows"])


def test_participants_are_derived_once_for_all_intents(spark, mini):
    """Each participant's row is made once, however many intents read it, and is not kept after the answers."""
    from strata.operators.hierarchy import build_hierarchy
    from strata.plans.questions import answer_questions, questions_frame
    from strata.plans.registry import AS_OF, Ctx
    from strata.sources.tables import Tables

    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    people = mini["participant"].withColumn("is_active", F.udf(seen, "string")("is_active"))
    t = Tables({**mini.frames, "participant": people})
    qs = ["How many participants are inactive?", "Which communities have the most active participants?", "enrollment growth"]
    got = answer_questions(questions_frame(spark, qs), Ctx.of(spark, t, build_hierarchy(t)), AS_OF).collect()
    assert {r.status for r in got} == {"success"} and len({r.intent for r in got}) > 1
    assert made.value == mini["participant"].count()
    assert not people.is_cached
