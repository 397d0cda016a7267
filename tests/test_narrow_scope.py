"""A narrow scope filters attendance at the scan, before any shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from strata.operators import metrics as M
from strata.operators import scope as SC
from strata.plans.registry import AS_OF, Ctx

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """As on large tables: no side is small enough for Spark to broadcast it by itself."""
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    yield
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(key)


def shuffled_rows(df) -> int:
    """Rows that the plan's exchanges wrote, from its own metrics after a run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_an_academy_ships_little_attendance(spark, no_broadcast):
    all_ = Ctx(spark, SF).scoped
    academy = all_.sessions.join(all_.cohorts, "cohort_id").agg(F.min("academy_id")).first()[0]
    c = Ctx(spark, SF, SC.Scope(academy_id=academy))
    every = c.tables["attendance"].count()
    narrow = SC.narrow(c.tables, c.scoped)
    assert sorted(map(str, narrow.attendance.collect())) == sorted(map(str, c.scoped.attendance.collect()))
    counts = M.attendance_kpis(narrow)
    assert shuffled_rows(counts) < 0.05 * every < shuffled_rows(M.attendance_kpis(c.scoped))
    assert M.kpis(narrow, AS_OF).collect() == M.kpis(c.scoped, AS_OF).collect()


def test_a_wide_scope_stays_as_it_is(spark):
    c = Ctx(spark, SF, SC.Scope(region_id=0))
    assert SC.narrow(c.tables, c.scoped, limit=3) is c.scoped
    text = c.scoped.attendance._jdf.queryExecution().analyzed().toString()
    assert not re.search("broadcast", text)
