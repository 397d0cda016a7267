"""``kpis_rollup`` unites blocks of 64 ids: its distinct counts at every level against those of each scope."""

import datetime as dt

from pyspark.sql import functions as F

from strata.operators import metrics as M
from strata.operators.hierarchy import build_hierarchy
from strata.operators.scope import Scope, apply_scope
from strata.sources.tables import Tables

AS_OF = dt.datetime(2024, 4, 7)


def test_distinct_values_over_many_blocks(spark, mini):
    ids = [None, -130, -1, 0, 1, 63, 64, 5_000_000, (1 << 40) + 7]
    rows = [(k, session, ids[(k + session) % len(ids)], "Present" if k % 2 else "absent") for k in range(7) for session in (1, 2, 3, 4, 6)]
    t = Tables({**mini.frames, "attendance": spark.createDataFrame(rows, mini["attendance"].schema)})
    h = build_hierarchy(t)
    out = M.kpis_rollup(t, h, AS_OF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ShuffledHashJoin" in plan
    got = {(r["level"], r["region_id"], r["academy_id"]): r for r in out.collect()}
    for key, scope in ((("all", None, None), Scope()), (("region", 0, None), Scope(region_id=0)), (("region", 1, None), Scope(region_id=1)),
                       (("academy", 0, 1000), Scope(academy_id=1000)), (("academy", 0, 1001), Scope(academy_id=1001))):
        want = M.kpis(apply_scope(t, h, scope), AS_OF).first().asDict()
        assert {k: got[key][k] for k in want} == want, key


def test_first_and_last_orders_hold_the_orders_only(spark):
    """Lines, several times the orders, are streamed past them unsorted."""
    from strata.sources.tables import derive_program_tables

    people = derive_program_tables(spark, "/root/testdata/sf0.001")["participant"]
    plan = people._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert people.count() == people.select("participant_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey").distinct().count()
    assert people.filter(F.col("cohort_id").isNull()).count() == 0
