"""Catalog jobs and loading."""

import os

import pytest

from strata.schemas import SCHEMAS
from strata.sources import catalog as CAT
from strata.sources.tables import load_tables, program_tables


def test_load_tables_missing_become_typed_empty(spark, tmp_path):
    spark.createDataFrame([(1, "N")], "region_id long, region string").write.parquet(str(tmp_path / "region.parquet"))
    t = load_tables(spark, str(tmp_path), names=("region", "city"))
    assert t["region"].columns == ["region_id", "region_name"]  # documented alias renamed
    assert t["region"].first().region_name == "N"
    assert "city" in t.missing and t["city"].count() == 0
    assert t["city"].schema == SCHEMAS["city"]


def test_load_tables_csv(spark, tmp_path):
    path = tmp_path / "cohort.csv"
    spark.createDataFrame([(1, 10), (None, 11)], "cohort_id long, academy_id long").write.option("header", True)\
        .csv(str(path))
    t = load_tables(spark, str(tmp_path), fmt="csv", names=("cohort",))
    assert [tuple(r) for r in t["cohort"].collect()] == [(1, 10)]  # NULL dimension key dropped


def test_catalog_jobs(spark):
    CAT.ensure_schema(spark, "strata_test_ns")
    assert "strata_test_ns" in [r[0] for r in spark.sql("SHOW SCHEMAS").collect()]
    spark.range(3).createOrReplaceTempView("t_three")
    names = [r.tableName for r in CAT.list_tables(spark).collect()]
    assert "t_three" in names
    acc = {r.table_name: r.accessible for r in CAT.accessible_tables(spark, ["t_three", "no_such_t"]).collect()}
    assert acc == {"t_three": True, "no_such_t": False}
    desc = CAT.describe_tables(spark, ["t_three", "no_such_t"])
    ctx = {r.table_name: r.context_line for r in CAT.schema_context(desc, max_columns=12).collect()}
    assert ctx["t_three"] == "t_three(id:bigint)"
    assert ctx["no_such_t"].startswith("no_such_t(error:")


def test_schema_context_caps(spark):
    spark.range(1).selectExpr(*[f"id AS c{i}" for i in range(14)]).createOrReplaceTempView("wide_t")
    line = CAT.schema_context(CAT.describe_tables(spark, ["wide_t"]), max_columns=12).first().context_line
    assert line.endswith(" ... (14 total))") and line.count(":bigint") == 12


def test_profile_and_counts(spark):
    t = program_tables(spark, "/root/testdata/sf0.001")
    prof = CAT.profile_tables({"region": t["region"], "city": t["city"]})
    assert prof["region"]["row_count"] == 5 and len(prof["region"]["sample"]) == 3
    counts = {r.table_name: r.row_count for r in CAT.table_row_counts({"city": t["city"]}).collect()}
    assert counts == {"city": 25}


def test_weekly_rollup_sink_roundtrip(spark, tmp_path):
    import datetime as dt
    from strata.operators.hierarchy import build_hierarchy
    from strata.operators.scope import Scope, apply_scope
    from strata.operators.trends import attendance_trends
    from strata.sources import sinks
    t = program_tables(spark, "/root/testdata/sf0.001")
    h = build_hierarchy(t)
    path = str(tmp_path / "rollup")
    sinks.write_weekly_rollup(sinks.weekly_rollup(t, h, with_sketch=True), path)
    assert os.path.isdir(path)
    as_of = dt.datetime(2001, 8, 1)
    from_rollup = {r.week: r for r in sinks.trend_from_rollup(spark, path, h, Scope(region_id=1), as_of).collect()}
    direct = {r.week: r for r in attendance_trends(t, apply_scope(t, h, Scope(region_id=1)), as_of, 90).collect()}
    assert set(from_rollup) == set(direct)
    first = min(direct)  # the week holding the cutoff is partial in the live trend
    for week, r in direct.items():
        if week == first:
            assert from_rollup[week].total_attendances >= r.total_attendances
            continue
        assert from_rollup[week].total_attendances == r.total_attendances
        assert from_rollup[week].attendance_rate == r.attendance_rate
        assert abs(from_rollup[week].unique_attendees_est - r.unique_attendees) <= max(2, 0.1 * r.unique_attendees)


def test_materialised_layout_prunes_months(spark, tmp_path):
    import datetime as dt
    from strata.operators.hierarchy import build_hierarchy
    from strata.operators.scope import apply_scope
    from strata.operators.trends import attendance_trends
    from strata.sources.layout import write_program_tables
    derived = program_tables(spark, "/root/testdata/sf0.001")
    root = str(tmp_path / "layout")
    write_program_tables(derived, root)
    loaded = load_tables(spark, root)
    assert not loaded.missing - {"sport_type"}
    as_of = dt.datetime(2001, 8, 1)

    def trend(t):
        return attendance_trends(t, apply_scope(t, build_hierarchy(t)), as_of, 90)

    got, want = trend(loaded), trend(derived)
    assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(session_month" in plan and "2001-05-01" in plan


def test_reload_drops_memoised_plans(spark):
    from strata.plans.registry import Ctx
    from strata.sources.tables import memo_slot, reload
    sf = "/root/testdata/sf0.001"
    first = Ctx(spark, sf)
    assert Ctx(spark, sf).hierarchy is first.hierarchy
    assert first.hierarchy.is_cached
    reload(spark)
    assert "hierarchy" not in memo_slot(spark, sf)
    assert Ctx(spark, sf).hierarchy is not first.hierarchy


def test_layout_file_counts_are_bounded(spark, tmp_path):
    import glob
    from strata.sources.layout import write_program_tables
    root = str(tmp_path / "layout")
    write_program_tables(program_tables(spark, "/root/testdata/sf0.001"), root)
    for month_dir in glob.glob(root + "/attendance/session_month=*"):
        assert len(glob.glob(month_dir + "/*.parquet")) <= 2


def test_cluster_conf_scales_with_cores():
    from strata.session import cluster_conf
    assert cluster_conf(8000)["spark.sql.shuffle.partitions"] == "32000"


def test_no_local_checkpoint_folder_on_a_cluster():
    from strata.session import checkpoint_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_hot_session_is_split_into_files(spark, tmp_path):
    """A session with nearly all rows ends in several files, not in one task."""
    import datetime as dt
    import glob

    from strata.schemas import conform, empty
    from strata.sources.layout import write_program_tables
    from strata.sources.tables import Tables
    session = spark.createDataFrame([(k, 1, dt.date(2024, 1, 2), 60) for k in range(3)], "session_id long, cohort_id long, session_date date, duration_minutes int")
    attendance = spark.range(200_000).selectExpr("id AS attendance_id", "IF(id % 50 = 0, 2L, 1L) AS session_id", "id AS participant_id", "uuid() AS attendance_status")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
             "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        frames = {"session": conform(session, "session"), "attendance": conform(attendance, "attendance"), "region": empty(spark, "region")}
        write_program_tables(Tables(frames), str(tmp_path))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(glob.glob(f"{tmp_path}/attendance/session_month=2024-01-01/*.parquet")) > 1


def test_loading_survives_a_corrupt_file(spark, tmp_path):
    from strata.dashboard import Dashboard
    root = tmp_path / "t"
    (root / "participant").mkdir(parents=True)
    (root / "participant" / "part-0.parquet").write_bytes(b"this is no parquet file at all")
    spark.createDataFrame([(1, "North")], "region_id long, region_name string").write.parquet(str(root / "region"))
    t = load_tables(spark, str(root))
    assert "participant" in t.missing and len(t.errors["participant"]) > 30 and "region" not in t.missing
    assert t["participant"].count() == 0 and t["region"].count() == 1
    assert "participant" in Dashboard(spark, t).notices()


def test_accessible_means_readable(spark, tmp_path):
    path = tmp_path / "gone"
    spark.range(10).write.option("path", str(path)).mode("overwrite").saveAsTable("strata_gone")
    try:
        for f in path.glob("*.parquet"):
            f.write_bytes(b"broken")
        spark.catalog.refreshTable("strata_gone")
        rows = {r.table_name: r for r in CAT.accessible_tables(spark, ["strata_gone", "strata_never"]).collect()}
        assert not rows["strata_gone"].accessible and rows["strata_gone"].error
        assert not rows["strata_never"].accessible
    finally:
        spark.sql("DROP TABLE IF EXISTS strata_gone")


def test_schema_context_says_what_it_leaves_out(spark):
    frames = {f"t{k:02d}": spark.range(1).selectExpr(*[f"id AS c{i}" for i in range(20)]) for k in range(18)}
    described = CAT.describe_frames(spark, frames)
    assert CAT.schema_context(described).count() == 18
    assert CAT.schema_context(described).where("context_line LIKE '%c19:bigint)'").count() == 18
    lines = [r.context_line for r in CAT.schema_context(described, max_tables=15).collect()]
    assert len(lines) == 16 and lines[-1] == "... and 3 more"


def test_any_order_key_and_segment(spark, tmp_path):
    """Keys beyond 40 bits, negative keys and unknown segments lose nothing."""
    import datetime as dt
    big = 1 << 45
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("region", [(0, "R")], "r_regionkey long, r_name string")
    write("nation", [(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long")
    write("customer", [(1, 0, "MACHINERY", 10.0), (2, 0, "SPACE", 10.0)], "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double")
    ts = lambda d: dt.datetime(2001, 1, d)
    write("orders", [(big, 1, ts(2), "O"), (-5, 2, ts(1), "F"), (big + 1, 2, ts(2), "F")], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string")
    write("lineitem", [(big, 7, "N", "O"), (-5, 7, "N", "O"), (big + 1, 7, "R", "O")], "l_orderkey long, l_partkey long, l_returnflag string, l_linestatus string")
    write("events", [(1, 7, dt.datetime(2001, 1, 1), "purchase", '{"k": 3}')], "event_id long, user_id long, ts timestamp, event_type string, props string")
    t = program_tables(spark, str(tmp_path))
    p = t["participant"].collect()
    assert [(r.participant_id, r.cohort_id, r.is_active) for r in p] == [(7, 2, "inactive")]
    assert t["cohort"].where("academy_id IS NULL").count() == 0
    assert {r.product_type_name for r in t["product_type"].collect()} == {"MACHINERY", "unknown"}


def test_window_queries_prune_both_fact_tables(spark, tmp_path):
    """On the written layout K3, K8, K9b and the trend read the window's months of
    sessions and attendance only."""
    from strata.operators.hierarchy import build_hierarchy
    from strata.operators.trends import attendance_trends
    from strata.plans import workload as W
    from strata.plans.registry import AS_OF, Ctx
    from strata.sources.layout import write_program_tables
    root = str(tmp_path / "layout")
    live = Ctx(spark, "/root/testdata/sf0.001")
    write_program_tables(live.tables, root)
    t = load_tables(spark, root)
    c = Ctx.of(spark, t, build_hierarchy(t))
    trend = lambda x: attendance_trends(x.tables, x.scoped, AS_OF, 90)
    for fn in (W.k03_in, W.k08_in, W.k09b_in, trend):
        df = fn(c)
        plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        pruned = [line.split("PartitionFilters:")[0] for line in scans if "session_month" in line.split("PartitionFilters:")[1].split("PushedFilters")[0]]
        assert any("attendance_status" in s for s in pruned) and any("session_date" in s for s in pruned), plan
        assert sorted(map(str, df.collect())) == sorted(map(str, fn(live).collect()))


def test_second_stream_run_reads_only_new_files(spark, tmp_path, mini):
    from strata.streaming.weekly import attendance_table_stream, weekly_trend_of
    table, out, state = (str(tmp_path / x) for x in ("attendance", "out", "state"))
    rows = mini["attendance"].orderBy("attendance_id").collect()
    schema = mini["attendance"].schema
    spark.createDataFrame(rows[:4], schema).write.parquet(table)
    progress: list = []
    run = lambda: weekly_trend_of(mini, attendance_table_stream(spark, table), sink_path=out, checkpoint=state, progress=progress)
    first = sum(r.attendance_rows for r in run().collect())
    seen = sum(p["numInputRows"] for p in progress)
    spark.createDataFrame(rows[4:], schema).write.mode("append").parquet(table)
    progress.clear()
    total = sum(r.attendance_rows for r in run().collect())
    assert seen == 4 and sum(p["numInputRows"] for p in progress) == len(rows) - 4
    joined = mini["attendance"].join(mini["session"].where("session_date IS NOT NULL"), "session_id")
    assert first < total <= joined.count()


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    from strata.sources.layout import save_program_tables
    derived = program_tables(spark, "/root/testdata/sf0.001")
    save_program_tables(spark, derived, "strata_layout_test", str(tmp_path / "tables"), buckets=8)
    try:
        t = load_tables(spark, "strata_layout_test")
        assert not t.missing - {"sport_type"}
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = t["attendance"].join(t["session"], "session_id")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert joined.count() == derived["attendance"].join(derived["session"], "session_id").count()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    finally:
        for name in derived.frames:
            spark.sql(f"DROP TABLE IF EXISTS strata_layout_test.{name}")


def test_schema_context_without_suffix(spark):
    spark.range(1).selectExpr(*[f"id AS c{i}" for i in range(16)]).createOrReplaceTempView("wide_t2")
    line = CAT.schema_context(CAT.describe_tables(spark, ["wide_t2"]), max_tables=20, max_columns=15,
                              suffix=False).first().context_line
    assert line.count(":bigint") == 15 and "total" not in line


def test_list_tables_preview(spark):
    for i in range(17):
        spark.range(1).createOrReplaceTempView(f"prev_t{i:02d}")
    listed = CAT.list_tables(spark).filter("tableName LIKE 'prev_t%'")
    row = CAT.list_tables_preview(listed, 15).first()
    assert row.table_count == 17 and row.preview.endswith(" ... and 2 more")
    assert row.preview.startswith("prev_t00, prev_t01")


def test_answer_records_json_sink(spark, tmp_path):
    import json as js
    from strata.sources.sinks import write_records_json
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "id long, s string, x double")
    path = str(tmp_path / "records")
    write_records_json(df, path)
    lines = [js.loads(x) for f in sorted(os.listdir(path)) if f.endswith(".json")
             for x in open(os.path.join(path, f)) if x.strip()]
    assert sorted(r["id"] for r in lines) == [1, 2]
    assert [r for r in lines if r["id"] == 2][0]["x"] == 1.5
