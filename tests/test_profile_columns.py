"""Column facts from one aggregation."""

import datetime as dt

from strata.sources.catalog import accessible_tables, profile_columns, profile_tables

NTZ = "timestamp_ntz"


def test_facts_of_every_type(spark):
    at = dt.datetime(2024, 2, 29, 12, 30, 0, 250_000)
    rows = [(k, None if k % 4 == 0 else k / 2, "hot" if k % 2 else f"v{k}", k % 2 == 0, dt.date(1970, 1, 2), at, [k], b"x") for k in range(2000)]
    df = spark.createDataFrame(rows, f"id bigint, `odd name` double, s string, flag boolean, day date, at {NTZ}, many array<bigint>, raw binary")
    facts = {r["column_name"]: r for r in profile_columns(df).collect()}
    assert list(facts) == df.columns and all(r["row_count"] == 2000 for r in facts.values())
    assert (facts["odd name"]["null_count"], facts["odd name"]["null_share"], facts["odd name"]["min_number"], facts["odd name"]["max_number"]) == (500, 0.25, 0.5, 999.5)
    assert abs(facts["id"]["approx_distinct"] - 2000) < 200
    assert (facts["s"]["min_text"], facts["s"]["max_text"], facts["s"]["min_number"]) == ("hot", "v998", None)
    assert facts["s"]["frequent"][0]["value"] == "hot" and facts["s"]["frequent"][0]["count"] >= 1000
    assert {f["value"]: f["count"] for f in facts["flag"]["frequent"]} == {"true": 1000, "false": 1000}
    assert facts["day"]["max_number"] == 86_400
    assert facts["at"]["min_number"] == at.replace(tzinfo=dt.timezone.utc).timestamp() and facts["at"]["frequent"][0]["count"] == 2000
    assert facts["many"]["null_count"] == 0 and facts["many"]["frequent"] is None and facts["raw"]["approx_distinct"] is None


def test_one_scan_and_bounded_states(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = profile_columns(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert [(r["column_name"], r["row_count"], r["null_share"], r["min_number"], r["min_text"]) for r in profile_columns(df).collect()] == [("a", 0, None, None, None), ("b", 0, None, None, None)]


def test_profile_and_access_with_counts(spark):
    df = spark.range(7)
    assert profile_tables({"t": df})["t"]["column_facts"][0]["approx_distinct"] == 7
    df.createOrReplaceTempView("seven")
    got = {r["table_name"]: (r["accessible"], r["row_count"]) for r in accessible_tables(spark, ["seven", "no_such"], counts=True).collect()}
    assert got == {"seven": (True, 7), "no_such": (False, None)}
