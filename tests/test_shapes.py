"""Generic shapes against brute force on small inputs."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.operators import shapes as SH


def test_keyset_pages_equal_offset_pages(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    last, seen = None, []
    for page in range(5):
        by_offset = [r.k for r in SH.paginate(df, ["k"], page, 37).collect()]
        by_key = [r.k for r in SH.page_after(df, "k", last, 37).collect()]
        assert by_offset == by_key
        last = by_key[-1]
        seen += by_key
    assert seen == list(range(185))


def test_summary_stats_match_pandas(spark):
    rows = [(1.0, 10.25), (2.0, 20.5), (4.0, None), (8.0, 40.75)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r.column_name: r for r in SH.summary_stats(df, ["a", "b"]).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    for c in ("a", "b"):
        s = pdf[c].dropna()
        assert got[c]["count"] == len(s)
        assert got[c].min_value == s.min() and got[c].max_value == s.max()
        assert got[c].mean == pytest.approx(s.mean(), rel=1e-8)
        assert got[c].stddev == pytest.approx(s.std(), rel=1e-8)


def test_summary_stats_beyond_two_decimals_and_without_cancellation(spark):
    df = spark.createDataFrame([(0.001, 1e9, 1e17), (0.004, 1e9 + 1, 3e17), (0.002, 1e9, 2e17)], "a double, b double, c double")
    got = {r.column_name: r for r in SH.summary_stats(df, ["a", "b", "c"]).collect()}
    assert got["a"].mean == pytest.approx(0.007 / 3, rel=1e-8) and got["a"].stddev == pytest.approx(0.0015275252, rel=1e-6)
    assert got["b"].stddev == pytest.approx(0.5773502692, rel=1e-3)
    assert got["c"].mean == pytest.approx(2e17) and got["c"].stddev == pytest.approx(1e17)


def test_keyset_pages_keep_tied_rows(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (2, 4), (3, 5)], "k long, id long")
    last, seen = None, []
    while True:
        page = [(r.k, r.id) for r in SH.page_after(df, ["k", "id"], last, 2).collect()]
        if not page:
            break
        seen += page
        last = page[-1]
    assert seen == [(1, 1), (2, 2), (2, 3), (2, 4), (3, 5)]
    with pytest.raises(ValueError):
        SH.page_after(df, ["k", "id"], [1], 2)


def test_distribution_has_no_single_task_window(spark):
    plan = SH.distribution(spark.range(100), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_growth_over_time_skips_missing_months(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5), 10.0), (dt.date(2024, 2, 1), 15.0),
                                (dt.date(2024, 4, 1), 30.0)], "d date, v double")
    got = {r.month: r.mom_pct for r in SH.growth_over_time(df, "d", F.sum("v")).collect()}
    assert got == {dt.date(2024, 1, 1): None, dt.date(2024, 2, 1): 50.0, dt.date(2024, 4, 1): None}


def test_top_n_total_order_and_distribution(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("a", 2)], "k string, v long")
    top = [(r.k, r.total) for r in SH.top_n(df, ["k"], F.sum("v"), "total", 2).collect()]
    assert top == [("a", 3), ("b", 3)]  # tie broken by key
    dist = {r.k: (r.row_count, r.share_pct) for r in SH.distribution(df, "k").collect()}
    assert dist == {"a": (2, 50.0), "b": (1, 25.0), "c": (1, 25.0)}
    assert sorted(r.k for r in SH.distinct_values(df, "k").collect()) == ["a", "b", "c"]
    assert SH.filter_equals(df, "k", "a").count() == 2
