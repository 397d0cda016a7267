"""Exact quantiles against sorting, on data that strains the brackets."""

import math
import random

import pytest

from strata.operators import quantiles as Q
from strata.operators.shapes import summary_stats

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


def plain(values, share):
    from fractions import Fraction

    known = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return known[max(1, math.ceil(Fraction(str(share)) * len(known))) - 1] if known else None


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_quantiles_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 8)
    monkeypatch.setattr(Q, "ACCURACY", 50)  # wide brackets: many values inside, some overlap
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    n = 4000
    data = {
        "smooth": [rng.gauss(0, 1) for _ in range(n)],
        "hot": [5.0 if rng.random() < 0.6 else rng.random() * 10 for _ in range(n)],
        "few": [float(rng.randrange(3)) for _ in range(n)],
        "holes": [None if rng.random() < 0.5 else rng.expovariate(1) * 1e12 for _ in range(n)],
        "odd": [rng.choice([nan, inf, -inf, 0.0, -0.0, 1e308, -1e308, 5e-324, None, 1.5]) for _ in range(n)],
        "empty": [None] * n,
        "one": [None] * (n - 1) + [7.0],
    }
    rows = list(zip(*data.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    got = {(r["column_name"], r["share"]): r["value"] for r in Q.quantiles(df, list(data), SHARES).collect()}
    assert len(got) == len(data) * len(SHARES)
    for c, values in data.items():
        for q in SHARES:
            assert same(got[c, q], plain(values, q)), (c, q, got[c, q], plain(values, q))
    assert Q.quantiles(df.limit(0), ["smooth"]).filter("value is not null").count() == 0


def test_two_passes_without_a_sort_of_the_column(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cells = Q.quantiles(df, ["l_extendedprice"])
    files = cells.inputFiles()  # the last step reads what the second pass counted, not the table
    assert files and all("quantile-cells" in f for f in files)


def test_summary_with_percentiles(spark):
    df = spark.range(1, 101).selectExpr("cast(id as double) as x", "cast(id % 4 as int) as k")
    rows = {r["column_name"]: r for r in summary_stats(df, ["x", "k"], shares=(0.25, 0.5, 0.75)).collect()}
    assert (rows["x"]["p25"], rows["x"]["p50"], rows["x"]["p75"], rows["x"]["max_value"]) == (25.0, 50.0, 75.0, 100.0)
    assert (rows["k"]["p25"], rows["k"]["p50"], rows["k"]["p75"]) == (0.0, 1.0, 2.0)


@pytest.mark.parametrize("share", [0.1, 1 / 3])
def test_rank_is_exact_for_any_share(spark, share):
    df = spark.range(1, 31).selectExpr("cast(id as double) as x")
    assert Q.quantiles(df, ["x"], [share]).first()["value"] == plain([float(i) for i in range(1, 31)], share)
