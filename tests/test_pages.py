"""Deep pages through an index of ranges."""

import random

from strata.operators.pages import PageIndex


def test_every_page_equals_offset(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 2, 7]), k, f"r{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "day int, id bigint, page text".replace("text", "string")).repartition(6)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    index = PageIndex.build(df, ["day", "id"], range_rows=130)
    assert index.rows == 1000 and len(index.ranges) > 4
    for size in (7, 130, 400):
        for number in (0, 1, 2, 1000 // size, 1000 // size + 1, 10**9):
            got = index.page(number, size)
            assert got.columns == df.columns
            assert [tuple(r) for r in got.collect()] == want[number * size:(number + 1) * size], (number, size)


def test_a_page_reads_its_range_only(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    index = PageIndex.build(df, ["k"], range_rows=1000)
    page = index.page(77, 100)
    assert [r.k for r in page.collect()] == list(range(7700, 7800))
    plan = page._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    at = index.ranges[[a <= 7700 < b for a, b in zip(index.starts, index.starts[1:])].index(True)]
    assert f"page_range#" in plan and f"IN ({at}" in plan.replace("page_range#", "page_range") or f"= {at})" in plan


def test_empty_table(spark):
    index = PageIndex.build(spark.createDataFrame([], "a int"), ["a"])
    assert index.rows == 0 and index.page(0, 10).count() == 0 and index.page(3, 10).columns == ["a"]
