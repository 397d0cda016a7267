"""Any page of an ordered table without sorting past the rows before it."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strata.session import shared_dir

RANGE_ROWS = 1 << 20


def _held(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("page_range", T.IntegerType())])


class PageIndex:
    """The rows of a table in ranges of their order, with the number of rows in each.

    Building it deals the rows into ranges of about ``range_rows`` and writes each as a partition of its own;
    the counts (one number per range) stay with the index.  A page then reads the one or two ranges in which
    their sums say it lies, and sorts those.  ``order_by`` must end in a unique key, as pages do not
    overlap otherwise; NULLs come first.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, order_by: Sequence[str], counts: list[tuple[int, int]]):
        self.spark, self.path, self.schema, self.order_by = spark, path, schema, list(order_by)
        self.ranges = [r for r, _ in counts]
        self.starts = [0, *accumulate(n for _, n in counts)]

    @classmethod
    def build(cls, df: DataFrame, order_by: Sequence[str], path: str | None = None, range_rows: int = RANGE_ROWS) -> "PageIndex":
        spark = df.sparkSession
        path = path or shared_dir(spark, "page-index")
        parts = max(1, -(-df.count() // range_rows))
        dealt = df.repartitionByRange(parts, *order_by).withColumn("page_range", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("page_range").parquet(path)
        counts = spark.read.schema(_held(df.schema)).parquet(path).groupBy("page_range").agg(F.count(F.lit(1)).alias("n")).orderBy("page_range").collect()
        return cls(spark, path, df.schema, order_by, [(r["page_range"], r["n"]) for r in counts])

    @property
    def rows(self) -> int:
        return self.starts[-1]

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0) of ``size`` rows; fewer on the last page, none behind it."""
        offset = number * size
        if offset >= self.rows or size <= 0:
            return self.spark.createDataFrame([], self.schema)
        first, last = bisect_right(self.starts, offset) - 1, bisect_right(self.starts, offset + size - 1) - 1
        wanted = self.ranges[first:last + 1]
        rows = self.spark.read.schema(_held(self.schema)).parquet(self.path).filter(F.col("page_range").isin(wanted))
        return rows.orderBy(*self.order_by).offset(offset - self.starts[first]).limit(size).drop("page_range")
