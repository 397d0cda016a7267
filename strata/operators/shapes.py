"""Generic query shapes the agent advertises: aggregate by group, filter on
equality, top-n, distribution, summary statistics, distinct values, growth
over time, combining tables, pagination.  Each is a thin composition of
built-in DataFrame operators that Catalyst plans as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.functions.dates import month_index
from strata.operators.quantiles import percentile_columns


def money(col: str | Column, scale: int = 2) -> Column:
    """Exact decimal form of a money column (sums then do not depend on order)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(f"decimal(18,{scale})")


def revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return money(price) * (F.lit(1) - money(discount))


def aggregate_by(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """``groupBy(keys).agg(measures)``: partial aggregation runs map-side, so a
    hot key costs one row per task before the shuffle."""
    return df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in measures.items()])


def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    """Rows where ``column = value`` (pushed to the scan as a parquet filter)."""
    return df.filter(F.col(column) == F.lit(value))


def top_n(df: DataFrame, keys: Sequence[str], measure: Column, name: str, n: int,
          ascending: bool = False) -> DataFrame:
    """Top ``n`` groups by ``measure``, ties broken by the keys (total order).
    Planned as TakeOrderedAndProject: each task keeps its own n best."""
    order = F.asc(name) if ascending else F.desc(name)
    return df.groupBy(*keys).agg(measure.alias(name)).orderBy(order, *keys).limit(n)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per category and share of all rows.  The total is a scalar subquery over per-category
    counts, so a column of any cardinality stays spread over all tasks."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    total = counts.agg(F.sum("row_count")).scalar()
    return counts.withColumn("share_pct", F.round(F.col("row_count") * 100.0 / total, 6))


def summary_stats(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = ()) -> DataFrame:
    """count / min / max / mean / sample stddev per numeric column, one row per
    column.  One aggregation pass for all columns, then ``stack`` to long form.
    Mean and stddev are Spark's own (running moments, no cancellation, any
    scale), rounded to 9 significant digits, where row order stops mattering.
    ``shares`` adds exact quantiles (``p25`` for 0.25), in two more passes."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"{c}__n"), F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max"), F.avg(x).alias(f"{c}__m"),
                 F.stddev_samp(x).alias(f"{c}__sd")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', `{c}__n`, `{c}__min`, `{c}__max`, `{c}__m`, `{c}__sd`" for c in columns)
    long = wide.selectExpr(f"stack({len(columns)}, {parts}) AS (column_name, n, min_value, max_value, m, sd)")

    def settled(col: str) -> Column:
        x = F.col(col)
        unit = F.pow(F.lit(10.0), 8 - F.floor(F.log10(F.abs(x))))
        return F.when(x == 0, x).otherwise(F.coalesce(F.round(x * unit) / unit, x))

    out = long.select("column_name", F.col("n").alias("count"), "min_value", "max_value",
                      settled("m").alias("mean"), settled("sd").alias("stddev"))
    if not shares:
        return out
    return out.join(percentile_columns(df, columns, shares), "column_name")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def combine_tables(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    return left.join(right, on, how)


def growth_over_time(df: DataFrame, date_col: str, value: Column, name: str = "total_value") -> DataFrame:
    """Per month: total, row count and change vs the month before (%).  The
    window runs over the per-month aggregate; a RANGE frame on the month index
    finds exactly the previous month (NULL when that month has no rows)."""
    per_month = (df.groupBy(F.trunc(date_col, "month").alias("month"))
                 .agg(value.alias(name), F.count(F.lit(1)).alias("row_count"))
                 .withColumn("midx", month_index("month")))
    prev = F.max(name).over(Window.orderBy("midx").rangeBetween(-1, -1))
    return per_month.select("month", name, "row_count",
                            F.round(F.try_divide((F.col(name) - prev) * 100, prev), 6).alias("mom_pct"))


def paginate(df: DataFrame, order_by: Sequence[str], page: int, size: int) -> DataFrame:
    """Page ``page`` (0-based) of ``size`` rows in a total order."""
    return df.orderBy(*order_by).offset(page * size).limit(size)


def page_after(df: DataFrame, keys: str | Sequence[str], last: Sequence | object | None, size: int) -> DataFrame:
    """Keyset page: the ``size`` rows after the key values ``last`` in the order
    of ``keys``.  For deep pages this avoids sorting past every earlier row: the
    filter prunes, then a top-k.  ``keys`` together must be unique and not NULL
    (end them with an id), else rows that tie across a page end would be lost:
    pass every key column, not only the one to sort by first."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if last is None:
        return df.orderBy(*keys).limit(size)
    last = [last] if not isinstance(last, (list, tuple)) else list(last)
    if len(last) != len(keys):
        raise ValueError(f"{len(keys)} key columns need as many last values, got {len(last)}")
    after, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, last):
        after = after | (same & (F.col(key) > F.lit(value)))
        same = same & (F.col(key) == F.lit(value))
    # the first key alone, stated on its own, can be pushed to the scan
    return df.filter((F.col(keys[0]) >= F.lit(last[0])) & after).orderBy(*keys).limit(size)
