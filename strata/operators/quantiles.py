"""Exact quantiles in two passes, without sorting the column.

The first pass builds a mergeable summary (``percentile_approx``, whose rank error is bounded), which brackets
each quantile by two values.  The second counts, per column, the rows between the brackets as totals and those
inside by value, so only about ``6 / ACCURACY`` of the rows (or a few distinct values) are told apart; a histogram
over them says in which bin the quantile's rank falls, and only that bin's values are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.session import shared_dir

ACCURACY = 10_000
BINS = 4096


def brackets(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, tuple[int, list[tuple[float, float]]]]:
    """Per column: rows with a value, and for each share two values between which its quantile lies.  One
    aggregation; one row comes back."""
    slack = 2 / ACCURACY
    at = [p for q in shares for p in (max(q - slack, 0.0), min(q + slack, 1.0))]
    aggs = []
    for k, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{k}"), F.min(x).alias(f"min{k}"), F.max(x).alias(f"max{k}"), F.percentile_approx(x, [float(p) for p in at], ACCURACY).alias(f"p{k}")]
    row, out = df.agg(*aggs).first(), {}
    for k, c in enumerate(columns):
        found = row[f"p{k}"] or []
        pairs = []
        for i in range(0, len(found), 2):
            low = row[f"min{k}"] if at[i] == 0 else found[i]
            high = row[f"max{k}"] if at[i + 1] == 1 else found[i + 1]
            pairs.append((low, high))
        out[c] = (row[f"n{k}"], pairs)
    return out


def _after(a: float, b: float) -> bool:
    """a > b, with NaN above all numbers, as Spark orders them."""
    return not math.isnan(b) and (math.isnan(a) or a > b)


def _disjoint(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(pairs, key=lambda p: (math.isnan(p[0]), p[0])):
        if out and not _after(low, out[-1][1]):
            out[-1] = (out[-1][0], high if _after(high, out[-1][1]) else out[-1][1])
        else:
            out.append((low, high))
    return out


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column_name, share, value): the least value that at least ``share`` of the column's non-null rows do not
    exceed.  NaN sorts last.  A column without values has NULL quantiles."""
    spark = df.sparkSession
    known = brackets(df, columns, shares)
    zones = {c: _disjoint(pairs) for c, (_, pairs) in known.items()}

    def cell(k: int, c: str) -> Column:
        """A row's zone in column k: odd ones are brackets, whose values are kept, even ones lie between."""
        x, zone, kept = F.col(c).cast("double"), F.lit(2 * len(zones[c])), F.lit(None).cast("double")
        for i, (low, high) in reversed(list(enumerate(zones[c]))):
            inside = x <= F.lit(high)
            zone = F.when(x < F.lit(low), 2 * i).when(inside, 2 * i + 1).otherwise(zone)
            kept = F.when(x < F.lit(low), F.lit(None)).when(inside, x).otherwise(kept)
        # -0.0 and 0.0 are one value
        return F.when(x.isNotNull(), F.struct(F.lit(k).alias("k"), zone.alias("zone"), (kept + F.lit(0.0)).alias("value")))

    cells = df.select(F.explode(F.array(*[cell(k, c) for k, c in enumerate(columns)])).alias("c")).filter("c is not null").select("c.*")
    path = shared_dir(spark, "quantile-cells")
    cells.groupBy("k", "zone", "value").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = spark.read.schema("k int, zone int, value double, n bigint").parquet(path)
    # bins cut each bracket evenly; a value that has no place in it (infinite, NaN) goes to the last one
    spans = [(k, 2 * i + 1, float(low), float(high)) for k, c in enumerate(columns) for i, (low, high) in enumerate(zones[c])]
    wanted = [(k, float(q), max(1, math.ceil(Fraction(str(q)) * known[c][0]))) for k, c in enumerate(columns) for q in shares if known[c][0]]
    names = spark.createDataFrame([(k, c, float(q)) for k, c in enumerate(columns) for q in shares], "k int, column_name string, share double")
    span = spark.createDataFrame(spans, "k int, zone int, low double, high double")
    place = (F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * BINS
    bin_ = F.when(F.col("value").isNull() | (F.col("high") == F.col("low")), 0).when(F.isnan(place) | (F.abs(place) == float("inf")) | (place >= BINS), F.when(F.col("value") == F.col("low"), 0).otherwise(BINS)).otherwise(F.floor(place))
    binned = counts.join(F.broadcast(span), ["k", "zone"], "left").withColumn("bin", F.coalesce(bin_, F.lit(0)).cast("int"))
    totals = binned.groupBy("k", "zone", "bin").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("k").orderBy("zone", "bin")  # at most BINS rows per bracket
    ranked = totals.withColumn("upto", F.sum("n").over(along)).withColumn("before", F.col("upto") - F.col("n"))
    ranks = spark.createDataFrame(wanted, "k int, share double, rank bigint")
    hit = ranked.join(F.broadcast(ranks), "k").filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select("k", "share", "rank", "zone", "bin", "before")
    inside = Window.partitionBy("k", "share").orderBy("value")
    values = (binned.select("k", "zone", "bin", "value", "n").join(F.broadcast(hit), ["k", "zone", "bin"])
              .withColumn("upto", F.col("before") + F.sum("n").over(inside)).filter(F.col("upto") >= F.col("rank"))
              .groupBy("k", "share").agg(F.min("value").alias("value")))
    return names.join(values, ["k", "share"], "left").select("column_name", "share", "value")


def percentile_columns(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``quantiles`` with a column per share: column_name, p25, p50, p75."""
    found = quantiles(df, columns, shares)
    picks = [F.max(F.when(F.col("share") == float(q), F.col("value"))).alias(f"p{format(q * 100, 'g').replace('.', '_')}") for q in shares]
    return found.groupBy("column_name").agg(*picks)
