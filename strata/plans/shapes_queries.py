"""Registered queries for the generic shapes, on the driver's own tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strata.functions.dates import wall_clock
from strata.operators import shapes as SH
from strata.operators.pages import PageIndex
from strata.plans.oracle_base import with_programme
from strata.plans.registry import AS_OF, Ctx, register
from strata.sources.tables import driver_tables

_REV_SQL = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"


@register("aggregate_by", """
SELECT l_returnflag, l_linestatus,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price,
       CAST(sum(""" + _REV_SQL + """) AS DOUBLE) AS sum_disc_price,
       round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_qty,
       round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_price,
       count(*) AS count_order
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def aggregate_by(spark, sf_dir):
    li = driver_tables(spark, sf_dir)["lineitem"]
    out = SH.aggregate_by(li, ["l_returnflag", "l_linestatus"], {
        "sum_qty": F.sum(SH.money("l_quantity")).cast("double"),
        "sum_base_price": F.sum(SH.money("l_extendedprice")).cast("double"),
        "sum_disc_price": F.sum(SH.revenue()).cast("double"),
        "count_order": F.count(F.lit(1))})
    return out.select("l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price",
                      F.round(F.col("sum_qty") / F.col("count_order"), 6).alias("avg_qty"),
                      F.round(F.col("sum_base_price") / F.col("count_order"), 6).alias("avg_price"),
                      "count_order")


@register("filter_equals", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_equals(spark, sf_dir):
    return SH.filter_equals(driver_tables(spark, sf_dir)["orders"], "o_orderstatus", "F")


@register("top_n", """
SELECT l.l_partkey, p.p_name, l.revenue FROM
  (SELECT l_partkey, CAST(sum(""" + _REV_SQL + """) AS DOUBLE) AS revenue FROM lineitem GROUP BY l_partkey) l
JOIN part p ON l.l_partkey = p.p_partkey
ORDER BY l.revenue DESC, l.l_partkey LIMIT 10""")
def top_n(spark, sf_dir):
    d = driver_tables(spark, sf_dir)
    best = SH.top_n(d["lineitem"], ["l_partkey"], F.sum(SH.revenue()).cast("double"), "revenue", 10)
    return (best.join(d["part"].select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
            .select("l_partkey", "p_name", "revenue"))


@register("top_products_month", """
SELECT l.l_partkey, p.p_name, l.revenue FROM
  (SELECT l_partkey, CAST(sum(""" + _REV_SQL + """) AS DOUBLE) AS revenue FROM lineitem
   WHERE l_shipdate >= TIMESTAMP '2001-08-01 00:00:00' AND l_shipdate < TIMESTAMP '2001-09-01 00:00:00'
   GROUP BY l_partkey) l
JOIN part p ON l.l_partkey = p.p_partkey
ORDER BY l.revenue DESC, l.l_partkey LIMIT 10""")
def top_products_month(spark, sf_dir):
    d = driver_tables(spark, sf_dir)
    start = dt.datetime(AS_OF.year, AS_OF.month, 1)
    end = dt.datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
    month = d["lineitem"].filter((F.col("l_shipdate") >= wall_clock(start)) & (F.col("l_shipdate") < wall_clock(end)))
    best = SH.top_n(month, ["l_partkey"], F.sum(SH.revenue()).cast("double"), "revenue", 10)
    return (best.join(d["part"].select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
            .select("l_partkey", "p_name", "revenue"))


def _revenue_by_nation(d):
    """Revenue per nation: lines pre-aggregated per order (one row per order),
    then per customer, then per nation -- each join meets one row per key."""
    per_order = d["lineitem"].groupBy("l_orderkey").agg(F.sum(SH.revenue()).alias("revenue"))
    per_cust = (per_order.join(d["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
                .groupBy("o_custkey").agg(F.sum("revenue").alias("revenue")))
    return (per_cust.join(d["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
            .groupBy("c_nationkey").agg(F.sum("revenue").alias("revenue")))


@register("top_regions", """
SELECT r.r_regionkey, r.r_name, CAST(sum(""" + _REV_SQL + """) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r.r_regionkey
GROUP BY r.r_regionkey, r.r_name ORDER BY revenue DESC, r.r_regionkey LIMIT 5""")
def top_regions(spark, sf_dir):
    d = driver_tables(spark, sf_dir)
    per_region = (_revenue_by_nation(d)
                  .join(d["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
                  .groupBy("n_regionkey").agg(F.sum("revenue").cast("double").alias("revenue"))
                  .join(d["region"].select(F.col("r_regionkey").alias("n_regionkey"), "r_regionkey", "r_name"),
                        "n_regionkey"))
    return per_region.orderBy(F.desc("revenue"), "r_regionkey").limit(5).select("r_regionkey", "r_name", "revenue")


@register("compare_regions", """
SELECT r.r_regionkey, r.r_name, count(*) AS orders, count(DISTINCT o_custkey) AS customers,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
       round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_order_value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region r ON n_regionkey = r.r_regionkey GROUP BY r.r_regionkey, r.r_name""")
def compare_regions(spark, sf_dir):
    d = driver_tables(spark, sf_dir)
    per_cust = d["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"),
                                                    F.sum(SH.money("o_totalprice")).alias("value"))
    per_region = (per_cust.join(d["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
                  .join(d["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
                  .groupBy("n_regionkey")
                  .agg(F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("customers"),
                       F.sum("value").cast("double").alias("total_value"))
                  .join(d["region"].select(F.col("r_regionkey").alias("n_regionkey"), "r_regionkey", "r_name"),
                        "n_regionkey"))
    return per_region.select("r_regionkey", "r_name", "orders", "customers", "total_value",
                             F.round(F.col("total_value") / F.col("orders"), 6).alias("avg_order_value"))


@register("growth_over_time", """
, m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value, count(*) AS row_count
        FROM orders GROUP BY 1)
SELECT month, total_value, row_count,
       round((total_value - max(total_value) OVER w) * 100 / max(total_value) OVER w, 6) AS mom_pct
FROM m WINDOW w AS (ORDER BY year(month) * 12 + month(month) - 1 RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"""
          .replace(", m AS", "WITH m AS", 1))
def growth_over_time(spark, sf_dir):
    o = driver_tables(spark, sf_dir)["orders"]
    return SH.growth_over_time(o, "o_orderdate", F.sum(SH.money("o_totalprice")).cast("double"))


@register("combine_tables", """
SELECT o_orderkey, o_custkey, c_name, c_mktsegment, o_totalprice, o_orderdate
FROM orders JOIN customer ON o_custkey = c_custkey""")
def combine_tables(spark, sf_dir):
    d = driver_tables(spark, sf_dir)
    cust = d["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return (SH.combine_tables(d["orders"], cust, "o_custkey")
            .select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "o_totalprice", "o_orderdate"))


@register("distribution", """
SELECT c_mktsegment, count(*) AS row_count, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS share_pct
FROM customer GROUP BY c_mktsegment""")
def distribution(spark, sf_dir):
    return SH.distribution(driver_tables(spark, sf_dir)["customer"], "c_mktsegment")


_STATS_COLS = ("l_quantity", "l_extendedprice", "l_discount")
# a column with far more than two decimals
_FINE, _FINE_SQL = "unit_share", "CAST(l_discount AS DOUBLE) / (1000 + CAST(l_partkey AS DOUBLE))"
_STATS_NAMES = {_FINE_SQL: _FINE}


def _stats_sql(c):
    x = f"CAST({c} AS DOUBLE)" if " " not in c else c

    def nine_digits(y):
        return f"round({y} * pow(10.0, 8 - floor(log10(abs({y}))))) / pow(10.0, 8 - floor(log10(abs({y}))))"

    return (f"SELECT '{_STATS_NAMES.get(c, c)}' AS column_name, count({x}) AS count, min({x}) AS min_value, max({x}) AS max_value, "
            f"{nine_digits(f'avg({x})')} AS mean, {nine_digits(f'stddev_samp({x})')} AS stddev FROM lineitem")


@register("summary_stats", "\nUNION ALL\n".join(_stats_sql(c) for c in (*_STATS_COLS, _FINE_SQL)))
def summary_stats(spark, sf_dir):
    li = driver_tables(spark, sf_dir)["lineitem"]
    fine = F.col("l_discount").cast("double") / (F.lit(1000) + F.col("l_partkey").cast("double"))
    return SH.summary_stats(li.withColumn(_FINE, fine), (*_STATS_COLS, _FINE))


@register("summary_percentiles", "\nUNION ALL\n".join(
    f"SELECT '{_STATS_NAMES.get(c, c)}' AS column_name, quantile_disc(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_disc(CAST({c} AS DOUBLE), 0.5) AS p50, "
    f"quantile_disc(CAST({c} AS DOUBLE), 0.75) AS p75 FROM lineitem" for c in (*_STATS_COLS, _FINE_SQL)))
def summary_percentiles(spark, sf_dir):
    """The quartiles of the summary, exact, without sorting the columns."""
    li = driver_tables(spark, sf_dir)["lineitem"]
    fine = F.col("l_discount").cast("double") / (F.lit(1000) + F.col("l_partkey").cast("double"))
    return SH.percentile_columns(li.withColumn(_FINE, fine), (*_STATS_COLS, _FINE))


@register("distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(spark, sf_dir):
    return SH.distinct_values(driver_tables(spark, sf_dir)["events"], "event_type")


@register("sessions_page", with_programme("SELECT * FROM s_session ORDER BY session_id LIMIT 50 OFFSET 150"))
def sessions_page(spark, sf_dir):
    return SH.paginate(Ctx(spark, sf_dir).scoped.sessions, ["session_id"], page=3, size=50)


@register("sessions_page_after", with_programme("""
SELECT * FROM s_session WHERE session_date > DATE '1995-06-17' OR (session_date = DATE '1995-06-17' AND session_id > 100)
ORDER BY session_date, session_id LIMIT 50"""))
def sessions_page_after(spark, sf_dir):
    """A keyset page by session date, which many sessions share."""
    return SH.page_after(Ctx(spark, sf_dir).scoped.sessions, ["session_date", "session_id"], [dt.date(1995, 6, 17), 100], 50)


@register("sessions_page_deep", with_programme("SELECT * FROM s_session ORDER BY session_date, session_id LIMIT 50 OFFSET 10000"))
def sessions_page_deep(spark, sf_dir):
    """Page 200 through an index of ranges: only the range that holds it is read and sorted."""
    index = PageIndex.build(Ctx(spark, sf_dir).scoped.sessions, ["session_date", "session_id"], range_rows=4096)
    return index.page(200, 50)


@register("sample_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def sample_rows(spark, sf_dir):
    """The sampling operator: first rows in key order (limit is the feature)."""
    from strata.sources.catalog import sample_rows as run

    return run(driver_tables(spark, sf_dir)["orders"], ["o_orderkey"], 5)
