"""Physical layout for recurring dashboards: the programme tables written once
as parquet, facts partitioned by session month.

Attendance carries its session's month, so a trailing-window query reads only
the months it needs (partition pruning on a constant) instead of the whole
attendance history.  Writing is one job per table (the attendance-session join
runs once, here, not in every query); the committer makes each write atomic.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from strata.operators.scope import MONTH_COLUMN
from strata.sources.tables import Tables

PARTITION_COLUMN = MONTH_COLUMN
PARTITIONED = ("session", "attendance")


def _by_month(df):
    """Spread each month over as many tasks as its size asks for: a rebalance by
    month, whose partitions AQE splits (a hot month, or a hot session in it)
    and joins to the advisory size.  A month ends in files of that size."""
    return df.hint("rebalance", F.col(PARTITION_COLUMN))


def with_session_month(tables: Tables, name: str):
    """``session`` or ``attendance`` with the month of the session."""
    month = F.trunc("session_date", "month").alias(PARTITION_COLUMN)
    if name == "session":
        return tables["session"].select("*", month)
    df = tables["attendance"]
    months = tables["session"].select("session_id", month)
    return df.join(months.hint("shuffle_hash"), "session_id", "left").select(*df.columns, PARTITION_COLUMN)


def write_program_tables(tables: Tables, root: str, mode: str = "overwrite") -> None:
    """The default layout: good for skewed data, since later joins shuffle and
    AQE can split them."""
    for name, df in tables.frames.items():
        path = os.path.join(root, name)
        if name in PARTITIONED:
            _by_month(with_session_month(tables, name)).write.mode(mode).partitionBy(PARTITION_COLUMN).parquet(path)
        else:
            df.write.mode(mode).parquet(path)


def save_program_tables(spark, tables: Tables, database: str, root: str, buckets: int, mode: str = "overwrite") -> None:
    """Catalog tables for a recurring dashboard: session and attendance bucketed
    by ``session_id`` into the same number of buckets (and attendance also
    partitioned by session month), so the largest join reads co-located
    buckets without a shuffle; other tables plain.  Data sits at
    ``root/<name>`` (a shared folder), registered as ``database.<name>``.

    ``buckets`` is the parallelism of that join, which nothing splits later:
    choose about (bytes of the largest month) / 256 MB, at least the cluster's
    cores; with a session that holds a large part of the rows, use
    ``write_program_tables`` instead.  The rows are shuffled by bucket first, so
    a bucket of a month is one file, not one per task."""
    from strata.sources.catalog import ensure_schema

    ensure_schema(spark, database)
    for name, df in tables.frames.items():
        if name in PARTITIONED:
            # the writer's buckets use the same hash as a shuffle by the column
            df = with_session_month(tables, name).repartition(buckets, "session_id")
        writer = df.write.mode(mode).format("parquet").option("path", os.path.join(root, name))
        if name in PARTITIONED:
            writer = writer.partitionBy(PARTITION_COLUMN).bucketBy(buckets, "session_id").sortBy("session_id")
        writer.saveAsTable(f"{database}.{name}")
