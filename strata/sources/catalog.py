"""Catalog jobs: list, describe, profile, check access, count, sample, create
namespace.  Loops here run over table *names* only; every data step is a
Spark job, and only small per-table results reach the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def list_tables(spark: SparkSession, namespace: str | None = None) -> DataFrame:
    """``SHOW TABLES [IN namespace]``: columns namespace, tableName, isTemporary."""
    return spark.sql(f"SHOW TABLES IN {namespace}" if namespace else "SHOW TABLES")


def list_tables_preview(tables: DataFrame, n: int = 15) -> DataFrame:
    """One line: the first ``n`` table names (sorted), then "... and N more".
    The list is catalog metadata, bounded by the number of tables."""
    names = F.sort_array(F.collect_list("tableName"))
    total = F.size(names)
    head = F.array_join(F.slice(names, 1, n), ", ")
    text = F.when(total > n, F.concat(head, F.lit(" ... and "), (total - n).cast("string"), F.lit(" more")))\
        .otherwise(head)
    return tables.agg(total.alias("table_count"), text.alias("preview"))


def describe_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """One row per column of each table: ``table_name, position, column_name,
    data_type``.  ``DESCRIBE TABLE`` per table (a catalog command), minus the
    partition/metadata section (empty names or names starting with '#').
    A table that cannot be described gives one row with its error."""
    parts = []
    for name in names:
        try:
            desc = spark.sql(f"DESCRIBE TABLE {name}")
        except AnalysisException as exc:
            err = str(exc)
            parts.append(spark.createDataFrame(
                [(name, 0, None, None, err)],
                "table_name string, position long, column_name string, data_type string, error string"))
            continue
        rows = (desc.withColumn("position", F.monotonically_increasing_id())
                .filter((F.col("col_name") != "") & ~F.col("col_name").startswith("#"))
                .select(F.lit(name).alias("table_name"), "position", F.col("col_name").alias("column_name"),
                        "data_type", F.lit(None).cast("string").alias("error")))
        parts.append(rows)
    # position: increasing in DESCRIBE's row order (partition id in the high bits)
    return reduce(lambda a, b: a.unionByName(b), parts)


def describe_frames(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """``describe_tables`` for DataFrames, from their schemas; no view is made."""
    rows = [(name, k, f.name, f.dataType.simpleString(), None)
            for name, df in frames.items() for k, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position long, column_name string, data_type string, error string")


def schema_context(described: DataFrame, max_tables: int | None = None, max_columns: int | None = None,
                   suffix: bool = True) -> DataFrame:
    """One line per table, ``table(col:type, ...)``.  Caps are for display and
    off by default: ``max_columns`` columns then `` ... (N total)`` (unless
    ``suffix`` is off); ``max_tables`` tables by name, then a line
    ``... and N more``.  The reference's variants are 15 x 12 with
    the suffix, no caps, 20 x 15 without it, and 10 x 10 with it.  Per-table
    lists are bounded by the schema width, not by data."""
    entries = F.sort_array(F.collect_list(F.struct("position", F.concat_ws(":", "column_name", "data_type")
                                                                  .alias("text"))))
    per_table = described.groupBy("table_name").agg(
        entries.alias("cols"), F.count("column_name").alias("n"), F.max("error").alias("error"))
    shown = F.col("cols.text") if max_columns is None else F.slice(F.col("cols.text"), 1, max_columns)
    text = F.array_join(shown, ", ")
    if max_columns is not None and suffix:
        text = F.when(F.col("n") > max_columns,
                      F.concat(text, F.lit(" ... ("), F.col("n").cast("string"), F.lit(" total)"))).otherwise(text)
    failed = F.concat(F.col("table_name"), F.lit("(error: "), F.col("error"), F.lit(")"))
    described = F.concat(F.col("table_name"), F.lit("("), text, F.lit(")"))
    line = F.when(F.col("error").isNotNull(), failed).otherwise(described)
    out = per_table.select("table_name", F.col("n").alias("column_count"), line.alias("context_line"))
    if max_tables is None:
        return out
    more = (per_table.agg((F.count(F.lit(1)) - max_tables).alias("more")).where("more > 0")
            .select(F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("long").alias("column_count"),
                    F.concat(F.lit("... and "), F.col("more").cast("string"), F.lit(" more")).alias("context_line")))
    return out.orderBy("table_name").limit(max_tables).unionByName(more)


def table_row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, stacked: ``table_name, row_count``."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def profile_tables(frames: dict[str, DataFrame], sample: int = 3, key: dict[str, str] | None = None) -> dict:
    """Per table: column list, row count, facts of each column (``profile_columns``) and a few sample rows in key
    order (small driver-side dict for display).  Counts and column facts come from one pass per table."""
    out = {}
    for name, df in frames.items():
        order = (key or {}).get(name) or df.columns[0]
        facts = [r.asDict(recursive=True) for r in profile_columns(df).collect()]
        out[name] = {"columns": [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                     "row_count": facts[0]["row_count"] if facts else df.count(), "column_facts": facts,
                     "sample": [r.asDict() for r in sample_rows(df, [order], sample).collect()]}
    return out


EPOCH = "1970-01-01 00:00:00"
TRACKED = 10_000  # distinct values that the sketch of frequent ones keeps per column


def _measured(field: T.StructField) -> tuple[str, str] | None:
    """(SQL of a column's values as number or text, ``number`` or ``text``), None for types without an order
    that a profile could show."""
    name, kind = "`" + field.name.replace("`", "``") + "`", field.dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return f"CAST({name} AS DOUBLE)", "number"
    if isinstance(kind, T.DateType):
        return f"unix_date({name}) * 86400D", "number"
    if isinstance(kind, T.TimestampNTZType):  # wall-clock time, whatever the session's zone
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{EPOCH}', {name}) / 1e6D", "number"
    if isinstance(kind, T.TimestampType):
        return f"unix_micros({name}) / 1e6D", "number"
    return (name, "text") if isinstance(kind, T.StringType) else None


def profile_columns(df: DataFrame, top: int = 3) -> DataFrame:
    """One row per column, from one aggregation over the table: ``column_name, data_type, row_count, null_count,
    null_share, approx_distinct`` (HyperLogLog, 2 % standard error), least and greatest value (``min_number`` /
    ``max_number`` for numbers, booleans, and dates and times as seconds since 1970; ``min_text`` /
    ``max_text`` for strings) and ``frequent``, the most frequent values with their estimated counts (a
    sketch of at most ``TRACKED`` values per column).  Columns of other types (arrays, structs, binary) only have
    their counts.  Every state is bounded and merges, however large the table."""
    aggs, rows = [F.count(F.lit(1)).alias("rows")], []
    for k, field in enumerate(df.schema.fields):
        name, how = "`" + field.name.replace("`", "``") + "`", _measured(field)
        aggs.append(F.expr(f"count({name})").alias(f"n{k}"))
        if how:
            aggs += [F.expr(f"approx_count_distinct({name}, 0.02)").alias(f"d{k}"), F.expr(f"min({how[0]})").alias(f"lo{k}"), F.expr(f"max({how[0]})").alias(f"hi{k}"),
                     F.expr(f"approx_top_k(CAST({name} AS STRING), {top}, {TRACKED})").alias(f"t{k}")]

        def found(col: str, kind: str, side: str | None = None) -> Column:
            known = how and side in (None, how[1])
            return (F.col(f"{col}{k}") if known else F.lit(None)).cast(kind)

        rows.append(F.struct(
            F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("data_type"), F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"n{k}")).alias("null_count"), found("d", "bigint").alias("approx_distinct"),
            found("lo", "double", "number").alias("min_number"), found("hi", "double", "number").alias("max_number"),
            found("lo", "string", "text").alias("min_text"), found("hi", "string", "text").alias("max_text"),
            found("t", "array<struct<value:string,count:bigint>>").alias("frequent")))
    long = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    share = F.round(F.try_divide(F.col("null_count").cast("double"), F.col("row_count")), 6)
    return long.withColumn("null_share", share).select("column_name", "data_type", "row_count", "null_count", "null_share", "approx_distinct",
                                                       "min_number", "max_number", "min_text", "max_text", "frequent")


def accessible_tables(spark: SparkSession, names: list[str], counts: bool = False) -> DataFrame:
    """Which tables can be read: ``table_name, accessible, error``, with ``counts`` also ``row_count``.  One
    row of each is read, so a table whose files are gone or broken does not pass; a count reads no column."""
    rows = []
    for name in names:
        try:
            df = spark.table(name)
            df.take(1)
            rows.append((name, True, None, df.count() if counts else None))
        except Exception as exc:  # not resolved, refused or not readable
            rows.append((name, False, str(exc), None))
    schema = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("accessible", T.BooleanType()),
                           T.StructField("error", T.StringType()), T.StructField("row_count", T.LongType())])
    found = spark.createDataFrame(rows, schema)
    return found if counts else found.drop("row_count")


def ensure_schema(spark: SparkSession, namespace: str) -> None:
    """``CREATE SCHEMA IF NOT EXISTS``.  Catalogs are configured through
    ``spark.sql.catalog.*``; open-source Spark has no CREATE CATALOG."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {namespace}")


def sample_rows(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """First ``n`` rows in key order (deterministic sample)."""
    return df.orderBy(*order_by).limit(n)
