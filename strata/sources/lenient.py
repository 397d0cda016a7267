"""Loading tables whose values or lines may be broken: good rows load, bad ones are kept apart and counted."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strata.schemas import ALIASES, DIMENSIONS, FACTS, KEYS, LAYOUT_COLUMNS, SCHEMAS, conform, empty
from strata.sources.tables import Tables

CORRUPT = "_corrupt_record"
QUARANTINE = "problems array<string>, row string"
TEXT_FORMATS = ("csv", "json")


def _value(c: Column, kind: T.DataType) -> Column:
    """The column in its declared type, NULL where it cannot be read as that (in text, blanks around it do not
    count, and dates may carry a time)."""
    text = F.trim(c.cast("string"))
    if isinstance(kind, T.StringType):
        return c.cast("string")
    if isinstance(kind, T.DateType):
        return F.coalesce(text.try_cast("date"), text.try_cast("timestamp_ntz").cast("date"))
    if isinstance(kind, T.IntegralType):  # "7.0" is a whole number, "7.5" is not
        number = text.try_cast("decimal(38,6)")
        return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))
    return text.try_cast(kind)


def split_rows(raw: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(good rows in the fixed schema of ``table``, bad rows as ``QUARANTINE``).

    A row is bad if its line could not be parsed, if a value cannot be read in its declared type, or if a
    dimension's key is missing.  The quarantine names the columns at fault and keeps the row as JSON.  Both
    sides are plans over the same scan; nothing runs here.
    """
    present = set(raw.columns)
    sources = {dst: src for src, dst in ALIASES.get(table, {}).items() if src in present and dst not in present}
    fields, problems = [], []
    for field in SCHEMAS[table].fields:
        name = sources.get(field.name, field.name)
        if name not in present:
            fields.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value = _value(F.col(name), field.dataType)
        given = F.col(name).isNotNull() & (F.trim(F.col(name).cast("string")) != "")
        wrong = given & value.isNull()
        if field.name == KEYS.get(table):
            wrong = wrong | ~F.coalesce(given, F.lit(False))
        fields.append(F.when(given, value).alias(field.name))
        problems.append(F.when(wrong, F.lit(name)))
    if CORRUPT in present:
        problems.insert(0, F.when(F.col(CORRUPT).isNotNull(), F.lit(CORRUPT)))
    found = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    held = [F.col(c) for c in LAYOUT_COLUMNS.get(table, ()) if c in present]
    row = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[c for c in raw.columns if c != CORRUPT]))) if CORRUPT in present else F.to_json(F.struct(*raw.columns))
    judged = raw.select(found.alias("problems"), row.alias("row"), F.struct(*fields, *held).alias("good"))
    good = judged.filter(F.size("problems") == 0).select("good.*")
    return good, judged.filter(F.size("problems") > 0).select("problems", "row")


def _read(spark: SparkSession, path: str, fmt: str, options: dict) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if fmt not in TEXT_FORMATS:
        return reader.load(path)
    if fmt == "csv":
        reader = reader.option("header", True)
    # as text, so that no value is lost to a type before it has been looked at
    names = reader.option("primitivesAsString", True).load(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*[n for n in names if n != CORRUPT], CORRUPT)])
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).load(path)


def load_lenient(spark: SparkSession, location: str, fmt: str = "csv", names: tuple[str, ...] = DIMENSIONS + FACTS, options: dict | None = None) -> tuple[Tables, dict[str, DataFrame]]:
    """``load_tables`` over a folder, row by row forgiving: (tables, bad rows of each table).  A table that is
    not there becomes a typed empty one, as in ``load_tables``."""
    frames, missing, errors, bad = {}, set(), {}, {}
    for name in names:
        try:
            try:
                raw = _read(spark, os.path.join(location, f"{name}.{fmt}"), fmt, options or {})
            except AnalysisException:
                raw = _read(spark, os.path.join(location, name), fmt, options or {})
            good, bad[name] = split_rows(raw, name)
            frames[name] = conform(good, name, keep_layout=True)
        except AnalysisException as exc:
            frames[name] = empty(spark, name)
            bad[name] = spark.createDataFrame([], QUARANTINE)
            missing.add(name)
            errors[name] = str(exc)
    return Tables(frames, missing, errors), bad


def quarantine_report(bad: dict[str, DataFrame]) -> DataFrame:
    """(table_name, problem, bad_rows): how many rows each fault keeps out; a row with two faults counts under
    both."""
    parts = [df.select(F.lit(name).alias("table_name"), F.explode("problems").alias("problem")) for name, df in bad.items()]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out.groupBy("table_name", "problem").agg(F.count(F.lit(1)).alias("bad_rows"))
