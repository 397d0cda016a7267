"""Every registered query against its DuckDB oracle at sf0.001 (the driver's
gate runs the same comparison at sf0.01)."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as E
from strata.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["week", "unique_attendees", "total_attendances", "attendance_rate"]


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF)
    res = con.sql(E.oracle_sql()[key])
    assert sorted(sdf.columns) == sorted(res.columns)
    spark_types = {f.name: DUCK_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    assert spark_types == dict(zip(res.columns, [str(t) for t in res.types]))
    assert canon(sdf.columns, [tuple(r) for r in sdf.collect()]) == canon(res.columns, res.fetchall())
