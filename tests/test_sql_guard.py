"""What the guard lets through, and what it refuses before anything runs."""

import pytest
from pyspark.sql import functions as F

from strata.operators.sqljobs import guarded_sql


@pytest.fixture(scope="module")
def nums(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("k"), F.concat(F.lit("v"), "id").alias("s"))
    df.createOrReplaceTempView("guard_nums")
    yield df
    spark.catalog.dropTempView("guard_nums")


def probe(spark):
    return spark._jvm.java.lang.System.getProperty("strata.probe")


CALL = "java_method('java.lang.System', 'setProperty', 'strata.probe', 'written')"


@pytest.mark.parametrize("text", [
    f"SELECT {CALL}",
    f"SELECT * FROM guard_nums WHERE s = {CALL.replace('java_method', 'reflect')}",
    f"SELECT {CALL.replace('java_method', 'TRY_REFLECT')}",
    f"WITH t AS (SELECT {CALL} AS x) SELECT 1 FROM t",
    f"SELECT id FROM guard_nums WHERE s IN (SELECT {CALL})",
    f"SELECT id FROM guard_nums LIMIT length({CALL})",
    f"SELECT id FROM guard_nums OFFSET length({CALL})",
    f"SELECT * FROM range(length({CALL}))",
    f"SELECT sum(id) OVER w FROM guard_nums WINDOW w AS (ORDER BY {CALL})",
    f"SELECT x FROM guard_nums LATERAL VIEW explode(array({CALL})) t AS x",
    f"SELECT * FROM IDENTIFIER({CALL})",
    f"SELECT `java_method`('java.lang.System', 'setProperty', 'strata.probe', 'written')",
    f"SELECT 1 UNION ALL SELECT length({CALL})",
    f"FROM guard_nums |> SELECT {CALL}",
    f"VALUES ({CALL})",
    f"SELECT max(id) FROM guard_nums GROUP BY {CALL}",
])
def test_calls_into_the_jvm_do_not_run(spark, nums, text):
    spark._jvm.java.lang.System.clearProperty("strata.probe")
    got = guarded_sql(spark, text, eager=True)
    assert not got.ok and got.df.columns == ["error", "sql"] and got.truncated is None
    assert probe(spark) is None


@pytest.mark.parametrize("text,said", [
    ("SELECT TRANSFORM(id) USING 'cat' AS (x) FROM guard_nums", "ScriptTransformation"),
    ("SELECT * FROM text.`/etc/hostname`", "not a table of the catalog"),
    ("SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "not a table of the catalog"),
    ("SELECT * FROM (SELECT * FROM json.`/tmp`) a JOIN guard_nums b ON true", "not a table of the catalog"),
    ("SELECT system.builtin.upper('a')", "not allowed"),
    ("SELECT no_such_function(1)", "not allowed"),
    ("DROP VIEW guard_nums", "single query"),
    ("SELECT 1; SELECT 2", "single query"),
    ("SELECT 1) UNION (SELECT 2); DROP VIEW guard_nums --", "single query"),
    ("FROM guard_nums INSERT INTO other SELECT id", "single query"),
    ("SET spark.sql.ansi.enabled=false", "single query"),
])
def test_other_statements_are_refused(spark, nums, text, said):
    got = guarded_sql(spark, text)
    assert not got.ok and said in got.error
    assert spark.table("guard_nums").count() == 500


def test_user_functions_are_refused_under_any_name(spark, nums):
    ran = spark.sparkContext.accumulator(0)

    def count(x):
        ran.add(1)
        return x

    own = spark.newSession()  # its functions stay its own
    own.range(5).select(F.col("id").cast("string").alias("s")).createOrReplaceTempView("few")
    for name in ("guard_udf", "soundex"):  # the second hides a built-in function
        own.udf.register(name, count)
        assert own.sql(f"SELECT {name}(s) FROM few").columns
        assert not guarded_sql(own, f"SELECT {name}(s) FROM few", eager=True).ok
    assert ran.value == 0


@pytest.mark.parametrize("text,rows", [
    ("SELECT '{x}' AS a, \"{nums}\" AS b -- {nums}\n", [("{x}", "{nums}")]),
    ("SELECT count(*) AS n FROM {nums} /* {nums} ' */ WHERE s <> '{nums}'", [(500,)]),
    ("SELECT k, count(*) AS n FROM {nums} GROUP BY k HAVING k < 2 ORDER BY k", [(0, 72), (1, 72)]),
    ("WITH t AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY id DESC) AS r, id FROM {nums}) SELECT id FROM t WHERE r = 1 AND k = 3", [(493,)]),
    ("SELECT * FROM range(2) UNION ALL SELECT max(id) FROM {nums} ORDER BY 1", [(0,), (1,), (499,)]),
    ("SELECT x FROM (SELECT array(1, 2) AS a) LATERAL VIEW explode(transform(a, v -> v * 10)) t AS x", [(10,), (20,)]),
    ("SELECT named_struct('a', 1).a AS a, map('k', 2)['k'] AS b, cast('3' AS int) AS c, date '2020-01-31' + interval 1 month AS d", None),
    ("SELECT * FROM (SELECT k, id FROM {nums}) PIVOT (count(id) FOR k IN (1, 2))", [(72, 72)]),
    ("SELECT id FROM {nums} a WHERE EXISTS (SELECT 1 FROM guard_nums b WHERE b.id = a.id + 498)", [(0,), (1,)]),
    ("SELECT id FROM {nums} TABLESAMPLE (2 ROWS)", None),
    ("TABLE guard_nums", None),
])
def test_queries_pass(spark, nums, text, rows):
    got = guarded_sql(spark, text, tables={"nums": nums})
    assert got.ok, got.error
    found = [tuple(r) for r in got.df.collect()]
    assert found and (rows is None or found == rows)


def test_truncated_is_known_without_eager(spark, nums):
    assert guarded_sql(spark, "SELECT id FROM guard_nums").truncated is True
    assert guarded_sql(spark, "SELECT id FROM guard_nums LIMIT 100").truncated is False
    assert guarded_sql(spark, "SELECT id FROM guard_nums", max_rows=None).truncated is False


def test_catalog_tables_and_handed_in_frames(spark, nums, tmp_path):
    """Qualified tables are read; a frame's own plan (here a Python function) is its owner's business."""
    spark.sql("CREATE DATABASE IF NOT EXISTS guard_db")
    nums.limit(3).write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("guard_db.three")
    assert guarded_sql(spark, "SELECT id FROM guard_db.three").df.count() == 3
    assert guarded_sql(spark, "SELECT id FROM spark_catalog.guard_db.three").df.count() == 3
    mine = nums.limit(2).select(F.udf(lambda x: x.upper())("s").alias("u"))
    before = {v.name for v in spark.catalog.listTables()}
    got = guarded_sql(spark, "SELECT u FROM {mine} ORDER BY u", tables={"mine": mine})
    assert [r.u for r in got.df.collect()] == ["V0", "V1"]
    assert {v.name for v in spark.catalog.listTables()} == before
    spark.sql("DROP DATABASE guard_db CASCADE")
