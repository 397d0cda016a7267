import math
import random

import pytest
from helpers import frame, odd_documents, oracle, same_rows
from pyspark.sql import functions as F

from strata.llm import temperature_mix as M
from strata.llm.queries import ORACLE, QUERIES


def skewed(spark, folder):
    """A folder of documents with one hot source, and its rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").when(F.col("doc_id") % 31 == 1, F.lit(None)).otherwise(F.col("source")))
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return docs


def test_query_matches_sql(spark, tmp_path):
    assert same_rows(QUERIES["op6_temperature_mix"](spark, "/root/testdata/sf0.01"), oracle(ORACLE["op6_temperature_mix"], "/root/testdata/sf0.01"))
    skewed(spark, tmp_path)
    assert same_rows(QUERIES["op6_temperature_mix"](spark, str(tmp_path)), oracle(ORACLE["op6_temperature_mix"], str(tmp_path)))


def test_entropy_budget_and_block_thresholds(spark, tmp_path, monkeypatch):
    docs = skewed(spark, tmp_path)
    monkeypatch.setattr(M, "BLOCK_DOCS", 16)  # many blocks per source
    total = sum(len((r["text"] or "").split()) for r in docs.collect())
    rows = M.mix(docs, M.Target(entropy=0.97, budget=total), seed=3).collect()
    assert len(rows) == docs.count()
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["mix_key"], r["mix_tokens"], r["copies"]))
    share = {s: sum(t for _, t, _ in x) / sum(t for v in by.values() for _, t, _ in v) for s, x in by.items()}
    exponent = rows[0]["exponent"]

    def entropy(a):
        z = sum(p ** a for p in share.values())
        return -sum(p ** a / z * math.log(p ** a / z) for p in share.values())

    goal = 0.97 * math.log(len(share))
    assert entropy(exponent) >= goal - 1e-9 and entropy(exponent + 1 / M.GRID) < goal
    z = sum(p ** exponent for p in share.values())
    for s, x in by.items():
        x.sort()
        tokens = sum(t for _, t, _ in x)
        quota = math.floor(share[s] ** exponent / z * sum(sum(t for _, t, _ in v) for v in by.values()) + 1e-6)
        passes, rest = divmod(quota, tokens)
        upto = 0
        for _, t, copies in x:
            upto += t
            assert copies == passes + (upto <= rest), s


def test_repeat_limit_keeps_every_document(spark, tmp_path):
    docs = skewed(spark, tmp_path)
    rows = M.mix(docs, M.Target(max_repeats=4), seed=7).collect()
    assert min(r["copies"] for r in rows) >= 1 and max(r["copies"] for r in rows) <= 5
    made = M.realise(docs, M.Target(max_repeats=4), seed=7)
    assert made.columns == docs.columns and made.count() == sum(r["copies"] for r in rows)
    assert made.select("doc_id").distinct().count() == docs.count()
    words = {r["source"]: 0 for r in rows}
    for r in rows:
        words[r["source"]] += r["mix_tokens"]
    mixed = {s: sum(r["mix_tokens"] * r["copies"] for r in rows if r["source"] == s) for s in words}
    assert max(mixed[s] / words[s] for s in words) <= 4 + 1e-9


def test_equal_weights_at_exponent_zero(spark):
    docs = frame(spark, [(k, "w " * (k % 3 + 1), "en", "a" if k < 90 else "b", 1) for k in range(100)])
    rows = M.mix(docs, M.Target(entropy=1.0, budget=1000)).collect()
    assert rows[0]["exponent"] == pytest.approx(0.0)
    assert sum(r["mix_tokens"] * r["copies"] for r in rows if r["source"] == "b") == pytest.approx(500, abs=4)


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumnRenamed("score", "Copies").withColumnRenamed("lang_pred", "mix_key")
    rows = M.mix(docs, M.Target(max_repeats=3))
    assert rows.count() == docs.count() and [c.lower() for c in rows.columns].count("copies") == 1
    assert M.mix(docs.limit(0), M.Target(max_repeats=3)).count() == 0
    empty = frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])
    assert [r["copies"] for r in M.mix(empty, M.Target(entropy=0.9, budget=0)).collect()] == [1, 1]
    assert M.realise(docs, M.Target(max_repeats=3)).columns == docs.columns


def test_user_columns_keep_their_values(spark):
    rows = [(k, "w " * (k % 3 + 1), "a" if k % 3 else "b", k, k + 1, k + 2, f"k{k}") for k in range(60)]
    for names in (("threshold", "passes", "copies", "mix_key"), ("EXPONENT", "mix_source", "mix_pass", "c0"), ("Mix_Tokens", "quota", "rest", "block")):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{n} {t}" for n, t in zip(names, ("int", "int", "int", "string"))))
        made = M.realise(docs, M.Target(max_repeats=3))
        assert made.columns == docs.columns
        assert set(map(tuple, made.collect())) == set(map(tuple, rows))
        assert M.mix(docs, M.Target(max_repeats=3)).count() == 60


def test_only_native_operators(spark):
    plan = QUERIES["op6_temperature_mix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_rounding_of_large_sources_loses_no_document(spark):
    rng = random.Random(4)
    sizes = [int(rng.uniform(1, 100) * 1e13) + 7 for _ in range(12)]
    for k in range(4):
        part = sizes[3 * k:3 * k + 3]
        rows = spark.createDataFrame([(f"={s}", f"{j:015x}", n) for s, size in enumerate(part) for j, n in enumerate((size - 5, 5))], "mix_source string, mix_key string, mix_tokens bigint")
        per_source, _ = M.plan(rows, M.Target(max_repeats=4))
        assert all(r["passes"] >= 1 for r in per_source.collect()), part
