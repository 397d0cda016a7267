import math

import numpy as np
from pyspark.sql import functions as F

from strata.llm import collision_ann as A
from strata.llm.queries import QUERIES


def brute(ids, x, query, k=10):
    d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(axis=1))
    other = ids != query
    order = np.lexsort((ids[other], d[other]))[:k]
    return list(zip(ids[other][order].tolist(), d[other][order].tolist()))


def test_recall_and_exact_scores(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["e"] for r in rows])
    got: dict = {}
    for r in QUERIES["op4_collision_ann"](spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(math.dist(x[ids == q][0], x[ids == v][0]) - d) < 1e-12 for _, v, d in found)
        hits += len({v for v, _ in brute(ids, x, q)} & {v for _, v, _ in found})
    assert hits / (10 * len(got)) >= 0.9


def test_recall_over_several_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 32))
    ids = np.arange(6000)
    hits = 0
    for q in range(0, 6000, 300):
        found = []
        for b in range(3):
            own = ids % 3 == b
            _, v, d = A.block_search(ids[own], x[own], ids[[q]], x[[q]], 10)
            found += zip(d.tolist(), v.tolist())
        hits += len({v for v, _ in brute(ids, x, q)} & {v for _, v in sorted(found)[:10]})
    assert hits / 200 >= 0.9


def test_ties_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0])] + [(k, [1.0, 1.0]) for k in range(30, 10, -1)] + [(40, [2.0, 1.0]), (41, None), (42, [0.0, 0.0]), (43, [nan, 1.0]), (44, [inf, 1.0]), (45, [None, 1.0]), (46, []), (47, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in A.search(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got[:10] == [(0, k, k + 10, 0.0) for k in range(1, 11)]
    assert got[10:] == [(200, 1, 47, math.dist((1, 2, 3), (1, 0, 0)))]
    assert A.search(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = [(r["vec_id"], r["score"]) for r in A.search(vectors.where("vec_id in (0, 12, 40)"), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert few == [(12, 0.0), (40, 1.0)]


def test_vectors_of_any_finite_size(spark):
    """Components whose projections or squares would overflow, beside ordinary and tiny ones."""
    rng = np.random.default_rng(5)
    big = [[float(v) for v in row] for row in rng.uniform(-1, 1, (40, 3)) * 1.7e308]
    rows = [(k, v) for k, v in enumerate(big)] + [(100 + k, [1.0 + k, 2.0, 3.0]) for k in range(40)] + [(200 + k, [1e-300 * (k + 1), 0.0, 1e-310]) for k in range(40)]
    rows += [(300, [1e160, 0.0, 0.0]), (301, [1e160, 1e145, 0.0]), (302, [3e160, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in A.search(vectors, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200, 300}
    assert got[100][:2] == [(101, 1.0), (102, 2.0)]
    assert got[300][0] == (301, 1e145) and got[300][0][1] <= got[300][1][1]
    by = dict(rows)
    want = sorted((math.dist([c / 4 for c in by[0]], [c / 4 for c in v]), i) for i, v in rows if i)[:3]
    assert [i for i, _ in got[0]] == [i for _, i in want]
    assert all(abs(s / 4 - d) <= 1e-12 * d or math.isinf(s) for (_, s), (d, _) in zip(got[0], want))


def test_recall_over_blocks_through_search(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_ROWS", 700)
    monkeypatch.setattr(A, "QUERY_ROWS", 5)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in A.search(vectors, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len({v for v, _ in brute(np.arange(3000), x, q)} & found) for q, found in got.items())
    assert len(got) == 30 and hits / 300 >= 0.9
