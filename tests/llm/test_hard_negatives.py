import math

import numpy as np
import pytest
from helpers import oracle, same_rows

from strata.llm import hard_negatives as H
from strata.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows):
    """The contract, row by row, in Python integers."""
    part, clip = [], lambda v: max(-(2**63), min(2**63 - 1, v))
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        whole = [clip(math.floor(256 * c) if math.isfinite(256 * c) else int(math.copysign(2**64, c))) for c in x]
        part.append((i, whole, (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, x, label in part:
        if i % 100:
            continue
        known = [(-clip(sum(a * b for a, b in zip(x, y))), j, m) for j, y, m in part if j != i and len(y) == len(x)]
        for p, j, _ in sorted(k for k in known if k[2] == label)[:5]:
            fit = sorted(k for k in known if k[2] != label and 30 * -p <= 100 * -k[0] <= 90 * -p)[:10]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, H.hard_negatives(spark.createDataFrame(rows, schema)).collect()))


def clustered(n, dim=6, seed=1, hot=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        c = rng.integers(12)
        x = centres[c] + rng.normal(size=dim) * 0.1 if rng.random() >= hot else centres[0]
        rows.append((i, [float(v) for v in x], int(c % 4)))
    return rows


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert same_rows(QUERIES["op12_hard_negatives"](spark, folder), oracle(ORACLE["op12_hard_negatives"], folder))


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_many_small_blocks(spark, monkeypatch, hot):
    """Blocks of ten rows, small chunks; equal vectors in a third of the rows."""
    for name, value in (("BLOCK_VALUES", 60), ("ZONES", 16), ("ANCHORS", 3)):
        monkeypatch.setattr(H, name, value)
    rows = clustered(800, hot=hot)
    assert mined(spark, rows) == plain(rows)


def test_bounds_skip_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_VALUES", 120)
    data = spark.createDataFrame(clustered(3000), SCHEMA)
    blocks = H.write_blocks(H.scaled(data, "vec_id", "embedding", data["label"]))
    zones = blocks.select("block", "dim", "first_label", "last_label", "lo", "hi")
    rows = H.scaled(data, "vec_id", "embedding", data["label"]).where("id % 100 = 0")
    high = 2**62
    anchors = rows.select(H.F.col("id").alias("a"), H.F.col("id").alias("own"), "label", "x", H.F.array(H.F.lit(200_000).cast("bigint")).alias("low"), H.F.array(H.F.lit(high)).alias("high"))
    reads = H.choose(zones, anchors, True, None).agg(H.F.sum(H.F.size("a"))).first()[0]
    assert 0 < reads < 0.2 * blocks.count() * anchors.count()


def test_hilbert_neighbours_differ_in_one_step():
    for dim, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim, indexing="ij"), axis=-1).reshape(-1, dim)
        walk = grid[sorted(range(len(grid)), key=lambda k, keys=H.hilbert(grid, bits): keys[k])]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, a = rng.integers(-300, 300, (20, 5)), rng.integers(-300, 300, (4, 5))
        least, most = H.bounds(a.astype(float), x.min(axis=0)[None].astype(float), x.max(axis=0)[None].astype(float))
        got = H.scores(a, x)
        assert (got >= least).all() and (got <= most).all()


def test_odd_rows(spark, monkeypatch):
    """Nulls, non-finite and huge components, other dimensions, no components, repeated ids and rows, clashing columns."""
    monkeypatch.setattr(H, "BLOCK_VALUES", 8)
    rows = [(k, [float(k % 5), float(k % 3) / 3], k % 3) for k in range(0, 60)] + [(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (7, [1.0, 0.5], 1), (7, [1.0, 0.5], 1)]
    rows += [(None, [1.0, 1.0], 1), (300, None, 1), (301, [1.0, 1.0], None), (400, [None, 1.0], 1), (500, [math.nan, 1.0], 1), (600, [math.inf, 0.0], 2)]
    rows += [(700, [1e300, -1e300], 1), (701, [1e300, 1e300], 1), (702, [1e17, 1.0], 2), (800, [3.0], 1), (801, [2.0], 2), (802, [1.0], 1), (803, [4.0], 1), (900, [], 1), (901, [], 1), (902, [], 2)]
    rows += [(1000, [0.0, 0.0], 5), (1100, [-1.0, -1.0], 1), (-100, [2.0, 2.0], 2), (1200, [1.7e308, 1.0], 2)]
    got = mined(spark, [(*r, 1, 2, "x") for r in rows], SCHEMA + ", id int, block int, x string")
    want = plain(rows)
    assert [r for r in got if r[0] != 100] == [r for r in want if r[0] != 100]
    # an anchor row that occurs twice answers twice
    assert sorted(r for r in got if r[0] == 100) == sorted(r for r in want if r[0] == 100)
    assert mined(spark, [], SCHEMA) == []
