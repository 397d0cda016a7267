import hashlib
import random
import zlib

import pytest
from helpers import ODD_TEXTS, oracle, same_rows

from strata.llm import merkle_manifest as M
from strata.llm.queries import ORACLE, QUERIES

LOWER = str.maketrans(M.UPPER, M.LOWER)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def climb(nodes):
    """Levels of a tree, node lists from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([H(*at[k:k + 16]) for k in range(0, len(at), 16)])
    return levels


def siblings(levels, pos):
    out = []
    for level in levels[:-1]:
        run = pos // 16 * 16
        out.append(("".join(level[run:pos]), "".join(level[pos + 1:run + 16])))
        pos //= 16
    return out


def plain(rows):
    """The contract, document by document."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for pos, r in enumerate(groups[s]):
            path = siblings(trees[s], pos) + siblings(top, k)
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf((*r[:4], r[4] if r[4] is None else r[4].translate(LOWER)))
            for a, b in path:
                node = H(a, node, b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H(*[x for p in path for x in p]), node, node == top[-1][0]))
    return out


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
KEY = lambda rows: sorted(tuple(map(str, r)) for r in rows)


def rows_of(n, sources, seed=3):
    rng = random.Random(seed)
    ids = rng.sample(range(-50, 20 * n + 50), n)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 0, 77]), rng.choice(ODD_TEXTS + ["Some Text", "UPPER é"])) for i in ids]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert same_rows(QUERIES["op11_merkle_manifest"](spark, folder), oracle(ORACLE["op11_merkle_manifest"], folder))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_group_sizes(spark, n):
    rows = rows_of(n, ["only"], n)
    assert KEY(M.audit(spark.createDataFrame(rows, SCHEMA)).collect()) == KEY(plain(rows))


def test_several_rounds_and_a_hot_group(spark):
    """A group of more than one block, others of one row, the null and the empty source apart."""
    rows = rows_of(6000, ["hot"] * 30 + [None, "", "b", "é", "z", "Z"]) + [(9_999_999, "lone", None, None, None)]
    got = M.audit(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert KEY(got) == KEY(plain(rows))
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_many_groups(spark):
    rows = rows_of(700, [f"s{k}" for k in range(300)])
    assert KEY(M.audit(spark.createDataFrame(rows, SCHEMA)).collect()) == KEY(plain(rows))


def test_odd_rows(spark):
    """Null ids, repeated ids and rows, clashing extra columns, a long text."""
    rows = [(None, None, None, None, None), (None, "s", "en", 1, "A"), (7, "s", "en", 1, "B"), (7, "s", "en", 1, "A"), (7, "s", "en", 1, "A"), (8, "s", None, 3, "Long " * 100_000)]
    docs = spark.createDataFrame([(*r, "x", 3, "y", 1) for r in rows], SCHEMA + ", leaf string, pos bigint, key string, path int")
    assert KEY(M.audit(docs).collect()) == KEY(plain(rows))
    assert M.audit(docs.limit(0)).count() == 0


def test_a_path_proves_its_own_row_only(spark):
    docs = spark.createDataFrame(rows_of(400, ["a", "b"]), SCHEMA)
    rows = M.manifest(docs).select("doc_id", "root", M.fold(M.F.col("leaf"), M.F.col("path")).alias("right"), M.fold(M.F.sha2(M.F.lit("no"), 256), M.F.col("path")).alias("wrong")).collect()
    assert all(r["right"] == r["root"] != r["wrong"] for r in rows)
