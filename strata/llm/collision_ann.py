"""Nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on ``PROJECTIONS`` fixed random directions.  Vectors are dealt to blocks by a
hash of their id; a block keeps one sorted array per direction.  A query opens a window around its
own projection in every array and widens all windows by ``GROWTH`` (virtual rehashing: buckets of a
larger radius are unions of the smaller ones, so nothing is hashed again) until enough vectors have
been met in at least ``THRESHOLD`` of the arrays; those, and only those, are verified by their exact
distance.  Each block returns its best ``k`` for each query, and a last aggregation by query merges them.

A query meets every block, so the answer does not depend on how near vectors are spread, and a vector
that fills a third of the table spreads over the blocks by id.  Blocks of vectors and blocks of queries
meet pairwise in bounded tasks (``BLOCK_ROWS`` by ``QUERY_ROWS``).

Cases: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor
do rows without an id; vectors are compared with those of their own dimension; ties go to the
smaller id; rows that repeat a query's id are its own; components of any finite size are compared (a distance
beyond the double range is infinite); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.pieces import ragged

PROJECTIONS = 64
THRESHOLD = 0.8  # of the arrays
GROWTH = 1.15
CANDIDATES, LEAST = 0.12, 256  # part of a block, and least number, verified besides the k
BLOCK_ROWS = 16_384
QUERY_ROWS = 2048
SEED = 20_240_229


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, PROJECTIONS)) / np.sqrt(dim)


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision.  Differences whose squares would overflow are scaled by a
    power of two first, which changes no digit."""
    if max(np.abs(x).max(initial=0.0), np.abs(query).max()) < 1e150:
        return np.sqrt(((x - query) ** 2).sum(axis=1))
    half = x * 0.5 - query * 0.5
    power = np.frexp(np.abs(half).max(axis=1))[1]
    with np.errstate(over="ignore"):  # a distance beyond the double range is infinite
        return np.ldexp(np.sqrt((np.ldexp(half, -power[:, None]) ** 2).sum(axis=1)), power + 1)


def block_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, distance) of the best ``k`` of a block for each query."""
    n, a = len(ids), directions(x.shape[1])
    # scaled by a power of two, so that no projection overflows; order and ratios stay
    scale = -np.frexp(max(np.abs(x).max(), np.abs(queries).max()))[1]
    projected, asked = np.ldexp(x, scale) @ a, np.ldexp(queries, scale) @ a
    order = np.argsort(projected, axis=0, kind="stable")
    arrays = np.take_along_axis(projected, order, axis=0)
    flat = np.ascontiguousarray(order.T.astype(np.int32)).reshape(-1)
    base = np.arange(PROJECTIONS, dtype=np.int64) * n
    need, enough = int(np.ceil(THRESHOLD * PROJECTIONS)), min(n, k + 1 + max(LEAST, int(CANDIDATES * n)))
    spread = float(projected.std(axis=0).mean()) or 1.0
    out_q, out_v, out_d = [], [], []
    for first in range(0, len(queries), 256):
        open_ = np.arange(first, min(first + 256, len(queries)))
        met = np.zeros((len(open_), n), np.uint8)  # collisions so far; PROJECTIONS is below 256
        row = np.arange(len(open_))
        low = np.stack([np.searchsorted(arrays[:, j], asked[open_, j]) for j in range(PROJECTIONS)], axis=1)
        high, half = low.copy(), 0.1 * spread
        while len(open_):
            lo = np.stack([np.searchsorted(arrays[:, j], asked[open_, j] - half, "left") for j in range(PROJECTIONS)], axis=1)
            hi = np.stack([np.searchsorted(arrays[:, j], asked[open_, j] + half, "right") for j in range(PROJECTIONS)], axis=1)
            stay = np.ones(len(open_), bool)
            # windows whose joint size cannot give enough collisions need no look yet
            for r in np.flatnonzero((hi - lo).sum(axis=1) >= need * enough).tolist():
                q, count = open_[r], met[row[r]]
                starts = np.concatenate([base + lo[r], base + high[r]])  # what the wider windows add
                sizes = np.concatenate([low[r] - lo[r], hi[r] - high[r]])
                count += np.bincount(ragged(flat, starts, sizes), minlength=n).astype(np.uint8)
                low[r], high[r] = lo[r], hi[r]
                if np.count_nonzero(count >= need) < enough:
                    continue
                found = np.flatnonzero(count >= need)
                found = found[ids[found] != query_ids[q]]
                d = distances(x[found], queries[q])
                best = np.lexsort((ids[found], d))[:k]
                out_q.append(np.full(len(best), query_ids[q]))
                out_v.append(ids[found[best]])
                out_d.append(d[best])
                stay[r] = False
            open_, row, low, high, half = open_[stay], row[stay], low[stay], high[stay], half * GROWTH
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(out_q, np.int64), join(out_v, np.int64), join(out_d, np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that ``is_query`` holds for,
    among all other rows, by Euclidean distance in double precision."""
    src = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].cast("array<double>").alias("x"), is_query.alias("asks"))
    src = src.where(F.col("id").isNotNull() & usable(F.col("x"))).withColumn("dim", F.size("x"))
    sizes = src.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("bigint")).alias("q")).first()
    blocks, asked = -(-sizes["n"] // BLOCK_ROWS) or 1, -(-(sizes["q"] or 0) // QUERY_ROWS) or 1
    here = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(asked)).cast("int")
    base = src.select("dim", here.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("part"), "id", "x")
    queries = src.where("asks").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), mine.alias("part"), "id", "x")

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        if held.num_rows and asking.num_rows:
            take = lambda t: (t.column("id").to_numpy(), np.asarray(t.column("x").combine_chunks().flatten()).reshape(t.num_rows, -1))
            q, v, d = block_search(*take(held), *take(asking), k)
        else:
            q, v, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": q, "vec_id": v, "score": d})

    keys = ["dim", "block", "part"]
    found = base.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    # rows that repeat an id are distinct candidates; so are their results
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
