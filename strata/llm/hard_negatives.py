"""Hard negatives from Hilbert-ordered Parquet blocks with zone maps.

Vectors are scaled to integers, ordered by (dimension, label, place on a Hilbert curve through the space) and
written as Parquet blocks of about ``BLOCK_VALUES`` components, a row a block; beside the vectors a
block holds its zone map: the least and largest value of each dimension, and of the label.  An anchor's inner
product with any vector of a block lies between the sums of the least and of the largest of ``a * lo`` and
``a * hi`` over the dimensions.  These bounds decide which blocks an anchor reads:

1. its positives: the ``SEEDS`` blocks of its label with the largest upper bounds give a first k-th score, then
   all blocks of its label whose upper bound reaches that score are read;
2. its negatives: each positive opens a window of scores; the blocks of other labels with the largest upper bounds
   give a first k-th score for each window, then all blocks whose bounds meet what is left of a window are read.

Zone maps meet anchors in bounded pairs of chunks (``ZONES`` by ``ANCHORS``); a block is then joined with the anchors that
ask for it, chunk by chunk, and answers each with its best rows only, which a window function merges.
Results are exact.  On data without structure the bounds skip few blocks and the work
grows as anchors times rows, as any exact search's.

Cases: rows with a null label, a null vector, a null or non-finite component, or no id take no part; vectors meet
those of their own dimension; rows that repeat an anchor's id are its own (never its positives or
negatives), and an id that repeats among other rows counts once for each row; ties go to the smaller id; a component
beyond the long range counts as the end of that range, and so does a score; anchors without positives,
and positives whose window is empty, give no rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import materialise

BLOCK_VALUES = 1 << 16
BITS = 4  # of a dimension, in the place on the curve
SEEDS = 2
ZONES, ANCHORS = 256, 512
_LONG = np.iinfo(np.int64)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, x, dim) of the rows that take part; x are the integers floor(scale * component)."""
    x = F.transform(vectors[vector_col], lambda v: v.cast("double"))
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), label.cast("bigint").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    whole = lambda v: F.when(v * scale >= 2.0**63, F.lit(_LONG.max)).when(v * scale <= -2.0**63, F.lit(_LONG.min)).otherwise(F.floor(v * scale))
    return rows.select("id", "label", F.transform("x", whole).alias("x"), F.size("x").alias("dim"))


def hilbert(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place of each row of cells (0 .. 2**bits - 1) on the Hilbert curve, as bytes that sort alike
    (axes to transposed index, bit by bit over all rows at once)."""
    n, dim = cells.shape
    if not dim:
        return [b""] * n
    axes = np.ascontiguousarray(cells.T.astype(np.uint32))
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = np.uint32(q - 1)
        for i in range(dim):
            far = (axes[i] & q) != 0
            swap = np.where(far, 0, (axes[0] ^ axes[i]) & low).astype(np.uint32)
            axes[0] ^= np.where(far, low, swap)
            if i:
                axes[i] ^= swap
    for i in range(1, dim):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(n, np.uint32)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        turn ^= np.where((axes[-1] & q) != 0, np.uint32(q - 1), np.uint32(0))
    axes ^= turn
    planes = [(axes >> k) & 1 for k in range(bits - 1, -1, -1)]  # bit planes, the highest first
    packed = np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)
    return [r.tobytes() for r in packed]


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list<bigint> column of equally long lists as an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


_BLOCK = "block bigint, dim int, first_label bigint, last_label bigint, lo array<bigint>, hi array<bigint>, ids array<bigint>, labels array<bigint>, x array<bigint>"


def write_blocks(rows: DataFrame) -> DataFrame:
    """The Hilbert-ordered blocks of rows (id, label, x, dim), written to the shared folder."""
    # a range that holds most components; what lies beyond goes to the outer cells
    span = rows.where("dim > 0").agg(F.percentile_approx(F.array_min("x"), 0.1).alias("lo"), F.percentile_approx(F.array_max("x"), 0.9).alias("hi"), F.sum("dim").alias("n")).first()
    lo, hi, parts = float(span["lo"] or 0), float(span["hi"] or 0), (span["n"] or 0) // (4 * BLOCK_VALUES) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = batch.column(3).to_numpy(), [b""] * batch.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = matrix(batch.column(2).take(pa.array(at)), len(at)).astype(np.float64) if dim else np.zeros((len(at), 0))
                cells = np.clip((x - lo) * ((1 << BITS) / max(hi - lo, 1.0)), 0, (1 << BITS) - 1)
                for k, key in zip(at.tolist(), hilbert(cells.astype(np.uint32))):
                    keys[k] = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["id", "label", "x", "dim", "place"])

    placed = rows.select("id", "label", "x", "dim").mapInArrow(place, "id bigint, label bigint, x array<bigint>, dim int, place binary")
    order = ["dim", "label", "place", "id", "row"]
    ordered = placed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("first_label", pa.int64()), ("last_label", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("lo", "hi", "ids", "labels", "x")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, dim, size = TaskContext.get().partitionId() << 32, [], None, 0

        def block() -> pa.RecordBatch:
            ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            x = np.concatenate([h[2] for h in held])
            return pa.RecordBatch.from_pylist([{"block": number, "dim": dim, "first_label": int(labels[0]), "last_label": int(labels[-1]), "lo": x.min(axis=0), "hi": x.max(axis=0), "ids": ids, "labels": labels, "x": x.reshape(-1)}], schema)

        for batch in batches:
            ids, labels, dims = (batch.column(k).to_numpy() for k in (0, 1, 3))
            at = 0
            while at < len(ids):
                room = max(1, BLOCK_VALUES // max(1, int(dims[at])))
                # a label of its own block begins once the block has a fair size
                if held and (dims[at] != dim or size >= room or (4 * size >= room and labels[at] != held[-1][1][-1])):
                    yield block()
                    number, held, size = number + 1, [], 0
                dim, end = int(dims[at]), min(len(ids), at + room - size)
                changes = np.flatnonzero((labels[at:end] != labels[at]) | (dims[at:end] != dim))
                end = at + int(changes[0]) if len(changes) else end
                x = matrix(batch.column(2).slice(at, end - at), end - at) if dim else np.zeros((end - at, 0), np.int64)
                held.append((ids[at:end], labels[at:end], x))
                size, at = size + end - at, end
        if held:
            yield block()

    return materialise(ordered.select("id", "label", "x", "dim").mapInArrow(cut, _BLOCK), "hilbert-blocks")


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible inner product of each anchor with each box, rounded outwards."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    slack = 1e-9 * (np.abs(anchors) @ np.maximum(np.abs(lo), np.abs(hi)).T) + 0.5
    return np.nan_to_num(least - slack, nan=-np.inf), np.nan_to_num(most + slack, nan=np.inf)


def scores(anchors: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; what does not fit a long becomes the end of its range."""
    largest = lambda m: max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    reach = largest(anchors) * largest(x) * x.shape[1]
    if reach < 1 << 53:
        return (anchors.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if reach < 1 << 63:
        return anchors @ x.T
    wide = anchors.astype(object) @ x.T.astype(object)
    return np.clip(wide, _LONG.min, _LONG.max).astype(np.int64)


#: An anchor in flight: ``a`` numbers it, low and high are the score windows it still looks into.
_ASK = "block bigint, a array<bigint>, own array<bigint>, label array<bigint>, x array<bigint>, low array<bigint>, high array<bigint>"


def choose(zones: DataFrame, anchors: DataFrame, same: bool, seeds: int | None) -> DataFrame:
    """One row per block and chunk of anchors: the anchors (a, own, label, x, low, high; as many windows for each) that must read the block.
    ``same``: blocks that hold the anchor's label, else blocks that hold another.  With ``seeds`` only the blocks of the largest upper bounds."""
    n_zones, n_anchors = -(-zones.count() // ZONES) or 1, -(-anchors.count() // ANCHORS) or 1
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = zones.select("dim", mine("block", n_zones).alias("zone"), every(n_anchors).alias("part"), "block", "first_label", "last_label", "lo", "hi")
    right = anchors.select(F.size("x").alias("dim"), every(n_zones).alias("zone"), mine("a", n_anchors).alias("part"), "a", "own", "label", "x", "low", "high")
    schema = pa.schema([("block", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("a", "own", "label", "x", "low", "high")]])

    def run(boxes: pa.Table, asking: pa.Table) -> pa.Table:
        rows = []
        if boxes.num_rows and asking.num_rows:
            take = lambda t, c: matrix(t.column(c).combine_chunks(), t.num_rows)
            blocks, first, last = (boxes.column(c).to_numpy() for c in ("block", "first_label", "last_label"))
            numbers, own, label = (asking.column(c).to_numpy() for c in ("a", "own", "label"))
            x, low, high = take(asking, "x"), take(asking, "low"), take(asking, "high")
            least, most = bounds(x.astype(np.float64), take(boxes, "lo").astype(np.float64), take(boxes, "hi").astype(np.float64))
            here = (first <= label[:, None]) & (label[:, None] <= last) if same else (first != label[:, None]) | (last != label[:, None])
            meets = np.zeros(here.shape, bool)
            for w in range(low.shape[1]):  # an empty window has low > high
                meets |= (low[:, [w]] <= high[:, [w]]) & (most >= low[:, [w]]) & (least <= high[:, [w]])
            reads = here & meets
            if seeds and reads.shape[1] > seeds:
                order = np.argsort(np.where(reads, -most, np.inf), axis=1, kind="stable")[:, :seeds]
                best = np.zeros(reads.shape, bool)
                np.put_along_axis(best, order, True, axis=1)
                reads &= best
            for b in np.flatnonzero(reads.any(axis=0)).tolist():
                r = np.flatnonzero(reads[:, b])
                rows.append({"block": int(blocks[b]), "a": numbers[r], "own": own[r], "label": label[r], "x": x[r].reshape(-1), "low": low[r].reshape(-1), "high": high[r].reshape(-1)})
        return pa.Table.from_pylist(rows, schema)

    keys = ["dim", "zone", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _ASK)


def read(blocks: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """(a, window, id, score): for each anchor and window the best ``k`` rows of all blocks it reads, those
    of its label or of others, with ``rank``."""
    joined = asks.join(blocks.select("block", "ids", "labels", F.col("x").alias("vectors")), "block").drop("block")
    names = ["a", "window", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                numbers, own, label, x, low, high, ids, labels, vectors = (batch.column(c)[r].values.to_numpy() for c in range(9))
                n, m = len(numbers), len(ids)
                got = scores(x.reshape(n, -1), vectors.reshape(m, -1))
                low, high = low.reshape(n, -1), high.reshape(n, -1)
                out: list[list] = [[], [], [], []]
                for i in range(n):
                    fits = ((labels == label[i]) == same) & (ids != own[i])
                    for w in range(low.shape[1]):
                        at = np.flatnonzero(fits & (got[i] >= low[i, w]) & (got[i] <= high[i, w]))
                        if not len(at):
                            continue
                        value = got[i, at]
                        if len(at) > k:  # those that reach the k-th score, ties included
                            reach = value >= np.partition(value, len(at) - k)[len(at) - k]
                            at, value = at[reach], value[reach]
                        best = np.lexsort((ids[at], ~value))[:k]  # ~v falls as v rises, without overflow
                        for c, v in zip(out, (np.full(len(best), numbers[i]), np.full(len(best), w), ids[at[best]], value[best])):
                            c.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=names)

    found = joined.mapInArrow(run, "a bigint, window bigint, id bigint, score bigint")
    best = Window.partitionBy("a", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int, int] = (30, 90, 100)) -> DataFrame:
    """For every row (id, label, x, dim) that ``is_anchor`` holds for and each of its first ``positives`` rows of the same label: the first
    ``negatives`` rows of other labels whose score lies between share[0] / share[2] and share[1] / share[2] of the
    positive's.  Scores are inner products; higher come first, then smaller ids."""
    blocks = write_blocks(rows)
    zones = blocks.select("block", "dim", "first_label", "last_label", "lo", "hi")
    asking = rows.where(is_anchor).select("id", "label", "x").withColumn("a", F.monotonically_increasing_id())
    anchors = materialise(asking.select("a", F.col("id").alias("own"), "label", "x"), "anchors")
    end = F.lit(_LONG.max)
    whole = anchors.withColumns({"low": F.array(F.lit(_LONG.min)), "high": F.array(end)})
    first = read(blocks, choose(zones, whole, True, SEEDS), True, positives)
    kth = first.where(F.col("rank") == positives).select("a", F.col("score").alias("kth"))
    narrowed = whole.join(kth, "a", "left").withColumn("low", F.array(F.coalesce("kth", F.lit(_LONG.min)))).drop("kth")
    found = materialise(read(blocks, choose(zones, narrowed, True, None), True, positives).select("a", "rank", "id", "score"), "positives")
    # the window of a positive, in whole numbers: ceil and floor without a product that could overflow
    low, high, of = share
    part = lambda n, up: _share(F.col("score"), n, of, up)
    windows = found.select("a", F.struct((F.col("rank") - 1).alias("w"), part(low, True).alias("low"), part(high, False).alias("high")).alias("window"))
    windows = windows.groupBy("a").agg(F.sort_array(F.collect_list("window")).alias("windows"))
    # as many windows for every anchor: (1, 0) is an empty one
    fill = lambda name, empty: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get("windows", i - 1)[name], F.lit(empty).cast("bigint")))
    open_ = materialise(anchors.join(windows, "a").select("a", "own", "label", "x", fill("low", 1).alias("low"), fill("high", 0).alias("high")), "windows")
    first = read(blocks, choose(zones, open_, False, SEEDS), False, negatives)
    kth = first.where(F.col("rank") == negatives).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    raised = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("kth", i.cast("bigint")), v)))
    narrowed = open_.join(kth, "a", "left").withColumn("low", raised).drop("kth")
    hard = read(blocks, choose(zones, narrowed, False, None), False, negatives)
    hard = hard.select("a", (F.col("window") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("a", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = pairs.join(anchors.select("a", F.col("own").alias("anchor_id")), "a")
    return named.join(hard, ["a", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _share(score: Column, n: int, of: int, up: bool) -> Column:
    """ceil or floor of score * n / of for 0 <= n <= of."""
    whole, rest = F.floor(score / F.lit(of).cast("decimal(20,0)")).cast("bigint"), F.pmod(score, F.lit(of).cast("bigint"))
    exact = whole * n + F.floor((rest * n + (of - 1 if up else 0)) / F.lit(of).cast("decimal(20,0)")).cast("bigint")
    return exact


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """Triples of the table of embeddings: labels of every seventh id are shifted by one, every hundredth row is an anchor."""
    shifted = F.when(vectors["vec_id"] % 7 == 0, (vectors["label"].cast("bigint") + 1) % 10).otherwise(vectors["label"].cast("bigint"))
    return mine(scaled(vectors, "vec_id", "embedding", shifted), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
           CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(o.x AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v o ON a.vec_id <> o.vec_id AND len(a.x) = len(o.x) WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
