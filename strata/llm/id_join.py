"""Joins exploded token ids with a vocabulary's table (id, bytes) and puts the rows together again.

A unit is a run of rows with equal (k1, k2): the words of a block's bucket, or one row of a table of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import pieces as P


def vocabulary(spark: SparkSession, ids: list[int], spelled: list[bytes]) -> DataFrame:
    """The table (id, bytes); its size is the vocabulary's."""
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int32()), "bytes": pa.array(spelled, pa.binary())}))


def joined_bytes(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (k1 bigint, k2 bigint, word int, p int, id int) with the ``bytes`` of their id.  A unit's rows stay neighbours: the
    vocabulary is broadcast, so rows are only looked up."""
    return rows.join(F.broadcast(vocabulary), "id", "left").select("k1", "k2", "word", "p", "id", "bytes")


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(k1, k2, tokens of each word, ids, bytes of each word, all bytes) of each run of rows with equal keys."""
    held: list[tuple] = []

    def close() -> tuple:
        word, p, ids, sizes, flat = (np.concatenate([h[k] for h in held]) for k in range(5))
        order = np.lexsort((p, word))
        if np.any(np.diff(order) < 0):
            flat = P.ragged(flat, (np.cumsum(sizes) - sizes)[order], sizes[order])
            word, ids, sizes = word[order], ids[order], sizes[order]
        counts = np.bincount(word)
        return counts, ids, np.bincount(word, weights=sizes, minlength=len(counts)).astype(np.int64), flat

    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2 = batch.column(0), batch.column(1).to_numpy()
        one = k1.fill_null(-1).to_numpy(zero_copy_only=False)
        change = np.flatnonzero((np.diff(k2) != 0) | (np.diff(one) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            now = (k1[a].as_py(), int(k2[a]))
            if now != key:
                if held:
                    yield *key, *close()
                key, held = now, []
            part = batch.slice(a, b - a)
            if part.column(4).null_count:  # a unit without ids
                part = part.filter(part.column(4).is_valid())
            held.append((*[part.column(c).to_numpy() for c in (2, 3, 4)], *binary_parts(part.column(5))))
    if held:
        yield *key, *close()


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and joined bytes of a binary column without nulls."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return np.diff(offsets).astype(np.int64), data[offsets[0]:offsets[-1]]
