"""Shared helpers: scratch tables in the cluster's shared folder, and Arrow passes over text."""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import shared_dir

CHUNK_CHARS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` for one intermediate table."""
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex[:6]}")


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, and a lost
    executor costs no recomputation of what stands above."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(batch: pa.RecordBatch, column: int | str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` characters each (one row at least), which bounds the
    memory of a vectorised pass whatever the batch size and the lengths of its texts."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(chunk: pa.RecordBatch, column: int | str) -> list[str]:
    """The texts of a chunk; null counts as empty."""
    return [x or "" for x in chunk.column(column).to_pylist()]


def give_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which gives freed memory back to the system when its task ends.  Python workers
    outlive their tasks; what their allocators keep would count beside the workers of every later stage."""

    def run_and_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return run_and_give_back


def map_text(df: DataFrame, fn: Callable[[list[str], pa.Array], dict[str, object]], schema: T.StructType, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add the columns of ``schema`` that ``fn(texts, column)`` returns for each chunk of rows: its
    texts (null as empty) and the column they come from.

    ``keep`` names the input columns that stay (all by default); an input column with the name of an
    added one (in any case) is replaced.  ``fn`` runs inside Arrow tasks.
    """
    added = {f.name.lower() for f in schema.fields}
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in added]
    if text_col in kept and dict(df.dtypes)[text_col] == "string":
        at, more = kept.index(text_col), []  # the text crosses to Python once
    else:
        at, more = len(kept), [df[text_col].cast("string").alias("__text")]
    src = df.select(*[df[c] for c in kept], *more)
    out = T.StructType([*src.schema.fields[:len(kept)], *schema.fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        types = [want.field(n).type for n in names]
        for batch in batches:
            for chunk in text_chunks(batch, at):
                got = fn(texts_of(chunk, at), chunk.column(at))
                cols = [got[n] if isinstance(got[n], (pa.Array, pa.ChunkedArray)) else pa.array(got[n], type=t) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays([*chunk.columns[:len(kept)], *cols], names=[*kept, *names])

    return src.mapInArrow(give_back(run), out)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder as a table bucketed by ``key`` and read it back: a join on ``key``
    with a side partitioned into as many parts moves none of its rows."""
    spark = df.sparkSession
    path = scratch(spark, name)
    made = f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(made)
    return spark.table(made)


def text_size(docs: DataFrame, column: str) -> int:
    """Characters of all texts; sizes of tables to be made come from it."""
    return docs.agg(F.sum(F.length(docs[column].cast("string"))).alias("n")).first()["n"] or 0


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one zstd frame, byte plane by byte plane."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [struct.pack("<qB", len(a), a.itemsize), a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<qB", raw, at)
        at += 9
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1))
        at += n * width
    return out
