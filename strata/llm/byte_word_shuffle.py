"""Byte-level BPE by a global shuffle of distinct pre-tokens, and decoding through a join with the token-byte table.

1. Tasks split the texts into pre-tokens (the matches of the public pattern).  A block of texts keeps the
   position list of its pre-tokens, numbered by its own distinct ones, and deals these out by hash into buckets.
2. All blocks' pre-tokens of a bucket meet in one task, where each distinct one is encoded once.
3. The ids are exploded, one row per pre-token and position, and joined with the table (id, bytes) of the
   vocabulary; rows of one pre-token are put together by position.  No shuffle: the table is broadcast,
   and its size is the vocabulary's.
4. Ids and bytes go back to their block, which puts them in the place of its pre-tokens.

Blocks are written bucketed by block, so the position lists never cross the network; only distinct
pre-tokens do, there and back.  A pre-token that fills the corpus counts once a block, so no key is hot.
Blocks and both kinds of buckets are numbered from the size of the texts.  Memory in a task:
a block (``BLOCK_CHARS``; one text at least), a bucket's part of a block, and ``CACHE_WORDS`` encoded pre-tokens.

``decode`` decodes any table of ids by the same join.

Cases: null text = empty text (no ids, digests of nothing); repeated rows are encoded one by one; rows
without an id are kept; texts of any length are handled whole, and so is a single pre-token of any length; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import pieces as P
from strata.llm.common import bucketed, pack, text_chunks, text_size, texts_of, unpack
from strata.llm.id_join import joined_bytes, units, vocabulary

BLOCK_CHARS = 8 << 20
CACHE_WORDS = 200_000


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, open(path, "rb"))}


@lru_cache(2)
def _encoder(path: str):
    """Encodes a pre-token as a whole."""
    import tiktoken

    return tiktoken.Encoding("pre-tokens", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(path), special_tokens={})


def token_bytes(spark: SparkSession, ranks: str) -> DataFrame:
    """The vocabulary as a table (id, bytes)."""
    found = _ranks(ranks)
    return vocabulary(spark, list(found.values()), list(found.keys()))


_BLOCK = "block bigint, ids array<bigint>, positions binary, words array<struct<bucket:int,names:binary>>"


def blocks(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """One row per block: its documents, pre-tokens a document and their numbers, and its distinct
    pre-tokens by bucket."""
    src = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    part = pa.struct([("bucket", pa.int32()), ("names", pa.binary())])
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("positions", pa.binary()), ("words", pa.list_(part))])

    def packed(number: int, ids: list, sizes: list, parts: list, words: dict[int, str]) -> pa.RecordBatch:
        hashes = np.concatenate(parts)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        by_use = np.argsort(-np.bincount(inverse, minlength=len(distinct)), kind="stable")
        rank = np.empty(len(distinct), np.uint32)  # small numbers for frequent ones pack best
        rank[by_use] = np.arange(len(distinct), dtype=np.uint32)
        distinct = distinct[by_use]
        bucket = ((distinct >> np.uint64(11)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65_536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        names = [words[h] for h in distinct[order].tolist()]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        dealt = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            mine = names[edges[k]:edges[k + 1]]
            text = np.frombuffer("".join(mine).encode(), np.uint8)
            dealt.append({"bucket": k, "names": pack(np.fromiter(map(len, mine), np.uint32, len(mine)), text)})
        row = {"block": number, "ids": ids, "positions": pack(np.array(sizes, np.uint32), rank[inverse], bucket), "words": dealt}
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, sizes, parts, words, chars = [], [], [], {}, 0
        for batch in batches:
            for chunk in text_chunks(batch, 1):
                texts = texts_of(chunk, 1)
                cp, offsets = P.codepoints(texts)
                starts, lengths = P.byte_bpe_pieces(cp, offsets)
                hashes, joined = P.span_hashes(cp, starts, lengths), "".join(texts)
                distinct, at = np.unique(hashes, return_index=True)
                for h, a, n in zip(distinct.tolist(), starts[at].tolist(), lengths[at].tolist()):
                    if h not in words:
                        words[h] = joined[a:a + n]
                ids += chunk.column(0).to_pylist()
                sizes += np.diff(np.searchsorted(starts, offsets)).tolist()
                parts.append(hashes)
                chars += len(joined)
                if chars >= BLOCK_CHARS:
                    yield packed(number, ids, sizes, parts, words)
                    number, ids, sizes, parts, words, chars = number + 1, [], [], [], {}, 0
        if ids:
            yield packed(number, ids, sizes, parts, words)

    return src.mapInArrow(run, _BLOCK)


def encode_words(words: DataFrame, ranks: str, buckets: int) -> DataFrame:
    """(block, bucket, ids of each pre-token) of rows (block, bucket, names): a bucket's rows meet in one
    task, where a pre-token seen before is looked up."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("ids", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _encoder(ranks).encode_ordinary, {}
        for batch in batches:
            for r in range(batch.num_rows):
                lengths, text = unpack(batch.column(2)[r].as_py())
                joined, ends = text.tobytes().decode(), np.cumsum(lengths, dtype=np.int64)
                got = []
                for a, b in zip((ends - lengths).tolist(), ends.tolist()):
                    word = joined[a:b]
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        ids = known[word] = encode(word)
                    got.append(ids)
                sizes = np.fromiter(map(len, got), np.int32, len(got))
                flat = np.fromiter((i for g in got for i in g), np.int32, int(sizes.sum()))
                inner = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)
                outer = pa.ListArray.from_arrays(np.array([0, len(got)], np.int32), inner)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([batch.column(1)[r].as_py()], pa.int64()), outer], schema=schema)

    dealt = words.select("block", "bucket", "names").repartition(buckets, "bucket")
    return dealt.mapInArrow(run, "block bigint, bucket bigint, ids array<array<int>>")


def decode(tokens: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded binary) of every row of a table of ids, by the join with the token-byte table.
    Null and empty lists give no bytes; an id that the vocabulary lacks raises."""
    rows = tokens.select(tokens[id_col].cast("bigint").alias("k1"), F.monotonically_increasing_id().alias("k2"), tokens[ids_col].alias("ids"))
    rows = rows.select("k1", "k2", F.lit(0).alias("word"), F.posexplode_outer("ids").alias("p", "id"))
    rows = joined_bytes(rows, token_bytes(tokens.sparkSession, ranks))
    rows = rows.withColumn("bytes", F.when(F.col("id").isNotNull() & F.col("bytes").isNull(), F.raise_error("an id that the vocabulary lacks").cast("binary")).otherwise(F.col("bytes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, _, _, _, _, flat in units(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k1], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=[id_col, "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` bigint, decoded binary")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every text and decode its ids: one row per input row with ``id_col`` and ``ids`` (array<int>)
    and ``decoded`` (binary), or with ``digests`` ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    uint32) and ``decoded_sha256``."""
    spark = docs.sparkSession
    n_blocks = text_size(docs, text_col) // BLOCK_CHARS + 1
    buckets, homes = math.ceil(4 * math.sqrt(n_blocks)), max(n_blocks, 4)
    held = bucketed(blocks(docs, buckets, id_col, text_col), "byte-blocks", "block", homes)
    asked = held.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.names")
    found = encode_words(asked, ranks, buckets)
    each = found.select(F.col("block").alias("k1"), F.col("bucket").alias("k2"), F.posexplode("ids").alias("word", "ids"))
    each = joined_bytes(each.select("k1", "k2", "word", F.posexplode("ids").alias("p", "id")), token_bytes(spark, ranks))

    def pack_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, bucket, counts, ids, sizes, flat in units(batches):
            data = pack(counts.astype(np.uint32), ids.astype(np.uint32), sizes.astype(np.uint32), flat)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int64()), pa.array([data], pa.binary())], names=["block", "bucket", "found"])

    answers = each.mapInArrow(pack_units, "block bigint, bucket bigint, found binary").repartition(homes, "block")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("found"))
    joined = held.select("block", "ids", "positions").join(answers, "block", "left").select("ids", "positions", "found")
    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield from assemble(batch.slice(r, 1).to_pylist()[0], id_col, digests)

    return joined.mapInArrow(run, f"`{id_col}` bigint, {made}")


def assemble(row: dict, id_col: str, digests: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a block, their pre-tokens replaced by ids and bytes."""
    sizes, numbers, bucket = unpack(row["positions"])
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    got = [unpack(f["found"]) for f in sorted(row["found"] or [], key=lambda f: f["bucket"])]
    columns = [np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.uint32) for k in range(4)]
    counts, widths = columns[0].astype(np.int64), columns[2].astype(np.int64)
    id_at, byte_at, ends = np.cumsum(counts) - counts, np.cumsum(widths) - widths, np.cumsum(sizes, dtype=np.int64)
    cols: list[list] = [[], [], []]
    for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
        at = place[numbers[begin:end]]
        ids = P.ragged(columns[1], id_at[at], counts[at])
        text = P.ragged(columns[3], byte_at[at], widths[at]).tobytes()
        if digests:
            values = len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()
        else:
            values = ids.astype(np.int32), text
        for c, v in zip(cols, values):
            c.append(v)
    if digests:
        kinds, names = [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"]
    else:
        kinds, names = [pa.list_(pa.int32()), pa.binary()], ["ids", "decoded"]
    out = pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[id_col, *names])
    for k in range(0, out.num_rows, 2048):
        yield out.slice(k, 2048)
