"""BPE encoding and decoding through a table of distinct words.

The texts are split into words in Spark tasks, block by block: a block keeps, for each document, the
positions of its words in the block's own dictionary.  The dictionaries, dealt out by a hash of the
word into ``buckets``, meet in one shuffle where each distinct word of a bucket is encoded once.  Decoding
is a join: the words' ids, exploded with their positions, meet the table (id, piece) of the vocabulary,
which is broadcast (its size is the vocabulary's), and a word's pieces are put together by position.
Ids and pieces come back to their block by (block, bucket) and to their place by position.

Blocks are written bucketed by block: positions and texts are never shuffled, only dictionaries are, there
and back, and a word that fills the corpus occurs once in a block's dictionary, so no key is hot.  The numbers of
blocks and buckets come from the size of the texts.  Memory in a task is bounded by a block
(``BLOCK_CHARS``; one text at least) and by ``CACHE_WORDS`` encoded words.  Python workers outlive their tasks, and what they
hold counts in every later stage: only tasks that encode load the tokenizer, word by word in the task's own thread.

Cases: null text = empty text (no ids; digests of the empty string); texts of any length are encoded whole;
repeated rows are encoded one by one, and rows without an id too; an empty table gives an empty result; extra
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import pieces as P
from strata.llm.common import bucketed, give_back, pack, text_chunks, text_size, texts_of, unpack
from strata.llm.id_join import joined_bytes, units, vocabulary

BLOCK_CHARS = 8 << 20
CACHE_WORDS = 100_000


@lru_cache(2)
def _encoder(path: str) -> object:
    """The word encoder."""
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.normalizer = None  # the words are normalised when the texts are split
    return encoder


@lru_cache(2)
def _load(path: str) -> tuple[object, list[str], re.Pattern | None]:
    """The word encoder, the piece of each id, and a pattern of the special tokens.  For the driver: tasks get what they
    need of it with their function."""
    spec = json.load(open(path, encoding="utf-8"))
    if spec["decoder"] is not None or spec["model"]["end_of_word_suffix"] != "</w>":
        raise ValueError("a word-level BPE file without a decoder is needed")
    special = [t["content"] for t in spec["added_tokens"]]
    encoder = _encoder(path)
    names = [""] * encoder.get_vocab_size(with_added_tokens=True)
    for name, i in encoder.get_vocab(with_added_tokens=True).items():
        names[i] = name
    return encoder, names, re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter (no final-sigma rule)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split_words(texts: list[str], special: re.Pattern | None) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined normalised texts; starts, lengths and hashes of the words; words before each text."""
    segments: list[str] = []
    whole: list[int] = []  # segments that are one special token
    first = [0]
    for text in texts:
        if special and "<|" in text and special.search(text):
            for part in special.split(text):
                if special.fullmatch(part):
                    whole.append(len(segments))
                    segments.append(part)
                elif part:
                    segments.append(normalise(part))
        else:
            segments.append(normalise(text))
        first.append(len(segments))
    cp, offsets = P.codepoints(segments)
    starts, lengths = P.word_bpe_pieces(cp, offsets)
    if whole:
        drop = np.zeros(len(starts), bool)
        for k in whole:
            a, b = np.searchsorted(starts, offsets[[k, k + 1]])
            lengths[a] = offsets[k + 1] - offsets[k]
            drop[a + 1:b] = True
        starts, lengths = starts[~drop], lengths[~drop]
    return "".join(segments), starts, lengths, P.span_hashes(cp, starts, lengths), np.searchsorted(starts, offsets[first])


_BLOCK = "block bigint, ids array<bigint>, positions binary, words array<struct<bucket:int,names:binary>>"


def blocks(docs: DataFrame, tokenizer: str, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """One row per block: its documents, the positions of their words, and its dictionary by bucket."""
    src = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    special = _load(tokenizer)[2]
    part = pa.struct([("bucket", pa.int32()), ("names", pa.binary())])
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("positions", pa.binary()), ("words", pa.list_(part))])

    def packed(block: int, ids: list, sizes: list, parts: list, words: dict[int, str]) -> pa.RecordBatch:
        distinct, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        # numbered by falling frequency, which packs best; a bucket lists its words in that order
        ranked = np.argsort(-np.bincount(inverse, minlength=len(distinct)), kind="stable")
        rank = np.empty(len(distinct), np.uint32)
        rank[ranked] = np.arange(len(distinct), dtype=np.uint32)
        distinct = distinct[ranked]
        bucket = ((distinct >> np.uint64(7)) % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        names = [words[h] for h in distinct[order].tolist()]
        dealt = [{"bucket": k, "names": zstandard.compress("\n".join(names[edges[k]:edges[k + 1]]).encode(), 3)} for k in np.flatnonzero(np.diff(edges)).tolist()]
        row = {"block": block, "ids": ids, "positions": pack(np.array(sizes, np.uint32), rank[inverse], bucket), "words": dealt}
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, sizes, parts, words, chars = [], [], [], {}, 0
        for batch in batches:
            for chunk in text_chunks(batch, 1):
                joined, starts, lengths, hashes, before = split_words(texts_of(chunk, 1), special)
                distinct, at = np.unique(hashes, return_index=True)
                for h, a, n in zip(distinct.tolist(), starts[at].tolist(), lengths[at].tolist()):
                    if h not in words:
                        words[h] = joined[a:a + n]
                ids += chunk.column(0).to_pylist()
                sizes += np.diff(before).tolist()
                parts.append(hashes)
                chars += len(joined)
                if chars >= BLOCK_CHARS:
                    yield packed(block, ids, sizes, parts, words)
                    block, ids, sizes, parts, words, chars = block + 1, [], [], [], {}, 0
        if ids:
            yield packed(block, ids, sizes, parts, words)

    return src.mapInArrow(give_back(run), _BLOCK)


def encode_words(words: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """(block, bucket, ids of each word) of dictionaries (block, bucket, names).
    All rows of a bucket meet in one task, where a word seen before is looked up."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("ids", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = _encoder(tokenizer), {}  # the ids of a word as bytes, smaller than lists
        for batch in batches:
            for row in batch.to_pylist():
                names = zstandard.decompress(row["names"]).decode().split("\n")
                new = [w for w in names if w not in known]
                if len(known) + len(new) > CACHE_WORDS:
                    known, new = {}, names
                # not as a batch: its threads, one for each core of the machine, keep memory of their own
                known.update((w, array("i", encoder.encode(w, add_special_tokens=False).ids).tobytes()) for w in new)
                got = [known[w] for w in names]
                ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4)]).astype(np.int32)
                flat = np.frombuffer(b"".join(got), np.int32)
                ids = pa.ListArray.from_arrays(np.array([0, len(got)], np.int32), pa.ListArray.from_arrays(ends, flat))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["bucket"]], pa.int64()), ids], schema=schema)

    dealt = words.select("block", "bucket", "names").repartition(buckets, "bucket")
    return dealt.mapInArrow(give_back(run), "block bigint, bucket bigint, ids array<array<int>>")


@lru_cache(2)
def _decimals(n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All decimal ids, each with a blank behind it, as bytes; starts; lengths."""
    spelled = [f"{i} ".encode() for i in range(n_ids)]
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes, sizes


def _pieces(spark: SparkSession, tokenizer: str) -> DataFrame:
    """The vocabulary as a table: each id's piece with the blank that decoding puts behind it."""
    names = _load(tokenizer)[1]
    return vocabulary(spark, list(range(len(names))), [f"{x} ".encode() for x in names])


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, buckets: int | None = None) -> DataFrame:
    """Encode every text as the tokenizers library does (no special tokens added) and decode it again.

    Returns one row per input row: ``id_col`` and either ``ids`` (array<int>) with ``decoded``, or,
    with ``digests``, ``n_tokens``, ``ids_sha256`` (of the decimal ids with a blank between) and
    ``decoded_sha256``.  ``buckets`` defaults to four times the root of the number of blocks.
    """
    homes = text_size(docs, text_col) // BLOCK_CHARS + 1
    buckets = buckets or math.ceil(4 * math.sqrt(homes))
    held = bucketed(blocks(docs, tokenizer, buckets, id_col, text_col), "bpe-blocks", "block", max(homes, 4))
    words = held.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.names")
    each = encode_words(words, tokenizer, buckets).select(F.col("block").alias("k1"), F.col("bucket").alias("k2"), F.posexplode("ids").alias("word", "ids"))
    each = joined_bytes(each.select("k1", "k2", "word", F.posexplode("ids").alias("p", "id")), _pieces(docs.sparkSession, tokenizer))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, bucket, counts, ids, sizes, flat in units(batches):
            found = pack(counts.astype(np.uint32), ids.astype(np.uint32), sizes.astype(np.uint32), flat)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int64()), pa.array([found], pa.binary())], names=["block", "bucket", "found"])

    back = each.mapInArrow(give_back(packed), "block bigint, bucket bigint, found binary").repartition(max(homes, 4), "block")
    back = back.groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("found"))
    joined = held.select("block", "ids", "positions").join(back, "block", "left").drop("block")
    n_ids = len(_load(tokenizer)[1])
    result = f"`{id_col}` bigint, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield from placed(batch.slice(r, 1).to_pylist()[0], n_ids, id_col, digests)

    return joined.mapInArrow(give_back(run), result)


def placed(row: dict, n_ids: int, id_col: str, digests: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a block: ids and pieces in the places of its words."""
    sizes, ranks, bucket = unpack(row["positions"])
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    got = [unpack(w["found"]) for w in sorted(row["found"] or [], key=lambda w: w["bucket"])]
    counts, flat, widths, text = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.uint32) for k in range(4))
    counts, widths = counts.astype(np.int64), widths.astype(np.int64)
    id_at, text_at, ends = np.cumsum(counts) - counts, np.cumsum(widths) - widths, np.cumsum(sizes, dtype=np.int64)
    decimals, decimal_at, decimal_sizes = _decimals(n_ids)
    cols: list[list] = [[], [], []]
    for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
        at = place[ranks[begin:end]]
        ids = P.ragged(flat, id_at[at], counts[at])
        decoded = P.ragged(text, text_at[at], widths[at])[:-1].tobytes()
        if digests:
            spelled = P.ragged(decimals, decimal_at[ids], decimal_sizes[ids])[:-1].tobytes()
            values = len(ids), hashlib.sha256(spelled).hexdigest(), hashlib.sha256(decoded).hexdigest()
        else:
            values = ids.astype(np.int32), decoded.decode()
        for c, v in zip(cols, values):
            c.append(v)
    if digests:
        kinds, names = [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"]
    else:
        kinds, names = [pa.list_(pa.int32()), pa.string()], ["ids", "decoded"]
    out = pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[id_col, *names])
    for k in range(0, out.num_rows, 2048):
        yield out.slice(k, 2048)
