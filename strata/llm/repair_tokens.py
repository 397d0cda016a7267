"""Token files compressed by Re-Pair grammars, with random access.

Documents are dealt by ranges of their id, sorted, encoded and cut into blocks of whole documents.
Each block gets a grammar of its own: round by round its frequent neighbouring id pairs are
replaced by nonterminals.  A block is one row of a Parquet table:

==============  ==================================================================
shard, block    place in ascending id order (``shard`` is the range)
start           ids before the block in its shard
n_tokens        ids in the block
doc_ids         ids of its documents, ascending
doc_tokens      tokens of each document, end id included
left, right     the rules, as little-endian uint32: nonterminal ``base + k`` is (left[k], right[k])
expansion       uint32 expansion length of each rule
rounds          first rule of each round (a rule uses ids and rules of earlier rounds only)
sequence        uint32 little-endian symbols of the block
==============  ==================================================================

``start`` is the number of ids before the block in its shard.  Expansion lengths tell where any token lies,
so a reader expands just the symbols it needs: ``read_tokens`` goes through a block in ranges of about
``READ_TOKENS`` ids, ``read_documents`` expands the ranges of the documents it is asked for.

Cases: null text = empty (only the end id); texts of any length are encoded whole (a block holds one document at
least); rows that share an id stay neighbours, by text; an empty table gives an empty file set; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import pieces as P
from strata.llm.common import scratch, text_chunks, text_size, texts_of

BLOCK_TOKENS = 1 << 18
MAX_RULES = 15_000
MIN_COUNT = 6
ROUNDS = 3
CACHE_PIECES = 400_000
READ_TOKENS = 1 << 16
ENCODE_CHARS = 1 << 20
SHARD_CHARS = 64 << 20
SMALL_SHARDS = 1 << 20  # so many rows (shard, ids before it) may be broadcast


class ByteEncoder:
    """Encodes chunks of texts with a byte-level BPE file: distinct pieces once, then by position."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.plain = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.n_ids = self.plain.get_vocab_size(with_added_tokens=True)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        """No piece is known: sorted hashes, and for each its place in the flat ids."""
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        got = [self.encoding.encode_ordinary(p) for p in pieces]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))
        entry = len(self.sizes) + np.arange(len(got))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.entry = np.insert(self.hashes, at, hashes), np.insert(self.entry, at, entry)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        odd = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        plain = [*texts]
        for k in odd:
            plain[k] = ""
        cp, offsets = P.codepoints(plain)
        starts, lengths = P.byte_bpe_pieces(cp, offsets)
        distinct, at, inverse = np.unique(P.span_hashes(cp, starts, lengths), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_PIECES:
            self._forget()
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        if not known.all():
            joined, new = "".join(plain), at[~known]
            self._learn(distinct[~known], [joined[a:a + n] for a, n in zip(starts[new].tolist(), lengths[new].tolist())])
            place = np.searchsorted(self.hashes, distinct)
        entry = self.entry[place][inverse]
        counts = self.sizes[entry]
        ids = P.ragged(self.flat, self.starts[entry], counts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = ends[np.searchsorted(starts, offsets)]
        if odd:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for k in odd:
                parts[k] = np.array(self.plain.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, np.diff(bounds)


@lru_cache(2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def count_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of neighbouring symbols a, b: the place of one occurrence of each distinct pair, how often it
    occurs, and the number of the pair at every place."""
    n = len(a)
    if int(max(a.max(), b.max())) < 1 << 16 and n < 1 << 32:  # pair and place fit one word: a plain sort
        packed = np.sort((a.astype(np.uint64) << np.uint64(48)) | (b.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))
        order, keys = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), packed >> np.uint64(32)
    else:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    number = np.empty(n, np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[starts], np.diff(starts, append=n), number


def compress(ids: np.ndarray, base: int, rounds: int = ROUNDS, min_count: int = MIN_COUNT, max_rules: int = MAX_RULES) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(sequence, left, right, first rule of each round) of a Re-Pair grammar over ``ids``.

    A round counts all neighbouring pairs, takes the most frequent ones, and replaces their
    occurrences from left to right.
    """
    seq = ids.astype(np.uint32)
    left, right, firsts, n_rules = [], [], [], 0
    for r in range(rounds):
        room = max_rules - n_rules
        if len(seq) < 2 * min_count or room <= 0:
            break
        a, b = seq[:-1], seq[1:]
        place_of, counts, number = count_pairs(a, b)
        floor = max(min_count, int(counts.max()) >> (3 * r + 4))
        chosen = np.flatnonzero(counts >= floor)
        if not len(chosen):
            chosen = np.flatnonzero(counts >= min_count)
        if not len(chosen):
            break
        if len(chosen) > room:
            chosen = np.sort(chosen[np.argsort(-counts[chosen], kind="stable")[:room]])
        rule = np.full(len(counts), -1, np.int32)
        rule[chosen] = np.arange(len(chosen), dtype=np.int32)
        which = rule[number]
        hit = which >= 0
        place = np.arange(len(hit), dtype=np.int32)
        run = hit.copy()
        run[1:] &= ~hit[:-1]
        begun = np.maximum.accumulate(np.where(run, place, 0))
        hit &= ((place - begun) & 1) == 0  # of overlapping occurrences every other one
        at = np.flatnonzero(hit)
        firsts.append(n_rules)
        left.append(a[place_of[chosen]])
        right.append(b[place_of[chosen]])
        seq = seq.copy()
        seq[at] = (base + n_rules + which[at]).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        n_rules += len(chosen)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return seq, join(left), join(right), firsts


def expansion_lengths(left: np.ndarray, right: np.ndarray, firsts: list[int], base: int) -> np.ndarray:
    out = np.ones(base + len(left), np.uint32)
    for a, b in zip(firsts, [*firsts[1:], len(left)]):
        out[base + a:base + b] = out[left[a:b]] + out[right[a:b]]
    return out[base:]


def expand(seq: np.ndarray, left: np.ndarray, right: np.ndarray, firsts: list[int], base: int) -> np.ndarray:
    """The ids that a sequence of symbols stands for, undoing round after round."""
    for first in reversed(list(firsts)):
        compound = seq >= base + first
        rule = seq[compound] - (base + first) + first
        width = compound.astype(np.int64) + 1
        start = (np.cumsum(width) - width)[compound]
        seq = np.repeat(seq, width)
        seq[start], seq[start + 1] = left[rule], right[rule]
    return seq


def symbol_ends(seq: np.ndarray, expansion: np.ndarray, base: int) -> np.ndarray:
    """For each symbol of a sequence the number of ids up to its end."""
    compound = seq >= base
    width = np.ones(len(seq), np.int64)
    width[compound] = expansion[seq[compound] - base]
    return np.cumsum(width)


def expand_range(seq: np.ndarray, left: np.ndarray, right: np.ndarray, firsts: list[int], ends: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop`` of a block; only the symbols that cover them are expanded.
    ``ends`` are its ``symbol_ends``."""
    lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    before = int(ends[lo - 1]) if lo else 0
    return expand(seq[lo:hi], left, right, firsts, base)[start - before:stop - before]


class Block:
    """A row of the files, open for reading."""

    def __init__(self, row: dict, base: int):
        self.left, self.right, self.seq, expansion = (np.frombuffer(row[c], "<u4") for c in ("left", "right", "sequence", "expansion"))
        self.firsts, self.base = row["rounds"], base
        self.ends = symbol_ends(self.seq, expansion, base)
        self.doc_ends = np.cumsum(np.array(row["doc_tokens"], np.int64))

    def documents(self, first: int, last: int) -> list[np.ndarray]:
        """The ids of the documents from number ``first`` to ``last``."""
        bounds = np.concatenate([[self.doc_ends[first - 1] if first else 0], self.doc_ends[first:last]])
        ids = expand_range(self.seq, self.left, self.right, self.firsts, self.ends, self.base, int(bounds[0]), int(bounds[-1]))
        bounds = (bounds - bounds[0]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def ranges(self) -> Iterator[tuple[int, int]]:
        """All documents in ranges of about READ_TOKENS ids, one document at least."""
        first = 0
        while first < len(self.doc_ends):
            before = self.doc_ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(self.doc_ends, before + READ_TOKENS, "right")))
            yield first, last
            first = last


_FORMAT = "shard int, block int, start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<int>, left binary, right binary, expansion binary, rounds array<int>, sequence binary"
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("left", pa.binary()), ("right", pa.binary()), ("expansion", pa.binary()), ("rounds", pa.list_(pa.int32())), ("sequence", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` to each, and write the blocks to ``path``."""
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_size(docs, text_col) // SHARD_CHARS)
    src = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    dealt = src.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        encoder = byte_encoder(tokenizer)
        doc_ids, sizes, parts, total, start = [], [], [], 0, 0

        def emit() -> pa.RecordBatch:
            base = encoder.n_ids
            seq, left, right, firsts = compress(np.concatenate(parts), base)
            row = {"shard": shard, "block": block, "start": start, "n_tokens": total, "doc_ids": doc_ids, "doc_tokens": np.concatenate(sizes), "left": left.astype("<u4").tobytes(), "right": right.astype("<u4").tobytes(), "expansion": expansion_lengths(left, right, firsts, base).astype("<u4").tobytes(), "rounds": firsts, "sequence": seq.astype("<u4").tobytes()}
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            for chunk in text_chunks(batch, 1, ENCODE_CHARS):
                ids, counts = encoder(texts_of(chunk, 1))
                parts.append(np.insert(ids, np.cumsum(counts), np.uint32(end_id)))
                sizes.append((counts + 1).astype(np.int32))
                doc_ids += chunk.column(0).to_pylist()
                total += len(parts[-1])
                if total >= BLOCK_TOKENS:
                    yield emit()
                    block, start, doc_ids, sizes, parts, total = block + 1, start + total, [], [], [], 0
        if doc_ids:
            yield emit()

    dealt.mapInArrow(run, _FORMAT).write.option("compression", "zstd").parquet(path)


def open_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The written blocks; ``start`` becomes the number of ids of all documents before each block.

    Only one row per shard is summed up, a number that ``write_tokens`` derives from the size of the texts;
    up to ``SMALL_SHARDS`` of them are broadcast, so the blocks do not move.
    """
    blocks = spark.read.schema(_FORMAT).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    last = blocks.agg(F.max("shard").alias("s")).first()["s"]
    starts = F.broadcast(shards) if (last or 0) < SMALL_SHARDS else shards
    return blocks.join(starts, "shard").withColumn("start", F.col("start") + F.col("shard_start")).drop("shard_start")


_OUT = "doc_id bigint, start bigint, n_tokens bigint, "


def _rows(block: Block, row: dict, first: int, last: int, digests: bool) -> pa.RecordBatch:
    docs = block.documents(first, last)
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = row["start"] + block.doc_ends[first:last] - sizes
    ids = pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()) if digests else pa.array(docs, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][first:last], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), ids], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])


def read_tokens(spark: SparkSession, path: str, tokenizer: str, digests: bool = False) -> DataFrame:
    """Decode the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids``, or with ``digests`` ``ids_crc32`` of the ids as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = byte_encoder(tokenizer).n_ids
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                block = Block(row, base)
                for first, last in block.ranges():
                    yield _rows(block, row, first, last, digests)

    return open_blocks(spark, path).drop("shard", "block", "n_tokens").mapInArrow(run, _OUT + ("ids_crc32 bigint" if digests else "ids array<bigint>"))


def read_documents(spark: SparkSession, path: str, tokenizer: str, wanted: DataFrame, id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """The rows of ``read_tokens`` for the documents that ``wanted`` names (once, however often it names
    them): blocks without one are not expanded, of the others only the documents' own ranges."""
    blocks = open_blocks(spark, path)
    listed = blocks.select("shard", "block", F.posexplode("doc_ids").alias("at", "id"))
    asked = listed.join(wanted.select(wanted[id_col].cast("bigint").alias("id")), "id", "left_semi")
    asked = asked.groupBy("shard", "block").agg(F.sort_array(F.collect_list("at")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = byte_encoder(tokenizer).n_ids
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                block = Block(row, base)
                for k in row["wanted"]:
                    yield _rows(block, row, k, k + 1, digests)

    found = blocks.join(asked, ["shard", "block"]).drop("shard", "block", "n_tokens")
    return found.mapInArrow(run, _OUT + ("ids_crc32 bigint" if digests else "ids array<bigint>"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back (digests)."""
    path = scratch(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id, id_col=id_col, text_col=text_col)
    return read_tokens(docs.sparkSession, path, tokenizer, digests=True)
