import random
import zlib

import numpy as np
from helpers import ODD_TEXTS, frame, odd_documents
from tokenizers import Tokenizer

from strata.llm import repair_tokens as R
from strata.llm.queries import QUERIES, tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")


def test_query_matches_the_library(spark):
    folder = "/root/testdata/sf0.01"
    tok, at = Tokenizer.from_file(FILE), 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op10_repair_token_files"](spark, folder).collect()}
    assert len(rows) == len(texts)
    for k in sorted(texts):
        ids = tok.encode(texts[k] or "", add_special_tokens=False).ids + [2]
        r = rows[k]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_strange_texts_in_many_small_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    alphabet = "ab's' 'tre'll 've \n\té1٣²½,.!　漢字😀ß "
    texts = ODD_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["<|endoftext|>", "x <|endoftext|><|endoftext|> y", "ab " * 20_000]
    monkeypatch.setattr(R, "BLOCK_TOKENS", 500)
    docs = frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)]).repartition(5)
    path = str(tmp_path / "files")
    R.write_tokens(docs, path, FILE, end_id=2, shards=4)
    got = {r["doc_id"]: r for r in R.read_tokens(spark, path, FILE).collect()}
    tok, at = Tokenizer.from_file(FILE), 0
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[k]["start"], got[k]["ids"]) == (at, ids), t
        at += len(ids)


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 50, 40)
    for ids in (np.zeros(0, np.uint32), np.zeros(1000, np.uint32), np.tile(phrase, 300).astype(np.uint32), rng.integers(0, 200, 5000).astype(np.uint32), np.array([7] * 5, np.uint32)):
        seq, left, right, firsts = R.compress(ids, 50_257, rounds=6)
        assert np.array_equal(R.expand(seq, left, right, firsts, 50_257), ids)
        lengths = R.expansion_lengths(left, right, firsts, 50_257)
        assert len(left) == 0 or len(seq) < len(ids)
        for a, b in ((0, 1), (3, 77), (len(ids) // 2, len(ids))):
            if b <= len(ids):
                ends = R.symbol_ends(seq, lengths, 50_257)
                assert np.array_equal(R.expand_range(seq, left, right, firsts, ends, 50_257, a, b), ids[a:b])


def test_pairs_are_counted_exactly():
    """Every frequent pair gets a rule, however many others there are; small and large symbols alike."""
    from collections import Counter

    rng = np.random.default_rng(3)
    for top in (3000, 90_000):
        ids = rng.zipf(1.2, 40_000).clip(1, top).astype(np.uint32)
        place, counts, number = R.count_pairs(ids[:-1], ids[1:])
        want = Counter(zip(ids[:-1].tolist(), ids[1:].tolist()))
        assert {(int(ids[p]), int(ids[p + 1])): int(c) for p, c in zip(place, counts)} == want
        assert all((ids[k], ids[k + 1]) == (ids[place[n]], ids[place[n] + 1]) for k, n in enumerate(number.tolist()[:500]))
        _, left, right, _ = R.compress(ids, 100_000, rounds=1, min_count=6)
        assert set(zip(left.tolist(), right.tolist())) == {p for p, c in want.items() if c >= max(6, max(want.values()) >> 4)}


def test_documents_by_id(spark, tmp_path, monkeypatch):
    """Only the ranges of the wanted documents are expanded; repeated and unknown ids are harmless."""
    monkeypatch.setattr(R, "BLOCK_TOKENS", 2000)
    monkeypatch.setattr(R, "READ_TOKENS", 100)
    docs = frame(spark, [(k, f"text {k} " * (k % 50), "en", "s", 0) for k in range(400)] + [(7, "again", "en", "s", 0)])
    path = str(tmp_path / "files")
    R.write_tokens(docs, path, FILE, shards=3)
    every = R.read_tokens(spark, path, FILE).collect()
    wanted = spark.createDataFrame([(7,), (7,), (399,), (200,), (12_345,), (None,)], "doc_id bigint")
    got = R.read_documents(spark, path, FILE, wanted).collect()
    key = lambda rows: sorted((r["doc_id"], r["start"], r["n_tokens"], tuple(r["ids"])) for r in rows)
    assert len(got) == 4 and key(got) == key(r for r in every if r["doc_id"] in (7, 399, 200))


def test_long_text_and_clashing_names(spark, tmp_path):
    """A text of several chunks; columns named as the files' own."""
    long = "some words and more of them 12 345 " * 70_000
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, None, 6, "y")], "doc_id bigint, text string, start int, ids_crc32 string")
    rows = {r["doc_id"]: r for r in R.round_trip(docs, FILE).collect()}
    ids = Tokenizer.from_file(FILE).encode(long, add_special_tokens=False).ids + [2]
    assert (rows[1]["start"], rows[1]["n_tokens"], rows[1]["ids_crc32"]) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert (rows[2]["start"], rows[2]["n_tokens"]) == (len(ids), 1)


def test_repeated_text_shrinks():
    ids = np.tile(np.arange(64, dtype=np.uint32), 500)
    assert len(R.compress(ids, 50_257)[0]) < len(ids) / 3


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    rows = R.round_trip(docs, FILE).collect()
    assert len(rows) == docs.count()
    assert sorted(r["start"] for r in rows)[0] == 0
    spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert R.round_trip(docs.limit(0), FILE).count() == 0
