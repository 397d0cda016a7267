import hashlib
import os
import random

from helpers import ODD_TEXTS, frame, odd_documents
from tokenizers import Tokenizer

from strata.llm import word_table_bpe as W
from strata.llm.queries import QUERIES, tokenizer_file

FILE = tokenizer_file("word_bpe_49k.json")


def want(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def test_query_matches_the_library(spark):
    folder = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(FILE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op9_word_table_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = want(tok, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_strange_texts_match_the_library(spark, monkeypatch):
    rng = random.Random(4)
    alphabet = "ab'sS' 'tre'LL 've \n\té1٣²½,.!　漢字😀ßİΣς́éﬁ<|endoftext|>"
    texts = ODD_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["<|endoftext|>", "x<|startoftext|><|endoftext|>Y's", "a" * 20_000, "ab " * 5000]
    docs = frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    tok = Tokenizer.from_file(FILE)
    monkeypatch.setattr(W, "CACHE_WORDS", 100)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in W.encode(docs, FILE, buckets=5).collect()}
    assert got == {k: want(tok, t) for k, t in enumerate(texts)}


def test_every_letter_is_normalised_like_the_library(spark):
    import unicodedata

    tok = Tokenizer.from_file(FILE)
    # letters that this Python's and the library's Unicode tables both know
    chars = [chr(c) for c in range(0x20, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    encoder, bad = W._load(FILE)[0], []
    for c in chars:
        joined, starts, lengths, _, _ = W.split_words([c], None)
        mine = [i for a, n in zip(starts.tolist(), lengths.tolist()) for i in encoder.encode(joined[a:a + n], add_special_tokens=False).ids]
        if mine != tok.encode(c, add_special_tokens=False).ids:
            bad.append(c)
    assert not bad


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert W.encode(docs, FILE, digests=True).count() == docs.count()
    assert W.encode(docs.limit(0), FILE, digests=True).count() == 0
    null = [r for r in W.encode(docs, FILE).collect() if r["doc_id"] == 0][0]
    assert null["ids"] == [] and null["decoded"] == ""


def test_long_text_and_clashing_names(spark):
    """A text of several chunks; columns named as the result's own."""
    long = "Some words and MORE of them 12 345 " * 40_000
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, None, 6, "y")], "doc_id bigint, text string, block int, ids_sha256 string")
    rows = {r["doc_id"]: r for r in W.encode(docs, FILE, digests=True).collect()}
    ids, text = want(Tokenizer.from_file(FILE), long)
    assert rows[1]["n_tokens"] == len(ids) and rows[1]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert rows[2]["n_tokens"] == 0


def test_positions_do_not_move(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = W.encode(docs, FILE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" in plan  # words there and back; the pieces


def test_only_encoding_tasks_hold_the_tokenizer_and_without_its_threads(spark):
    """Workers are reused: what one holds after its task counts in all later stages."""
    rng = random.Random(7)
    docs = frame(spark, [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(400)), "en", "s", 0) for k in range(64)]).repartition(8)
    assert W.encode(docs, FILE, digests=True).count() == 64

    def held(batches):
        import pyarrow as pa
        from strata.llm import word_table_bpe as worker

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([worker._load.cache_info().currsize]), pa.array([len(os.listdir("/proc/self/task"))])], names=["loaded", "threads"])

    rows = spark.range(0, 64, 1, 16).mapInArrow(held, "loaded bigint, threads bigint").collect()
    assert max(r["loaded"] for r in rows) == 0
    assert os.cpu_count() < 4 or max(r["threads"] for r in rows) < os.cpu_count()


def test_a_task_gives_freed_memory_back(spark):
    """Small objects that keep the heap from shrinking by itself, as a block's words do."""
    from strata.llm.common import give_back

    def sizes(batches):
        import pyarrow as pa

        def size():
            return int(next(x for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")).split()[1]) // 1024

        for _ in batches:
            before = size()
            held = [bytes(1000) for _ in range(200_000)]
            last = held[::1000]
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([before]), pa.array([size()])], names=["pid", "before", "full"])
            del held, last

    spent = spark.range(0, 1, 1, 1).mapInArrow(give_back(sizes), "pid bigint, before bigint, full bigint").collect()[0]
    assert spent["full"] > spent["before"] + 150
    later = spark.range(0, 16, 1, 8).mapInArrow(sizes, "pid bigint, before bigint, full bigint").collect()
    same = [r["before"] for r in later if r["pid"] == spent["pid"]]
    assert not same or min(same) < spent["before"] + 60
