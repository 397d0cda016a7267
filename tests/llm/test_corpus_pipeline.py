"""The pipeline against a plain version of its stages."""

import hashlib

import corpus_pipeline
from helpers import ODD_TEXTS, frame
from test_jaccard_join import brute as jaccard
from test_quality_rules import brute as measure
from tokenizers import Tokenizer

from strata.llm import pii_crf as C
from strata.llm import temperature_mix as M
from strata.llm.queries import tokenizer_file


def rejected(m):
    return (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"] or 10 * m["n_dup_lines"] > 4 * m["n_lines"]
            or 10 * m["n_upper"] > 3 * (m["n_upper"] + m["n_lower"]) or 2 * m["n_exclaims"] > m["n_words"] or 20 * m["n_distinct_words"] < m["n_words"]
            or m["word_chars"] > 25 * m["n_words"] or m["word_chars"] < 2 * m["n_words"])


def test_stages_match_a_plain_version(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = frame(spark, [(1000 + k, t, None, None, 0) for k, t in enumerate(ODD_TEXTS)]).select(*source.columns)
    source.unionByName(extra).unionByName(source.limit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "personal_data", "mixing", "token_ids"]

    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    rows = [r for r in docs.collect() if not rejected(measure(r["text"]))]
    assert kept.columns == columns and sorted(map(str, kept.collect())) == sorted(map(str, rows))

    single = stages["near_duplicates"](spark, kept, str(tmp_path))
    groups = jaccard({r["doc_id"]: r["text"] for r in rows}, 5, 80)
    first = {i for i, (_, root) in groups.items() if i == root}
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(first)

    private = stages["personal_data"](spark, single, str(tmp_path))
    crf = C.train(single)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    masked = {i: C.mask_text(t, C.scan(crf, [t])[0][1]) for i, t in texts.items()}
    assert private.columns == columns and {r["doc_id"]: r["text"] for r in private.collect()} == masked
    assert not any(C.base_spans(t) for t in masked.values())

    mixed = stages["mixing"](spark, private, str(tmp_path))
    copies = {r["doc_id"]: r["copies"] for r in M.mix(private, M.Target(max_repeats=4), seed=7).collect()}
    ids = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == columns and set(ids) == set(masked) and {i: ids.count(i) for i in ids} == copies

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = stages["token_ids"](spark, mixed, str(tmp_path)).collect()
    assert len(got) == len(ids)
    for r in got:
        enc = tok.encode(masked[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(enc), hashlib.sha256(" ".join(map(str, enc)).encode()).hexdigest())


def test_run_is_the_stages_in_a_row(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(rows[0].asDict())


def test_empty_table_and_clashing_columns(spark, tmp_path):
    """No stage crashes on an empty table; extra columns keep their values up to the last stage."""
    text = "A plain line of words that no rule rejects , number %d of several with its own ending %d"
    rows = [(k, text % (k, k * k) + "".join(f" w{k}x{j}" for j in range(30)), "en", "s", 5, k, k + 1, f"v{k}") for k in range(12)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies int, threshold int, component_id string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, str(tmp_path))
            assert left.columns == docs.columns, name
        assert set(map(tuple, left.drop("text").collect())) == set(map(tuple, docs.drop("text").collect()))
        assert corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).count() == left.count()
