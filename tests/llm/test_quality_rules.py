import re

from helpers import ODD_TEXTS, frame, odd_documents, oracle, same_rows

from strata.llm import quality_rules as Q
from strata.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows: dict = {}
    for i in range(n - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in Q.SYMBOLS for c in text), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines), "n_distinct_words": len(set(words)), "n_upper": len(re.findall("[A-Z]", text)),
            "n_lower": len(re.findall("[a-z]", text)), "n_exclaims": text.count("!")}


def test_measurements_match_brute_force():
    texts = [t or "" for t in ODD_TEXTS] + ["p q r s t u p q r s t v", "a a a a a a a", "a a a a a", "", "L! <#> L!\nL! <#> L!", "x\r\nx\r\n"]
    got = Q.measure(texts)
    assert [{m: int(got[m][k]) for m in Q.MEASURES} for k in range(len(texts))] == [brute(t) for t in texts]


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert same_rows(QUERIES["op1_quality_rules"](spark, folder), oracle(ORACLE["op1_quality_rules"], folder))


def test_odd_rows_and_clashing_columns(spark):
    docs = odd_documents(spark).withColumnRenamed("lang_pred", "N_Words").withColumnRenamed("score", "fail_bits")
    rows = Q.ledger(docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    for r in rows:
        want = brute(r["text"])
        assert {m: r[m] for m in Q.MEASURES} == want
        assert bool(r["fail_bits"] & Q.BIT["few_words"]) == (want["n_words"] < 10)
    assert Q.ledger(docs.limit(0)).count() == 0
    kept = Q.keep_clean(docs)
    assert kept.columns == docs.columns


def test_policies_and_ablations_are_bitwise(spark):
    good = "This is a plain text of more than ten words without any trouble at all "
    docs = frame(spark, [(1, good, "en", "s", 1), (2, good + "a # b # c # d # e # f #", "en", "s", 1), (3, "short #", "en", "s", 1), (4, "short", "en", "s", 1)])
    ledger = Q.ledger(docs)
    assert [r["doc_id"] for r in ledger.where(Q.passes("v1")).collect()] == [1]
    assert sorted(r["doc_id"] for r in ledger.where(Q.passes("v1", without="symbols")).collect()) == [1, 2]
    found = {(r["policy"], r["rule"]): (r["n_failed"], r["n_only"], r["n_kept"], r["n_kept_without"]) for r in Q.ablations(ledger).collect()}
    assert found["v1", "symbols"] == (2, 1, 1, 2)
    assert found["v1", "few_words"] == (2, 1, 1, 2)
    assert found["base", "few_words"] == (2, 2, 2, 4)
    assert set(found) == {(p, r) for p, rules in Q.POLICIES.items() for r in rules}


def test_verdicts_follow_the_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in rows)
