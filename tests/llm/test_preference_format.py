from helpers import oracle, same_rows

from strata.llm import preference_format as R
from strata.llm.queries import ORACLE, QUERIES


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, pair_id string")


def test_query_matches_sql(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert same_rows(QUERIES["op5_preference_format"](spark, folder), oracle(ORACLE["op5_preference_format"], folder))


def test_common_prefix_and_masks(spark):
    rows = [(0, 0, "user", "hi", None), (0, 1, "assistant", "yes", None), (0, 2, "user", "ok", None), (1, 0, "user", "hi", None), (1, 1, "assistant", "no!", None)]
    got = R.format_preferences(R.pairs_by_id(conversations(spark, rows))).collect()[0]
    assert got["n_prompt_turns"] == 1
    assert got["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert got["chosen"] == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nok<|im_end|>\n"
    assert got["rejected"] == "<|im_start|>assistant\nno!<|im_end|>\n"
    assert got["chosen_mask"] == "23:0,14:1,18:0,13:0" or sum(int(p.split(":")[0]) for p in got["chosen_mask"].split(",")) == len(got["chosen"])
    at, trained = 0, ""
    for part in got["chosen_mask"].split(","):
        n, flag = part.split(":")
        trained += got["chosen"][at:at + int(n)] if flag == "1" else ""
        at += int(n)
    assert trained == "yes<|im_end|>\n"


def test_odd_conversations(spark):
    rows = [(0, 0, None, None, None), (1, 0, "unknown", "", None),  # null role and text equal their stand-ins
            (2, 0, "user", "alone", None),  # no partner
            (4, 0, "user", "same", None), (5, 0, "user", "same", None), (4, 0, "user", "same", None), (5, 0, "user", "same", None),
            (6, 3, "user", "late", None), (7, 0, "user", "late", None), (7, 1, "assistant", "x" * 50_000, None), (None, 0, "user", "lost", None)]
    got = {r["pair_id"]: r for r in R.format_preferences(R.pairs_by_id(conversations(spark, rows))).collect()}
    assert set(got) == {0, 2, 3}
    assert (got[0]["n_prompt_turns"], got[0]["chosen"], got[0]["rejected"], got[0]["chosen_mask"]) == (1, "", "", "")
    assert got[2]["n_prompt_turns"] == 2
    assert got[3]["n_prompt_turns"] == 1 and len(got[3]["rejected"]) > 50_000
    assert R.format_preferences(R.pairs_by_id(conversations(spark, []))).count() == 0


def test_negative_ids_pair_up(spark):
    rows = [(k, 0, "user", f"of {k}", None) for k in (-3, -2, -1, 0, 1)]
    got = {r["pair_id"]: (r["chosen"], r["rejected"]) for r in R.format_preferences(R.pairs_by_id(conversations(spark, rows))).collect()}
    shown = lambda k: f"<|im_start|>user\nof {k}<|im_end|>\n"
    assert got == {-1: (shown(-2), shown(-1)), 0: (shown(0), shown(1))}


def test_only_native_operators(spark):
    plan = QUERIES["op5_preference_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
