import random
import re

import numpy as np
import pytest
from helpers import ODD_TEXTS, frame, odd_documents

from strata.llm import jaccard_join as J
from strata.llm.queries import QUERIES


def grams(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(texts, n, percent):
    sets = {i: grams(t, n) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a1, b1 = find(a), find(b)
                    root[max(a1, b1)] = min(a1, b1)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def corpus(seed, groups=14, copies=14):
    """Groups of near copies around the threshold, exact copies, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(40)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 12, 30, 60, 150]))]
        if g % 3 == 0:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(copies):
            edited = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(edited))
                edited[at:at + rng.choice([0, 1])] = [word()]
            texts.append(" ".join(w.upper() if rng.random() < 0.02 else w for w in edited))
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2), (3, 90, 3), (2, 50, 4)])
def test_components_match_brute_force(spark, n, percent, seed):
    texts = corpus(seed)
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    assert result(J.jaccard_components(docs, n=n, percent=percent)) == brute(texts, n, percent)


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert result(QUERIES["op8_ngram_jaccard_join"](spark, folder)) == brute(texts, 3, 90)


def test_links_that_no_pivot_has(spark):
    """Lists whose first pivot is near nobody still give the links among the others."""
    shared = [f"s{k}" for k in range(40)]
    far = " ".join(shared[:14] + [f"x{k}" for k in range(26)])
    near = [" ".join(shared + [f"t{k}" for k in range(30)] + [f"u{j}"]) for j in range(2)]
    texts = {0: far, 1: near[0], 2: near[1]}
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    want = brute(texts, 3, 90)
    assert want[2][1] == 1 and result(J.jaccard_components(docs)) == want


def test_every_linked_pair_passes_in_some_list(spark):
    """The lists with their filters lose no link: checked pair by pair, without the pivots."""
    from pyspark.sql import functions as F
    texts = corpus(7, groups=8, copies=10)
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in texts.items()])
    for n, percent in ((3, 90), (5, 80)):
        sets = J._sets(docs, n, percent, "doc_id", "text", True).where("n > 0").withColumnRenamed("doc_id", "rep")
        lists = J._sketched(J._banded(J.index_lists(sets, percent), percent), sets, "rep", "a_")
        names = ("rep", "n", "pos", "visitor")
        a = lists.select("hash", "band", *[F.col(c).alias(f"a_{c}") for c in names], *[f"a_p{k}" for k in range(J.WORDS)])
        b = lists.select("hash", "band", *[F.col(c).alias(f"b_{c}") for c in names], *[F.col(f"a_p{k}").alias(f"b_p{k}") for k in range(J.WORDS)])
        both = a.join(b, ["hash", "band"]).where("a_rep < b_rep and a_visitor + b_visitor < 2")
        met = {(r[0], r[1]) for r in both.where(J._possible(percent) & J._near(percent, "a_n", "b_n")).select("a_rep", "b_rep").distinct().collect()}
        own = {i: grams(t, n) for i, t in texts.items()}
        linked = {(x, y) for x in own for y in own if x < y and own[x] and own[y] and 100 * len(own[x] & own[y]) >= percent * len(own[x] | own[y])}
        assert linked and linked <= met


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = J.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got == brute(dict(enumerate(ODD_TEXTS)), 3, 90)
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 103), (103, 101), (5, 5)], "a bigint, b bigint")
    assert {r["id"]: r["root"] for r in J.components(edges).collect()} == {**{k: 0 for k in range(1, 61)}, 101: 100, 103: 100}


def test_prefix_length_is_exact():
    for percent in (50, 80, 90):
        for size in range(1, 400):
            need = -(-percent * size // 100)
            assert J.prefix_length(size, percent) == size - need + 1
    assert all(np.all(np.diff(s.astype(float)) > 0) for s in J.shingle_sets(["a b c d e f", "b a b a b a b"], 3))


def test_unlike_texts_under_one_id(spark):
    """They are documents of their own: nothing is linked through the id, nothing is lost."""
    word = lambda k: " ".join(f"{k}w{j}" for j in range(30))
    rows = [(1, word("a"), 0), (1, word("b"), 1), (2, word("a"), 2), (3, word("b"), 3), (4, word("c"), 4), (4, word("c"), 5), (5, None, 6), (5, None, 7), (None, word("a"), 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, hi int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs).collect())
    assert got == sorted([("1", 28, 1), ("1", 28, 1), ("2", 28, 1), ("3", 28, 1), ("4", 28, 4), ("4", 28, 4), ("5", 0, 5), ("5", 0, 5), ("None", 28, 1)])
    kept = J.keep_first(docs, n=3, percent=90)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(1, word("a")), (1, word("b")), (4, word("c")), (5, None), (None, word("a"))]))


def test_ids_do_not_connect_components(spark):
    """2 and 3 share nothing, though both are linked with a text of id 1: their rows have components 1, of different texts."""
    a, b = [f"a{j}" for j in range(60)], [f"b{j}" for j in range(60)]
    rows = [(10, " ".join(a), 0), (10, " ".join(b), 0), (2, " ".join(a[:59] + ["x"]), 0), (3, " ".join(b[:59] + ["y"]), 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int")
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(docs).collect() if r["doc_id"] != 10}
    assert got == {2: 2, 3: 3}
    assert sorted(r["doc_id"] for r in J.keep_first(docs, n=3, percent=90).collect()) == [2, 3]


def test_long_text_and_clashing_names(spark):
    long = " ".join(f"w{k % 5000}" for k in range(80_000))
    docs = spark.createDataFrame([(1, long, 1, "x"), (2, long + " end", 2, "y"), (3, "short one here", 3, "z")], "doc_id bigint, text string, component_id int, hashes string")
    assert result(J.jaccard_components(docs)) == brute({1: long, 2: long + " end", 3: "short one here"}, 3, 90)
    assert sorted(map(tuple, J.keep_first(docs).collect())) == [(1, long, 1, "x"), (3, "short one here", 3, "z")]
    assert J.keep_first(docs.limit(0)).count() == 0
