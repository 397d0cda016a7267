import hashlib
import itertools
import re
import time

import numpy as np
from helpers import ODD_TEXTS, frame, odd_documents

from strata.llm import pii_crf as C
from strata.llm.queries import QUERIES


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def brute(text):
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


TRICKY = ["a@b.c@d.e x@y @z.w a@@b.c q.@a-b.c-d.e. é@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1..2.3.4 .1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111114111111111111111 79927398713",
          "+1 (555) 555-0100 +1+2 3456789 +12345678 ++123 45 67 8 +1 2", "+1 (((((((( +" + "1" * 16, "1.1.1.1@a.b+1 555 555 5555"]


def test_base_spans_match_brute_force():
    for text in [t or "" for t in ODD_TEXTS] + TRICKY:
        assert C.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    begun = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "1." * 100_000, "a." * 100_000 + "@"):
        C.base_spans(text)
    assert time.time() - begun < 20


def test_query_keeps_every_base_span(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op7_pii_crf"](spark, folder).collect()
    assert len(rows) == len(texts)
    extra = 0
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(C.spelled(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in C.KINDS] == [sum(s[0] == k for s in base) for k in C.KINDS]
        spans = list(filter(None, r["spans"].split(",")))
        assert set(filter(None, C.spelled(base).split(","))) <= set(spans)
        extra += len(spans) - len(base)
    assert extra <= 20


def model():
    rng = np.random.default_rng(0)
    texts = []
    for k in range(150):
        d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
        texts.append(f"please write to user{d(2)}@mail{k % 9}.example.com or call +1 ({d(3)}) 555-{d(4)} about item {d(3)} in room {d(2)} today")
        texts.append(f"the host at {rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)} counted {d(5)} of {d(7)} words in version 2.{d(1)}")
    return C.Crf().fit(C.labelled_lines(texts))


def test_viterbi_is_the_best_path():
    crf = C.Crf()
    rng = np.random.default_rng(2)
    crf.move = rng.standard_normal(crf.move.shape)
    sequences = [rng.standard_normal((n, len(C.LABELS))) for n in (1, 2, 4, 5, 0)]
    for e, path in zip(sequences, crf.viterbi(sequences)):
        if len(e):
            score = lambda p: sum(e[t, y] for t, y in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:]))
            best = max(itertools.product(range(len(C.LABELS)), repeat=len(e)), key=score)
            assert abs(score(best) - score(path.tolist())) < 1e-9


def test_finds_what_patterns_miss_and_leaves_the_rest():
    crf = model()
    text = "please write to user77@mail3 about item 123 in room 45, version 2.1 of 17 words"
    (base, spans), = C.scan(crf, [text])
    assert base == [] and ("email", 16, 28) in spans
    assert [s[0] for s in spans] == ["email"]
    (base, spans), = C.scan(crf, ["write to a.b@mail1.example.com now"])
    assert spans == base == [("email", 9, 30)]


def test_skipping_plain_words_changes_nothing():
    crf = model()
    lines = ["please write to user77@mail3 about item 123", "plain words only", "call 1 (555) 555-0101 now or 12 later", "10.1.2.3 7 8", "555 0101"]
    whole = []
    for line in lines:
        words = [(m.start(), m.end()) for m in C.WORD.finditer(line)]
        path = crf.viterbi([crf.scores([".", *(line[a:b] for a, b in words), "."])])[0][1:-1]
        whole.append([(a, b, y) for (a, b), y in zip(words, path) if y])
    for line, found, spans in zip(lines, whole, C.crf_spans(crf, lines)):
        inside = [(a, b, C.LABELS.index(k)) for k, x, y in spans for a, b in [(m.start(), m.end()) for m in C.WORD.finditer(line)] if a < y and x < b]
        assert sorted(inside) == found, line


def test_masking_and_odd_rows(spark):
    crf = model()
    docs = odd_documents(spark).withColumnRenamed("score", "Spans").unionByName(frame(spark, [(500, "mail a@b.example.com, host 1.2.3.4", "en", "s", 1, "own", 1.0)], "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, Spans double"))
    got = C.find_pii(docs, crf)
    assert got.count() == docs.count() and [c.lower() for c in got.columns].count("spans") == 1
    masked = {r["doc_id"]: r for r in C.mask_pii(docs, crf).collect()}
    assert masked[500]["text"] == "mail <EMAIL>, host <IP>" and masked[0]["text"] is None and masked[500]["Spans"] == 1.0
    assert C.mask_pii(docs, crf).columns == docs.columns
    assert C.find_pii(docs.limit(0), C.train(docs.limit(0))).count() == 0
    assert C.mask_text("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a<IP>f"


def private_lines(n):
    rng = np.random.default_rng(3)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    return [f"please write to user{d(2)}@mail{k % 9}.example.com or call +1 ({d(3)}) 555-{d(4)} about item {d(3)} in room {d(2)} today" for k in range(n)]


def test_long_texts_and_hot_logs_keep_every_kind(spark):
    logs = [(k, "\n".join(f"{k} step {k * 1000 + j} took {j} of {j * 7} ms" for j in range(400)), "en", "hot", 1) for k in range(100)]
    private = [(1000 + k, "plain words only here " * 800 + "\n" + line, "en", "s", 1) for k, line in enumerate(private_lines(150))]  # above 16 KiB
    table = C.labelled_table(frame(spark, logs + private))
    count = {kind: sum(kind in C.kinds_of(*line) for line in table) for kind in C.LINES}
    assert count["email"] == count["phone"] == 150 and count["odd"] == C.LINES["odd"] and count["plain"] >= 1
    crf = C.train(frame(spark, logs + private))
    (_, spans), = C.scan(crf, ["please write to user77@mail3 about item 123 in room 45"])
    assert [s[0] for s in spans] == ["email"]


def test_labels_are_those_of_the_first_span():
    for line in [t for t in TRICKY + ODD_TEXTS if t]:
        spans = C.base_spans(line)
        want = [0 if C.plain(m[0]) else next((C.LABELS.index(k) for k, a, b in spans if a < m.end() and m.start() < b), 0) for m in C.WORD.finditer(line)]
        assert C.label_line(line)[1] == want, line
