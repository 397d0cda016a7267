import math
import zlib

import numpy as np
from helpers import frame, odd_documents

from strata.llm import language_ppm as L
from strata.llm.queries import QUERIES


def slow_tree(texts):
    counts = {}
    for t in texts:
        data, _ = L.normalised([t])
        data = bytes(data)
        for i in range(L.ORDER, len(data)):
            for k in range(L.ORDER + 1):
                counts.setdefault(data[i - k:i], {}).setdefault(data[i], 0)
                counts[data[i - k:i]][data[i]] += 1
    return counts


def slow_bits(counts, text):
    data, _ = L.normalised([text])
    data, bits = bytes(data), 0.0
    for i in range(L.ORDER, len(data)):
        for k in range(L.ORDER, -1, -1):
            seen = counts.get(data[i - k:i])
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_match_a_plain_context_tree():
    samples = {"aa": ["the cat sat on the mat", "the hat"], "bb": ["le chat est sur la table", "le chapeau été"]}
    model = L.fit(samples, {"aa": 2, "bb": 2})
    texts = ["the table sat", "été zzz", "q", "The CAT, 12 and ß"]
    got = L.code_lengths(model, texts)
    for j, lang in enumerate(model.languages):
        counts = slow_tree(samples[lang])
        for k, t in enumerate(texts):
            assert abs(got[k, j] - slow_bits(counts, t)) < 1e-3, (lang, t)


def test_held_out_accuracy(spark):
    rows = QUERIES["op2_language_ppm"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = rows.join(docs, "doc_id").where("held_out").collect()
    assert len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in held)


def test_prediction_depends_on_text_only(spark):
    train = frame(spark, [(1, "the cat and the dog of the house", "en", "s", 1), (2, "le chat et le chien de la maison", "fr", "s", 1)] * 3)
    model = L.learn(train)
    rows = [(k, t, lang, s, 0) for k, (t, lang, s) in enumerate([("the house", "fr", None), ("la maison", None, "x"), ("123 !?", "en", "s"), (None, "en", "s"), ("", None, None)])]
    got = [(r["lang_pred"], r["score"]) for r in L.predict(frame(spark, rows), model).orderBy("doc_id").collect()]
    assert [p for p, _ in got] == ["en", "fr", "und", "und", "und"]
    assert [s for _, s in got[2:]] == [0, 0, 0]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = L.predict(docs, L.learn(docs))
    assert got.count() == docs.count() and got.columns.count("lang_pred") == 1
    assert {r["lang_pred"] for r in L.predict(docs, None).collect()} == {"und"}
    assert L.learn(docs.limit(0)) is None
    assert L.predict(docs.limit(0), L.learn(docs)).count() == 0


def test_copies_take_one_place_of_the_sample(spark):
    rows = [(k, "same text again", "en", "s", 1) for k in range(50)] + [(99, "autre texte", "fr", "s", 1)]
    model = L.learn(frame(spark, rows))
    assert model.languages == ["en", "fr"]
    assert model.prior[0] < model.prior[1]  # shares count every row


def test_a_language_with_long_texts_only_is_learned(spark):
    en, ru = "the cat and the dog of the house ", "кошка и собака этого старого дома "
    rows = [(1, en, "en", "s", 1), (2, en * 2, "en", "s", 1)] + [(10 + k, f"{k} " * 9000 + ru * 300 + f"{k} " * 9000, "ru", "s", 1) for k in range(3)]
    model = L.learn(frame(spark, rows))
    assert model.languages == ["en", "ru"]
    got = L.predict(frame(spark, [(1, "собака и дом", None, "s", 1), (2, "the old house", None, "s", 1)]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["ru", "en"]
    assert L.learn(frame(spark, rows[2:])).languages == ["ru"]
    # texts without a letter take no place of the sample
    assert L.learn(frame(spark, [(k, f"{k} {k}", "ru", "s", 1) for k in range(2000)] + rows)).languages == ["en", "ru"]


def test_the_sample_is_the_texts_with_the_smallest_hashes(spark, monkeypatch):
    """Whatever the first guess of the share: also when it is far too small."""
    from pyspark.sql import functions as F

    rows = [(k, f"text number {k} of a language", "en", "s", 1) for k in range(3000)] + [(9000 + k, f"eine andere Sprache {k}", "de", "s", 1) for k in range(7)]
    docs = frame(spark, rows)
    monkeypatch.setattr(L, "TEXTS_PER_LANGUAGE", 25)
    order = [r["text"] for r in docs.where("lang = 'en'").orderBy(F.xxhash64("text")).limit(25).collect()]
    seen = {}
    monkeypatch.setattr(L, "fit", lambda samples, shares: seen.update(samples=samples, shares=shares))
    L.learn(docs)
    assert seen["samples"]["en"] == sorted(order) and len(seen["samples"]["de"]) == 7 and seen["shares"] == {"en": 3000, "de": 7}
    keyed = docs.withColumn("key", F.xxhash64("text"))
    assert len(L._sample(keyed, {"en": 1e-12}).get("en", [])) < 25
    narrow = L._sample
    monkeypatch.setattr(L, "_sample", lambda keyed, share: narrow(keyed, {k: v / 1000 for k, v in share.items()} if max(share.values()) < 1 else share))
    L.learn(docs)
    assert seen["samples"]["en"] == sorted(order)


def test_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 3)
    rows = [(k, f"words of label {k % 40}", f"l{k % 40:02d}", "s", 1) for k in range(400)] + [(900, "more of these words", "l07", "s", 1), (901, "and of those", "l31", "s", 1)]
    assert L.learn(frame(spark, rows)).languages == ["l00", "l07", "l31"]
