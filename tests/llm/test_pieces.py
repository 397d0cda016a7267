"""Vectorised splitting against the regular expressions it stands for."""

import random
import re

import numpy as np
import public_tokenizers
import regex

from strata.llm import pieces as P

BYTE = regex.compile(public_tokenizers.PATTERN)
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    alphabet = "ab's' 'tre'll'd 've \n\t\x0b\x1c é1٣²½,.!　漢字😀ß_"
    return ["", " ", "\n\n", "a" * 5000, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000))]


def test_pieces_are_the_matches():
    all_texts = texts()
    cp, offsets = P.codepoints(all_texts)
    joined = "".join(all_texts)
    for split, pattern in ((P.byte_bpe_pieces, BYTE), (P.word_bpe_pieces, WORD)):
        starts, lengths = split(cp, offsets)
        assert [joined[a:a + n] for a, n in zip(starts, lengths)] == [x for t in all_texts for x in pattern.findall(t)]
    starts, lengths, before = P.word_spans(cp, offsets)
    assert [joined[a:a + n] for a, n in zip(starts, lengths)] == [x for t in all_texts for x in PLAIN.findall(t)]
    assert np.diff(before).tolist() == [len(PLAIN.findall(t)) for t in all_texts]


def test_hashes_tell_words_apart_wherever_they_stand():
    cp, offsets = P.codepoints(["ab ba aab ab", "ab ab b a"])
    starts, lengths, _ = P.word_spans(cp, offsets)
    words = "ab ba aab ab ab ab b a".split()
    hashes = P.span_hashes(cp, starts, lengths).tolist()
    assert {(a == b) == (x == y) for a, x in zip(words, hashes) for b, y in zip(words, hashes)} == {True}


def test_nothing_to_split():
    for given in ([], [""], ["", ""]):
        cp, offsets = P.codepoints(given)
        assert len(P.byte_bpe_pieces(cp, offsets)[0]) == len(P.word_bpe_pieces(cp, offsets)[0]) == len(P.word_spans(cp, offsets)[0]) == 0
