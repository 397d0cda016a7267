"""Vectorised splitting and hashing of texts: words and tokenizer pieces as numpy arrays.

A chunk of texts becomes one array of code points; words and pieces are (start, length) pairs into
it, hashed to 64 bits by a polynomial over mixed code points.  Used inside Arrow tasks only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BASE = _U(0x5851F42D4C957F2D)
_powers = np.ones(1, _U)

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> _U(32))) * _B
    x ^= x >> _U(29)
    x *= _A
    x ^= x >> _U(32)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        full = np.full(max(n, 2 * len(_powers)), _BASE, _U)
        full[0] = 1
        _powers = np.cumprod(full, dtype=_U)
    return _powers[:n]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and len(texts) + 1 offsets."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum(sizes)])


def first_flags(n: int, offsets: np.ndarray) -> np.ndarray:
    """True where a text begins."""
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    return first[:n]


def word_spans(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, lengths, and the count of words before each text."""
    inside = (cp != 32) & ((cp < 9) | (cp > 13))
    first = first_flags(len(cp), offsets)
    before = np.empty(len(cp), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    after = np.empty(len(cp), bool)
    after[-1:] = False
    after[:-1] = inside[1:] & ~first[1:]
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    return starts, lengths, np.searchsorted(starts, offsets)


@lru_cache(1)
def _mixed_codepoints() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=_U))


def span_hashes(cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span."""
    if not len(starts):
        return np.zeros(0, _U)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    offset = np.arange(ends[-1], dtype=np.int64) - np.repeat(begins, lengths)
    chars = cp if ends[-1] == len(cp) else cp[offset + np.repeat(starts, lengths)]
    value = _mixed_codepoints()[chars] * powers(int(lengths.max()))[offset]
    return mix(np.add.reduceat(value, begins) + lengths.astype(_U) * _A)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of ``n`` neighbouring word hashes (texts not told apart)."""
    total = max(0, len(words) - n + 1)
    out = np.zeros(total, _U)
    for k in range(n):
        out = (out + words[k:k + total]) * (_A + _U(2 * k))
        out ^= out >> _U(31)
    return mix(out)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    import regex

    text = "".join(map(chr, range(0xD800))) + "�" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[m.start():m.end()] = kind
    table[0xD800:0xE000] = OTHER
    return table


def _contractions(cp: np.ndarray, first: np.ndarray, kind: np.ndarray, begin: np.ndarray) -> None:
    """Mark in ``begin`` the pieces 's 't 're 've 'm 'll 'd that start at a marked apostrophe."""
    at = np.flatnonzero(begin & (cp == 39))
    at = at[at + 1 < len(cp)]
    at = at[~first[at + 1]]
    if not len(at):
        return
    one = cp[at + 1]
    short = np.isin(one, [ord(c) for c in "stmd"])
    rest = at[~short]
    rest = rest[rest + 2 < len(cp)]
    rest = rest[~first[rest + 2]]
    a, b = cp[rest + 1], cp[rest + 2]
    pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for where, size in ((at[short], 2), (rest[pair], 3)):
        begin[where + 1] = False
        nxt = where + size
        nxt = nxt[nxt < len(cp)]
        nxt = nxt[~first[nxt] & (kind[nxt] == LETTER)]
        begin[nxt] = True


def byte_bpe_pieces(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of the public byte-level pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; they cover the texts."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, first = classes()[cp], first_flags(n, offsets)
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    last = np.zeros(n, bool)  # the white space right before something else
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]
    begin |= last
    joined = np.zeros(n, bool)  # runs that a blank precedes
    joined[1:] = last[:-1] & (cp[:-1] == 32)
    begin &= ~joined
    _contractions(cp, first, kind, begin)
    starts = np.flatnonzero(begin)
    return starts, np.diff(starts, append=n)


def word_bpe_pieces(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``;
    what lies between them is dropped."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, first = classes()[cp], first_flags(n, offsets)
    begin = first | (kind == NUMBER)
    begin[1:] |= kind[1:] != kind[:-1]
    _contractions(cp, first, kind, begin)
    starts = np.flatnonzero(begin)
    lengths = np.diff(starts, append=n)
    keep = kind[starts] != SPACE
    return starts[keep], lengths[keep]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans (start, length) of ``flat``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)]
