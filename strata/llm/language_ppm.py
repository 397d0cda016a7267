"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: how often each byte followed each context of up to
three bytes.  A text's code length in a language is exact under these frozen counts: a byte seen in
the longest known context costs ``-log2(n / (total + distinct))``; otherwise the escape
(``distinct / (total + distinct)``, method C) is paid and the context loses its first byte, down to
256 equal choices.  The shortest code, with the language's share of the training documents as prior,
names the language; ``score`` is its posterior probability.

The trees are fitted on a bounded sample of labelled texts (``TEXTS_PER_LANGUAGE`` distinct texts with a
letter, of any length, those with the smallest text hash; of a text over ``MAX_TEXT_BYTES`` a piece of ``PIECE_CHARS``
characters, from the first letter behind a place that the hash picks) of the ``LANGUAGES`` labels with the most
training documents, so the driver's sample and the broadcast model are bounded, whatever the corpus and however dirty
its labels; shares are counted over all training documents.  Every text is scored whole.
Texts are lower-cased, and runs of anything but letters count as one blank.

Cases: null text, or a text without a letter: ``und`` with score 0; no training rows at all: ``und``;
ties go to the language that sorts first; repeated rows are scored one by one; texts of any length are scored
whole; an empty table gives no rows; other columns stay unless they have the name of an added one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm import pieces as P
from strata.llm.common import map_text

ORDER = 3
TEXTS_PER_LANGUAGE = 400
LANGUAGES = 128
MAX_TEXT_BYTES = 8192
PIECE_CHARS = 4096
_PAD = b" " * ORDER
_EMPTY = np.uint64(1 << 40)


class GramTable:
    """A hash table from grams (bytes packed into an integer) to rows, probed for many grams at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, _EMPTY, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] == _EMPTY
            self.rows[at[free]] = left[free]
            self.slots[at[free]] = keys[self.rows[at[free]]]
            rest = self.rows[at] != left
            left, at = left[rest], (at[rest] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for unknown ones."""
        at = self._slot(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.rows[at], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != _EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & self.last
            held = self.slots[at]
            hit = held == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (held != _EMPTY)
            left, at = left[go], at[go]
        return out


@dataclass
class Model:
    """Frozen statistics: per gram length the known grams, the code length (bits) of a gram's last
    byte behind its first ones, and the escape cost of the gram as a context, for each language."""

    languages: list[str]
    prior: np.ndarray
    keys: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def tables(self) -> list[GramTable]:
        if not hasattr(self, "_tables"):
            self._tables = [GramTable(k) for k in self.keys]
        return self._tables

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths (one column per language) of the last bytes of ORDER + 1 byte grams."""
        out = np.zeros((len(grams), len(self.languages)), np.float32)
        tables, left = self.tables(), None
        for k in range(ORDER + 1, 0, -1):
            keys = (grams if left is None else grams[left]) & np.uint64((1 << 8 * k) - 1)
            row = tables[k - 1].find(keys)
            hit = row >= 0
            if left is None:
                out[hit] = self.cost[k - 1][row[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] += self.cost[k - 1][row[hit]]
                left = left[~hit]
            if k > 1 and len(left):  # pay the escape from the context of k - 1 bytes
                row = tables[k - 2].find((grams[left] >> np.uint64(8)) & np.uint64((1 << 8 * (k - 1)) - 1))
                out[left[row >= 0]] += self.escape[k - 2][row[row >= 0]]
            elif k == 1 and len(left):
                out[left] += self.root_escape + np.float32(8)
        return out

    root_escape: np.ndarray | None = None


def grams_of(data: np.ndarray) -> np.ndarray:
    """The ORDER + 1 byte grams that end at each byte from ORDER on."""
    x = data.astype(np.uint64)
    out = x[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= x[ORDER - k:len(x) - k] << np.uint64(8 * k)
    return out


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as bytes, lower-cased, other runs than letters as one blank, each text behind
    ORDER blanks; and where each text begins (len + 1 offsets, blanks included)."""
    cp, offsets = P.codepoints([t.lower() for t in texts])
    letter = P.classes()[cp] == P.LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep &= letter | ~P.first_flags(len(cp), offsets)
    chars = np.where(letter, cp, np.uint32(32))
    counts = np.concatenate([[0], np.cumsum(keep)])[offsets]
    kept = chars[keep].tobytes().decode("utf-32-le", "surrogatepass")
    parts = [_PAD + kept[a:b].encode("utf-8", "surrogatepass") for a, b in zip(counts[:-1].tolist(), counts[1:].tolist())]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def fit(samples: dict[str, list[str]], shares: dict[str, float]) -> Model:
    """The context trees of the languages, from sample texts."""
    languages = sorted(samples)
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        data, offsets = normalised(samples[lang])
        grams = grams_of(data) if len(data) > ORDER else np.zeros(0, np.uint64)
        inside = np.ones(len(data), bool)  # not the grams that end in a text's leading blanks
        for k in range(ORDER):
            inside[offsets[:-1] + k] = False
        grams = grams[inside[ORDER:]]
        counted.append([np.unique(grams & np.uint64((1 << 8 * k) - 1), return_counts=True) for k in range(1, ORDER + 2)])
    keys = [np.unique(np.concatenate([c[k][0] for c in counted])) for k in range(ORDER + 1)]
    for k in range(ORDER, 0, -1):  # contexts that are no grams themselves (a text's leading blanks) get rows, too
        keys[k - 1] = np.union1d(keys[k - 1], keys[k] >> np.uint64(8))
    n = [np.zeros((len(keys[k]), len(languages))) for k in range(ORDER + 1)]
    for j, c in enumerate(counted):
        for k in range(ORDER + 1):
            n[k][np.searchsorted(keys[k], c[k][0]), j] = c[k][1]
    cost, escapes = [], []
    for k in range(ORDER + 1):
        context = keys[k] >> np.uint64(8)
        if k == 0:
            total, distinct = n[0].sum(axis=0), (n[0] > 0).sum(axis=0)
            esc = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(total + distinct, 1)), 0.0)
            root = esc
            total, distinct, esc = (np.broadcast_to(x, n[0].shape) for x in (total, distinct, esc))
            shorter = np.full(n[0].shape, 8.0)
        else:
            contexts, where = np.unique(context, return_inverse=True)
            total, distinct = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
            np.add.at(total, where, n[k])
            np.add.at(distinct, where, n[k] > 0)
            esc_of = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(total + distinct, 1)), 0.0)
            table = np.zeros((len(keys[k - 1]), len(languages)), np.float32)
            table[np.searchsorted(keys[k - 1], contexts)] = esc_of
            escapes.append(table)
            total, distinct, esc = total[where], distinct[where], esc_of[where]
            shorter = cost[k - 1][np.searchsorted(keys[k - 1], keys[k] & np.uint64((1 << 8 * k) - 1))]
        with np.errstate(divide="ignore"):
            own = -np.log2(n[k] / np.maximum(total + distinct, 1))
        cost.append(np.where(n[k] > 0, own, esc + shorter))
    share = np.array([shares[x] for x in languages], float)
    model = Model(languages, -np.log2(share / share.sum()) if len(share) else share, keys, [c.astype(np.float32) for c in cost], escapes)
    model.root_escape = np.asarray(root, np.float32)
    return model


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a bounded sample of labelled rows; None if there are none."""
    labelled = rows.select(rows[text_col].cast("string").alias("text"), rows[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null")
    keyed = labelled.withColumn("key", F.when(F.col("text").rlike(r"\p{L}"), F.xxhash64("text")))
    known = keyed.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("texts"))
    shares, wanted = {}, {}
    for r in known.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect():
        shares[r["lang"]] = r["n"]
        if r["texts"]:
            wanted[r["lang"]] = 4 * TEXTS_PER_LANGUAGE / r["texts"]
    samples: dict[str, list[str]] = {}
    while wanted:
        found = _sample(keyed, wanted)
        samples |= found
        # keys are spread evenly, so a share that gives too few texts is most unlikely; it is widened
        wanted = {lang: 16 * share for lang, share in wanted.items() if share < 1 and len(found.get(lang, [])) < TEXTS_PER_LANGUAGE}
    samples = {lang: texts for lang, texts in samples.items() if has_letter(texts).any()}
    return fit(samples, {lang: shares[lang] for lang in samples}) if samples else None


def _sample(keyed: DataFrame, share: dict[str, float]) -> dict[str, list[str]]:
    """Of each language the texts with the TEXTS_PER_LANGUAGE smallest keys.  Only about ``share`` of the range of
    keys is looked at, some times as many texts as are wanted: every task drops the others before the
    shuffle, so a language that fills the table meets no task with more than these."""
    least = -(1 << 63)
    limits = [(lang, min((1 << 63) - 1, least + int(min(part, 1.0) * (1 << 64)))) for lang, part in share.items()]
    table = F.broadcast(keyed.sparkSession.createDataFrame(limits, "lang string, upto bigint"))  # LANGUAGES rows at most
    near = keyed.join(table, "lang").where("key <= upto").groupBy("lang", "key").agg(F.min(_piece()).alias("text"))
    order = Window.partitionBy("lang").orderBy("key")
    first = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TEXTS_PER_LANGUAGE)
    out: dict[str, set[str]] = {}
    for r in first.select("lang", "text").collect():
        out.setdefault(r["lang"], set()).add(r["text"])
    return {lang: sorted(texts) for lang, texts in out.items()}


def _piece() -> Column:
    """What the fit takes of a text: all of a short one, a piece with letters of a long one."""
    rest = F.expr("substring(text, 1 + pmod(key, char_length(text)))")
    first = lambda text: F.regexp_instr(text, F.lit(r"\p{L}"))
    cut = lambda text: F.substring(text, first(text), F.lit(PIECE_CHARS))
    return F.when(F.octet_length("text") <= MAX_TEXT_BYTES, F.col("text")).when(first(rest) > 0, cut(rest)).otherwise(cut(F.col("text")))


def has_letter(texts: list[str]) -> np.ndarray:
    cp, offsets = P.codepoints(texts)
    return np.diff(np.concatenate([[0], np.cumsum(P.classes()[cp] == P.LETTER)])[offsets]) > 0


def code_lengths(model: Model, texts: list[str]) -> np.ndarray:
    """Bits of each text in each language (without the prior)."""
    data, offsets = normalised(texts)
    bits = model.bits(grams_of(data)) if len(data) > ORDER else np.zeros((0, len(model.languages)), np.float32)
    out = np.zeros((len(texts), len(model.languages)))
    for j in range(len(model.languages)):
        sums = np.concatenate([np.zeros(ORDER), bits[:, j].astype(np.float64)])
        for k in range(ORDER):
            sums[offsets[:-1] + k] = 0.0
        out[:, j] = np.add.reduceat(sums, offsets[:-1]) if len(texts) else 0
    return out


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``lang_pred`` and ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str], _) -> dict[str, list]:
        m = held.value
        known = has_letter(texts)
        if m is None:
            return {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
        total = code_lengths(m, texts) + m.prior
        best = total.argmin(axis=1)
        chance = 1 / np.exp2(np.maximum(-60.0, total.min(axis=1, keepdims=True) - total)).sum(axis=1)
        return {"lang_pred": [m.languages[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())], "score": np.where(known, chance, 0.0)}

    return map_text(docs, score, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), text_col, keep)


def fold(id_col: str = "doc_id") -> Column:
    """The fold of a row, 0 to 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
