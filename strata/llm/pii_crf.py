"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Fixed patterns (e-mail, IP, card, phone) always count.  The CRF labels words ``O`` or one of the four
kinds from features of the word's shape, and finds forms that the patterns miss (an address without a
top-level domain, a phone number without its plus sign).  It is trained by gradient ascent on the
conditional likelihood over a small labelled table: lines of up to twelve words from texts of any length, labelled by
the fixed patterns, and those with personal data once more with the matched text disguised, so that the
shape, not the pattern, must tell.  Of each kind (a label, odd words without a label, plain words) the table takes the
distinct lines with the least hash over all texts, as many as ``LINES`` says (of a word, ``WORD_CHARS`` characters), so a
source of logs takes no other kind's place.  The labelled table may also be given.

Words without a digit or an ``@`` are ``O`` by a fixed constraint of the model, in training and decoding, and
so are the ends of a line.  Exact Viterbi decoding then falls apart into the runs of other words, each
between two ``O``; they are decoded in numpy batches of like length, and most text is never featurised.

Cases: null text is empty; repeated rows are scanned one by one; very long texts are scanned whole in
linear time (of a word, its first 64 characters give its shape); of equally likely label sequences the one with the
first label wins; an empty table gives no rows, and a model without weights that adds no span; other columns stay unless they have the name of an added one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import map_text, materialise, text_chunks, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
LINES = {"email": 400, "ip": 400, "card": 400, "phone": 400, "odd": 1600, "plain": 400}
WORD_CHARS = 256
BATCH = 2048
NEVER = -50.0  # the emission score that forbids a label

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the ``@`` signs,
    which is linear where a scan from the left is not."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL_END.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            end = domain.end()
        at = text.find("@", max(end, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = "".join(DIGITS.findall(m[0]))
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m[0])) <= 15]
    return out


def spelled(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- features -----------------------------------------------------------------------------------

_SHAPE = str.maketrans({**{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}})
N_FEATURES = 1 << 12


def _slot(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % N_FEATURES


def plain(word: str) -> bool:
    """Words that hold neither a digit nor an @."""
    return "@" not in word and not DIGITS.search(word)


def features(word: str) -> list[int]:
    """Slots of the features of a word: its squeezed shape, how many digits, dots, dashes and @ it has, and
    whether it has a card's check digit.  Plain words have the one feature that forbids other labels."""
    if plain(word):
        return [_slot("plain")]
    core = word.strip(".,;:!?\"'")
    shape = re.sub(r"(.)\1+", r"\1", core[:64].translate(_SHAPE))
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    groups = re.split(r"[^0-9]+", core.strip("()+-."))
    return [_slot(x) for x in (
        "bias", f"shape={shape[:24]}", f"digits={min(digits, 20)}", f"letters={min(letters, 3)}", f"dots={min(core.count('.'), 4)}",
        f"dashes={min(core.count('-'), 4)}", f"at={min(core.count('@'), 2)}", f"first={shape[:1]}", f"card={digits == len(core) and 16 <= digits <= 19 and luhn(core)}", f"paren={'(' in core or ')' in core}",
        f"groups={','.join(str(min(len(g), 9)) for g in groups[:5]) if not letters else 'x'}")]


# --- the model ----------------------------------------------------------------------------------

class Crf:
    """Weights of a linear-chain CRF: emission (feature, label) and transition (label, label)."""

    def __init__(self):
        self.emit = np.zeros((N_FEATURES, len(LABELS)))
        self.emit[_slot("plain"), 1:] = NEVER
        self.move = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, words: list[str]) -> np.ndarray:
        return np.array([self.emit[features(w)].sum(axis=0) for w in words]).reshape(-1, len(LABELS))

    def fit(self, lines: list[tuple[list[str], list[int]]], epochs: int = 120, rate: float = 0.25, decay: float = 1e-3) -> "Crf":
        """Maximise the penalised conditional log-likelihood (full-batch Adam, forward-backward in numpy)."""
        lines = [([".", *words, "."], [0, *labels, 0]) for words, labels in lines if words]  # a line's ends are O
        if not lines:
            return self
        K, S, T_ = len(LABELS), len(lines), max(len(w) for w, _ in lines)
        known: dict[str, list[int]] = {}
        rows, cols, feats = [], [], []
        for s, (words, _) in enumerate(lines):
            for t, w in enumerate(words):
                f = known.setdefault(w, features(w))
                rows += [s] * len(f)
                cols += [t] * len(f)
                feats += f
        rows, cols, feats = map(np.array, (rows, cols, feats))
        size = np.array([len(w) for w, _ in lines])
        live = np.arange(T_)[None, :] < size[:, None]
        gold = np.zeros((S, T_), int)
        for s, (_, y) in enumerate(lines):
            gold[s, :len(y)] = y
        both = live[:, 1:]
        gold_emit = np.zeros_like(self.emit)
        np.add.at(gold_emit, feats, np.eye(K)[gold[rows, cols]])
        gold_move = np.zeros((K, K))
        np.add.at(gold_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        state = [np.zeros_like(self.emit), np.zeros_like(self.emit), np.zeros_like(self.move), np.zeros_like(self.move)]
        for step in range(1, epochs + 1):
            e = np.zeros((S, T_, K))
            np.add.at(e, (rows, cols), self.emit[feats])
            a, b = np.zeros((S, T_, K)), np.zeros((S, T_, K))
            a[:, 0] = e[:, 0]
            for t in range(1, T_):
                a[:, t] = np.where(live[:, t, None], np.logaddexp.reduce(a[:, t - 1, :, None] + self.move, axis=1) + e[:, t], a[:, t - 1])
            for t in range(T_ - 2, -1, -1):
                b[:, t] = np.where(live[:, t + 1, None], np.logaddexp.reduce(self.move + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2), 0)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            marginal = np.exp(a + b - z[:, None, None])
            pair = np.exp(a[:, :-1, :, None] + self.move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
            model_emit = np.zeros_like(self.emit)
            np.add.at(model_emit, feats, marginal[rows, cols])
            slope = (gold_emit - model_emit) / S - decay * self.emit
            slope[_slot("plain")] = 0  # the constraint stays
            for w, grad, m, v in ((self.emit, slope, 0, 1), (self.move, (gold_move - pair[both].sum(axis=0)) / S - decay * self.move, 2, 3)):
                state[m] = 0.9 * state[m] + 0.1 * grad
                state[v] = 0.999 * state[v] + 0.001 * grad * grad
                w += rate * (state[m] / (1 - 0.9 ** step)) / (np.sqrt(state[v] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best label path of each sequence of emission scores, in padded batches of like length."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            size = np.array([len(sequences[k]) for k in part])
            longest = int(size.max())
            if not longest:
                continue
            e = np.zeros((len(part), longest, len(LABELS)))
            for r, k in enumerate(part):
                e[r, :size[r]] = sequences[k]
            best = e[:, 0]
            back = np.zeros((len(part), longest, len(LABELS)), np.int8)
            for t in range(1, longest):
                way = best[:, :, None] + self.move
                back[:, t] = way.argmax(axis=1)
                best = np.where((t < size)[:, None], way.max(axis=1) + e[:, t], best)
            label = best.argmax(axis=1)
            path = np.zeros((len(part), longest), int)
            for t in range(longest - 1, -1, -1):
                inside = t < size
                path[inside, t] = label[inside]
                if t:
                    label = np.where(inside, back[np.arange(len(part)), t, label], label)
            for r, k in enumerate(part):
                out[k] = path[r, :size[r]]
        return out


# --- the labelled table -------------------------------------------------------------------------

def label_line(line: str) -> tuple[list[str], list[int]]:
    """Words of a line with the labels of the fixed patterns."""
    at = [m.span() for m in WORD.finditer(line)]
    words, labels = [line[a:b] for a, b in at], [0] * len(at)
    starts, ends = [a for a, _ in at], [b for _, b in at]
    for kind, a, b in base_spans(line):  # the first span that touches a word names it
        for k in range(bisect_right(ends, a), bisect_left(starts, b)):
            if not labels[k] and not plain(words[k]):
                labels[k] = LABELS.index(kind)
    return words, labels


def disguised(words: list[str], labels: list[int]) -> list[str]:
    """The line with forms that the fixed patterns miss: a phone's plus sign and an address's last
    domain part are gone."""
    out = []
    for w, y in zip(words, labels):
        kind = LABELS[y]
        if kind == "phone":
            w = w.lstrip("+") or w
        elif kind == "email" and w.count(".") > 1 and "@" in w:
            w = w[:w.index("@")] + w[w.index("@"):].split(".")[0]
        out.append(w)
    return out


def neighbourhoods(text: str, window: int = 12) -> Iterator[tuple[list[str], list[int]]]:
    """Labelled neighbourhoods of up to ``window`` words around every word of a text with a digit or an ``@``, and the
    plain one that the text begins with."""
    for line in text.split("\n"):
        if "@" not in line and not DIGITS.search(line):
            continue
        words, labels = label_line(line)
        at = 0
        for k, w in enumerate(words):
            if k >= at and not plain(w):
                a, at = max(0, k - window // 2), k + window
                yield words[a:at], labels[a:at]
    words = [m[0] for m in islice(WORD.finditer(text), window)]
    if all(map(plain, words)):
        yield words, [0] * len(words)


def with_disguise(lines: Iterable[tuple[list[str], list[int]]]) -> list[tuple[list[str], list[int]]]:
    """The lines, those with personal data also disguised."""
    out = []
    for words, labels in lines:
        out.append((words, labels))
        if any(labels):
            out.append((disguised(words, labels), labels))
    return out


def labelled_lines(texts: list[str], window: int = 12) -> list[tuple[list[str], list[int]]]:
    """Training lines of all neighbourhoods of the texts."""
    return with_disguise(line for text in texts for line in neighbourhoods(text, window))


def kinds_of(words: list[str], labels: list[int]) -> list[str]:
    """The kinds whose lines a labelled line may stand for."""
    return [LABELS[y] for y in sorted(set(labels)) if y] or ["plain" if all(map(plain, words)) else "odd"]


_LINE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.LongType()))])


def _least_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the texts of a task, the distinct lines of each kind with the least hash."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held: dict[str, dict[int, tuple[list[str], list[int]]]] = {kind: {} for kind in LINES}
    heaps: dict[str, list[int]] = {kind: [] for kind in LINES}  # of -key: the largest key first
    for batch in batches:
        for chunk in text_chunks(batch, 0):
            for text in texts_of(chunk, 0):
                for words, labels in neighbourhoods(text):
                    if not words:
                        continue
                    words = [w[:WORD_CHARS] for w in words]
                    key = int.from_bytes(hashlib.blake2b("\n".join([*words, str(labels)]).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
                    for kind in kinds_of(words, labels):
                        heap, lines = heaps[kind], held[kind]
                        if key in lines or (len(heap) == LINES[kind] and key >= -heap[0]):
                            continue
                        lines[key] = words, labels
                        heapq.heappush(heap, -key)
                        if len(heap) > LINES[kind]:
                            del lines[-heapq.heappop(heap)]
    rows = [{"kind": kind, "key": key, "words": words, "labels": labels} for kind, lines in held.items() for key, (words, labels) in lines.items()]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(_LINE))


def labelled_table(docs: DataFrame, text_col: str = "text") -> list[tuple[list[str], list[int]]]:
    """The bounded labelled table: of each kind, the LINES distinct lines of all texts with the least hash."""
    found = docs.select(docs[text_col].cast("string").alias("text")).where("text is not null").mapInArrow(_least_lines, _LINE)
    lines = materialise(found, "pii-lines").dropDuplicates(["kind", "key"])
    rows = {r["key"]: r for kind, n in LINES.items() for r in lines.where(F.col("kind") == kind).orderBy("key").limit(n).collect()}
    return [(rows[key]["words"], rows[key]["labels"]) for key in sorted(rows)]


def train(docs: DataFrame, text_col: str = "text") -> Crf:
    """Fit on the bounded labelled table of the texts."""
    return Crf().fit(with_disguise(labelled_table(docs, text_col)))


# --- scanning -----------------------------------------------------------------------------------

def crf_spans(model: Crf, texts: list[str]) -> list[list[Span]]:
    """What the CRF finds in each text: neighbouring words of one kind, outer punctuation trimmed."""
    owners, words, sequences, known = [], [], [], {}
    for k, text in enumerate(texts):
        if "@" not in text and not DIGITS.search(text):
            continue
        run: list[tuple[int, int]] = []
        for m in ODD_WORD.finditer(text):
            between = text[run[-1][1]:m.start()] if run else ""
            if run and ("\n" in between or between.strip(" \t\v\f\r")):
                owners.append(k)
                words.append(run)
                run = []
            run.append(m.span())
        if run:
            owners.append(k)
            words.append(run)
    for k, run in zip(owners, words):
        rows = []
        for a, b in run:
            w = texts[k][a:b]
            if w not in known:
                known[w] = model.emit[features(w)].sum(axis=0)
            rows.append(known[w])
        rows = np.array(rows)
        rows[0] += model.move[0]  # what stands before and behind a run is O
        rows[-1] += model.move[:, 0]
        sequences.append(rows)
    out: list[list[Span]] = [[] for _ in texts]
    for k, run, path in zip(owners, words, model.viterbi(sequences)):
        at = 0
        while at < len(run):
            end = at + 1
            while end < len(run) and path[end] == path[at]:
                end += 1
            if path[at]:
                a, b = run[at][0], run[end - 1][1]
                while a < b and texts[k][a] in ".,;:!?\"'":
                    a += 1
                while a < b and texts[k][b - 1] in ".,;:!?\"'":
                    b -= 1
                if a < b:
                    out[k].append((LABELS[path[at]], a, b))
            at = end
    return out


#: A word with a digit or an @; no other words are decoded.
ODD_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")


def scan(model: Crf, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind as listed, then start; the CRF adds spans that
    touch no base span."""
    out = []
    for text, found in zip(texts, crf_spans(model, texts)):
        base = base_spans(text)
        extra = [s for s in found if not any(s[1] < b and a < s[2] for _, a, b in base)]
        out.append((base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


_FOUND = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])


def find_pii(docs: DataFrame, model: Crf, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with the counts of base spans by kind,
    ``base_spans`` and ``spans`` (kind:start:end, in code points, comma-joined)."""
    held = docs.sparkSession.sparkContext.broadcast((model.emit, model.move))

    def run(texts: list[str], _) -> dict[str, list]:
        m = Crf()
        m.emit, m.move = held.value
        found = scan(m, texts)
        cols: dict[str, list] = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
        return cols | {"base_spans": [spelled(b) for b, _ in found], "spans": [spelled(s) for _, s in found]}

    return map_text(docs, run, _FOUND, text_col, keep)


def mask_text(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are masked as
    one, under the kind that starts first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data masked in ``text_col``; null stays null."""
    held = docs.sparkSession.sparkContext.broadcast((model.emit, model.move))
    names = docs.columns
    inner = docs.toDF(*[f"__{k}" for k in range(len(names))])
    at = names.index(text_col)

    def run(texts: list[str], column) -> dict[str, list]:
        m = Crf()
        m.emit, m.move = held.value
        return {"masked": [None if missing else mask_text(t, spans) for t, (_, spans), missing in zip(texts, scan(m, texts), column.is_null().to_pylist())]}

    masked = map_text(inner, run, T.StructType([T.StructField("masked", T.StringType())]), f"__{at}")
    return masked.select(*[F.col("masked" if k == at else f"__{k}").alias(c) for k, c in enumerate(names)])
